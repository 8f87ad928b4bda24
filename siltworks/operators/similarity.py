"""TF-IDF and average similarity in time linear in the number of non-zero weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tf_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, weight): words of two characters or more in lower case, smooth idf ln((1 + n) / (1 + df)) + 1, rows of norm 1."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    tf = docs.select(F.col(key).alias("k"), F.explode(words).alias("word")).groupBy("k", "word").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # n is one row
    idf = df.select("word", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "word").select("k", "word", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "k").select(F.col("k").alias(key), "word", (F.col("w") / F.col("norm")).alias("weight"))


def average_similarity(weights: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """(key, average): each row's mean cosine to all others, as its product with the sum of all rows. A row without weights has -1 / (n - 1);
    a single row has null."""
    total = weights.groupBy("word").agg(F.sum("weight").alias("total"))
    own = weights.join(total, "word").groupBy(key).agg(F.sum(F.col("weight") * F.col("total")).alias("sum"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    joined = rows.select(key).join(own, key, "left").crossJoin(F.broadcast(n))  # n is one row
    return joined.select(key, F.try_divide(F.coalesce("sum", F.lit(0.0)) - 1, F.col("n") - 1).alias("average"))


def average_cosine(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """The same for dense vectors: unit vectors are exploded to (dimension, value) and summed by dimension."""
    flat = vectors.select(F.col(key), F.posexplode(vector).alias("word", "x")).withColumn("x", F.col("x").cast("double"))
    norm = flat.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    unit = flat.join(norm, key).select(key, "word", (F.col("x") / F.col("norm")).alias("weight"))
    return average_similarity(unit, key, vectors)


def label_similarity(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Mean cosine of one-dimensional label codes (0 for the first in order): 1 between codes above 0, 0 with code 0."""
    first = rows.agg(F.min(label).alias("first"), F.count(F.lit(1)).alias("n"))
    zero = rows.crossJoin(F.broadcast(first))  # one row
    counts = zero.groupBy("n").agg(F.count_if(F.col(label) == F.col("first")).alias("zeros"))
    joined = zero.join(F.broadcast(counts), "n")
    others = F.col("n") - F.col("zeros")
    return joined.select(key, F.try_divide(F.when(F.col(label) == F.col("first"), F.lit(-1)).otherwise(others - 1), F.col("n") - 1).alias("average"))


def blend(a: DataFrame, b: DataFrame, key: str, weights: DataFrame | None = None, sector: str = "sector") -> DataFrame:
    """Half of each average, times the sector's weight (1 where it has none)."""
    joined = a.select(key, F.col("average").alias("x")).join(b.select("*", F.col("average").alias("y")).drop("average"), key)
    if weights is not None:
        joined = joined.join(weights, sector, "left").withColumn("wt", F.coalesce("weight", F.lit(1.0)))
    else:
        joined = joined.withColumn("wt", F.lit(1.0))
    return joined.select(key, ((0.5 * F.col("x") + 0.5 * F.col("y")) * F.col("wt")).alias("score"))
