"""Join shapes over the order and supply tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import frames
from siltworks.operators import joining as J
from siltworks.plans.registry import query
from siltworks.session import table


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("""
SELECT c_custkey, o.o_orderkey, o.o_orderstatus FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON c_custkey = o_custkey""")
def left_join_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.with_latest(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""
SELECT o_orderkey, o_custkey, o_orderdate FROM orders JOIN (SELECT o_custkey AS k, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = k WHERE o_orderdate = last""")
def current_version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    heads = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return J.current_version(o, heads, "o_custkey", "o_orderdate", "last").select("o_orderkey", "o_custkey", "o_orderdate")


@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def three_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.having_any(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), some, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing_from(table(spark, sf_dir, "customer").select("c_custkey"), big, "c_custkey")


@query("""
WITH a AS (SELECT DISTINCT user_id AS k FROM events), b AS (SELECT c_custkey AS k FROM customer)
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def both_ways_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that are no customers, and customers that are no users."""
    return J.both_ways(table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS generation FROM orders")
def generation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.generations(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "generation")


@query("""
WITH t AS (SELECT p_name AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS target FROM part GROUP BY 1), r AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name || '?' ELSE p_name END AS name FROM part)
SELECT p_partkey, r.name, CASE WHEN n = 1 THEN 'resolved-static' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved-dynamic' END AS resolution_status, CASE WHEN n = 1 THEN target END AS target_id FROM r LEFT JOIN t ON r.name = t.name""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by name to all parts; some names are not there, some are shared."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    targets = parts.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("target"))
    refs = parts.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("name"))
    return J.resolve_names(refs, targets, "name", "target").select("p_partkey", "name", "resolution_status", "target_id")


@query("""
WITH c AS (
  SELECT a.p_partkey AS ref, b.p_partkey AS target, 0 AS tier FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND b.p_size = 1
  UNION ALL SELECT a.p_partkey, b.p_partkey, 1 FROM part a JOIN part b ON a.p_type = b.p_type AND b.p_size = 2
  UNION ALL SELECT a.p_partkey, b.p_partkey, 2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size = 3 AND b.p_partkey % 7 = 0),
m AS (SELECT ref, min(tier) AS tier FROM c GROUP BY ref), n AS (SELECT c.ref, c.tier, count(DISTINCT target) AS k, min(target) AS target FROM c JOIN m ON c.ref = m.ref AND c.tier = m.tier GROUP BY ALL)
SELECT p_partkey AS ref, tier, CASE WHEN k = 1 THEN 'resolved-static' WHEN k > 1 THEN 'ambiguous' ELSE 'unresolved-dynamic' END AS resolution_status,
  CASE tier WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN k = 1 THEN target END AS target_id FROM part LEFT JOIN n ON p_partkey = n.ref""")
def type_resolution_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    refs = p.select(F.col("p_partkey").alias("ref"), "p_type", "p_brand")

    def tier(size: int, *keys: str, extra: str = "true") -> tuple[DataFrame, list[str]]:
        return p.where(f"p_size = {size} AND {extra}").select(F.col("p_partkey").alias("target"), *keys), list(keys)

    tiers = [tier(1, "p_type", "p_brand"), tier(2, "p_type"), tier(3, "p_brand", extra="p_partkey % 7 = 0")]
    return J.resolve_in_key_tiers(refs, tiers, "ref", "target").drop("p_type", "p_brand")


@query("""
SELECT a.doc_id, length(a.text)::INT AS n_before, length(b.text)::INT AS n_after FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0""")
def before_after_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, "_before").otherwise("_after"), F.lit(".html")).alias("name"), "text")
    pairs = J.pair_files(d, "name", "text")
    key = F.regexp_extract("key", r"^(\d+)", 1).cast("long") * 2
    return pairs.select(key.alias("doc_id"), F.length("before").alias("n_before"), F.length("after").alias("n_after"))


@query("""
SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0 AND length(a.text) > 3000 OR a.doc_id % 2 = 0 AND length(b.text) > 3000""")
def pairs_over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    evens = d.where("doc_id % 2 = 0")
    odds = d.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m"))
    return evens.join(odds, "doc_id").where("n > 3000 OR m > 3000").select("doc_id")


@query(r"""
SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0
  AND NOT list_contains(regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+'), 'with') AND list_contains(regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]+'), 'with')""")
def word_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.functions.text import words

    d = table(spark, sf_dir, "documents").select("doc_id", F.array_contains(words(F.col("text")), "with").alias("has"))
    after = d.where("doc_id % 2 = 1 AND has").select((F.col("doc_id") - 1).alias("doc_id"))
    return d.where("doc_id % 2 = 0 AND NOT has").select("doc_id").join(after, "doc_id", "left_semi")


@query()
def word_diff_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the ratio is difflib's. Consecutive turns of a conversation are the pairs."""
    from siltworks.functions.values import word_diff_ratios

    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    pairs = c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("text").alias("before"), "after")
    return pairs.mapInPandas(word_diff_ratios, "key string, ratio double, differs boolean")


@query("""
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)
UNION ALL SELECT c_custkey, c_name || '*', c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return J.upsert(c, new, "c_custkey")


@query("""
SELECT k, CASE WHEN k % 6 = 0 THEN 'c' WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS origin FROM (SELECT p_partkey AS k FROM part)""")
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return J.union_by_priority([p.withColumn("origin", F.lit("a")), p.where("k % 3 = 0").withColumn("origin", F.lit("b")), p.where("k % 6 = 0").withColumn("origin", F.lit("c"))], "k")


@query("""
SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL BY NAME SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer""")
def concat_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return frames.concat_frames([s, c])


@query("""
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'flagged' WHEN l.quality = 1 THEN 'confirmed' WHEN l.quality = 0 THEN 'dismissed' ELSE 'new' END AS review_status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def review_status_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "dismissed").otherwise("new")
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", status.alias("review_status"))


@query("""
SELECT p_partkey, original, n_copies FROM (SELECT p_partkey, min(p_partkey) OVER w AS original, count(*) OVER w AS n_copies FROM part WINDOW w AS (PARTITION BY p_type, p_brand, p_size)) WHERE n_copies > 1""")
def same_size_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ in a copy mark with equal size; here parts of equal type, brand and size. Each names the first of its group, not every other."""
    keys = ["p_type", "p_brand", "p_size"]
    p = table(spark, sf_dir, "part").select("p_partkey", *keys)
    groups = p.groupBy(*keys).agg(F.min("p_partkey").alias("original"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return p.join(groups, keys).select("p_partkey", "original", "n_copies")


@query("""
WITH f AS (SELECT o_custkey AS folder, o_orderstatus || (o_orderkey % 3) || CASE WHEN o_orderkey % 4 = 0 THEN ' (' || (o_orderkey % 7) || ')' WHEN o_orderkey % 4 = 1 THEN ' (' || (o_orderkey % 7 + 10) || ')' ELSE '' END || '.png' AS name, o_orderkey % 2 AS size FROM orders)
SELECT DISTINCT c.folder, c.name, o.name AS original FROM f c JOIN f o ON c.folder = o.folder AND c.size = o.size AND regexp_matches(c.name, '^.* \\([0-9]\\)\\.png$') AND o.name = regexp_replace(c.name, ' \\([0-9]\\)\\.png$', '.png')""")
def marked_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder that are marked as copies of another one of equal size."""
    k = F.col("o_orderkey")
    mark = F.when(k % 4 == 0, F.concat(F.lit(" ("), (k % 7).cast("string"), F.lit(")"))).when(k % 4 == 1, F.concat(F.lit(" ("), (k % 7 + 10).cast("string"), F.lit(")"))).otherwise("")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), F.concat("o_orderstatus", (k % 3).cast("string"), mark, F.lit(".png")).alias("name"), (k % 2).alias("size"))
    return J.copies_of_same_size(files, "folder", "name", "size")
