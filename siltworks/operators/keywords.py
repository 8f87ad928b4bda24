"""Phrases of a dictionary found in texts, as whole words in any case of letters.

A phrase of n words can only be found where n words of the text, with what stands between them, are the phrase. So each text is turned into the
distinct hashes of its runs of n words, for each n that the dictionary has. Bits of the dictionary's hashes, a few for each phrase and broadcast, stop
nearly all runs that are no phrase where they are made; the others meet the dictionary in one join on the hash. So the dictionary is never gone through for
a text, texts and most of their runs are not shuffled, and a small dictionary is broadcast by Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.session import scratch

WORD = r"[\p{L}\p{N}_]+"
#: \w is part of what follows, but Java tells the usual letters by it at once.
_PIECE = r"[\w\p{L}\p{N}]++|[^\w\p{L}\p{N}]++"
#: A text up to the end of its ninth word.
FIRST_NINE = r"^(?:[^\w\p{L}\p{N}]*+[\w\p{L}\p{N}]++){0,9}"
#: Bits for each phrase, and at most (32 MB; with more phrases the bits stop less, and the join still decides); longs to a row of bits.
BITS_PER_PHRASE, MOST_BITS, WORDS_PER_BUCKET = 16, 1 << 28, 64


def trimmed(phrase: Column) -> Column:
    """A phrase in lower case from its first to its last word."""
    return F.regexp_replace(F.lower(phrase), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def _runs(texts: DataFrame, text: str, most: int) -> DataFrame:
    """texts with pf_runs_1 to pf_runs_<most>: the hashes of all runs of so many words of text, with what stands between them."""
    # A condition on the pieces would be moved below them and cut each text twice.
    cut = texts.withColumn("pf_pieces", F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)))
    first = F.when(F.get("pf_pieces", F.lit(0)).rlike(WORD), 0).otherwise(1)
    cut = cut.withColumns({"pf_hashes": F.transform("pf_pieces", lambda p: F.xxhash64(p)), "pf_first": first})
    out = cut.withColumns({"pf_runs_1": F.filter("pf_hashes", lambda _, i: i % 2 == F.col("pf_first")), "pf_gaps": F.filter("pf_hashes", lambda _, i: (i > F.col("pf_first")) & (i % 2 != F.col("pf_first")))})
    left = lambda n: F.greatest(F.size("pf_runs_1") - n + 1, F.lit(0))  # noqa: E731  runs of n words
    both = lambda x, y: F.xxhash64(x, y)
    # What follows a word up to the end of the next one; a run is the one that is a word shorter, and that.
    out = out.withColumn("pf_next", F.zip_with(F.slice("pf_gaps", F.lit(1), left(2)), F.slice("pf_runs_1", F.lit(2), left(2)), both))
    for n in range(2, most + 1):
        out = out.withColumn(f"pf_runs_{n}", F.zip_with(F.slice(f"pf_runs_{n - 1}", F.lit(1), left(n)), F.slice("pf_next", F.lit(n - 1), left(n)), both))
    return out.drop("pf_pieces", "pf_hashes", "pf_first", "pf_gaps", "pf_next")


def _marks(hashes: DataFrame, n_bits: int) -> DataFrame:
    """(pf_bucket, pf_marks): bits of the hashes (pf_hash), by hash modulo n_bits, WORDS_PER_BUCKET words to a row."""
    slot = F.pmod("pf_hash", F.lit(n_bits))
    words = hashes.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    held = words.groupBy(F.expr(f"w DIV {WORDS_PER_BUCKET}").alias("pf_bucket")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("w", F.lit(WORDS_PER_BUCKET)).cast("int"), "bits"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS_PER_BUCKET - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return held.select("pf_bucket", filled.alias("pf_marks"))


def found_phrases(texts: DataFrame, key: str, text: str, phrases: DataFrame, most: int | None = 15) -> DataFrame:
    """(key, phrase, rank): the phrases (phrase, rank) that each text holds, the first most by rank, then phrase; all with most None.

    Phrases are compared from their first word to their last one, in lower case; one without a word is never found, and of phrases that are then equal the one of
    least rank, then least phrase, stands for them. Null texts and phrases hold nothing. Rows of equal key are one text. The longest phrase decides how
    many runs of a text are hashed: as many as words for each length up to that.
    """
    words = F.regexp_count("pf_text", F.lit(WORD))
    held = phrases.select("phrase", "rank", trimmed(F.col("phrase")).alias("pf_text")).where(words > 0)
    held = held.groupBy("pf_text").agg(F.min(F.struct("rank", "phrase")).alias("p")).select("pf_text", "p.*")
    held = scratch(held.withColumn("n", words), "phrases")
    told = held.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()  # one row per length of phrases
    lengths = sorted(r["n"] for r in told)
    if not lengths:
        return texts.select(key, F.lit(None).cast("string").alias("phrase"), F.lit(None).cast(dict(phrases.dtypes)["rank"]).alias("rank")).limit(0)
    # Of a phrase, the one run of all its words.
    whole = F.element_at(F.array(*[F.get(f"pf_runs_{n}", F.lit(0)) for n in lengths]), F.array_position(F.array(*map(F.lit, lengths)), F.col("n")).cast("int"))
    held = scratch(_runs(held, "pf_text", lengths[-1]).select("phrase", "rank", whole.alias("pf_hash")), "phrases")
    cut = _runs(texts.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("pf_text")), "pf_text", lengths[-1])
    runs = cut.select(key, F.explode(F.array_distinct(F.flatten(F.array(*[f"pf_runs_{n}" for n in lengths])))).alias("pf_hash"))
    # Only runs whose bit is set by some phrase go to the join; a bit that another phrase has set costs a row, no more.
    n_bits = min(MOST_BITS, 64 * WORDS_PER_BUCKET * max(1, -(-BITS_PER_PHRASE * sum(r["k"] for r in told) // (64 * WORDS_PER_BUCKET))))
    slot = F.pmod("pf_hash", F.lit(n_bits))
    marked = runs.withColumn("pf_bucket", F.shiftright(slot, 6 + WORDS_PER_BUCKET.bit_length() - 1)).join(F.broadcast(_marks(held, n_bits)), "pf_bucket")
    word = F.element_at("pf_marks", (F.shiftright(slot, 6).bitwiseAND(F.lit(WORDS_PER_BUCKET - 1)) + 1).cast("int"))
    likely = marked.where(F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1).select(key, "pf_hash")
    met = likely.join(held.select("pf_hash", "rank"), "pf_hash")
    if most is None:
        return met.distinct().join(held.select("pf_hash", "phrase"), "pf_hash").select(key, "phrase", "rank").distinct()
    # The phrases themselves join those that are left only: equal ranks are told apart by them.
    near = met.withColumn("pf_place", F.dense_rank().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("pf_place") <= most).select(key, "pf_hash").distinct()
    named = near.join(held.select("pf_hash", "phrase", "rank"), "pf_hash").select(key, "phrase", "rank").distinct()
    place = Window.partitionBy(key).orderBy("rank", "phrase")
    return named.withColumn("pf_place", F.row_number().over(place)).where(F.col("pf_place") <= most).drop("pf_place")
