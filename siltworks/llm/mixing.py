"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations alone.

Sizes are words. Each source gets a target (its weight's share of all words, at most MAX_EPOCHS times its own), a quota of equal
blocks of words by the highest quotients target / (2k + 1), and each shard of a source gets its part of that quota the same
way. Within a shard, documents stand in seeded order on one line of words cut into blocks; whole passes over the line
come first, and the rest of the quota is taken from blocks spread evenly from a seeded start. What a document gives is the overlap
of its words with the blocks taken.

A source is cut into hashed shards, so one that holds a third of all rows is many groups; quotas are decided over
one row per source and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.session import scratch

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
#: Words of a block at most; small tables get smaller blocks so that rounding stays small.
BLOCK_WORDS = 64
BLOCKS_PER_GROUP = 256
#: Shards that share one line of quotas, and documents of a shard.
SHARDS_PER_ROW = 1024
DOCS_PER_SHARD = 1024

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _half_of_md5(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(by_source: DataFrame) -> DataFrame:
    """From (mx_key, mx_source_size): weight and target. Targets share the sum of sizes by weight; one above MAX_EPOCHS times its source
    stops there and the excess is reshared until none is above, which is filling to a common level."""
    every = Window.orderBy("mx_key")
    rows = by_source.withColumn("mx_place", F.row_number().over(every))
    k = (F.col("mx_place") - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (k + 1).cast("int")).cast("long")
    rows = rows.withColumn("mx_weight", weight).withColumn("mx_cap", F.col("mx_source_size") * MAX_EPOCHS)
    ratio = F.col("mx_cap") / F.col("mx_weight")
    by_ratio = Window.orderBy(ratio, "mx_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (
        rows.withColumn("mx_total", F.sum("mx_source_size").over(whole))
        .withColumn("mx_left", F.col("mx_total") - F.coalesce(F.sum("mx_cap").over(before), F.lit(0)))
        .withColumn("mx_open", F.sum("mx_weight").over(whole) - F.coalesce(F.sum("mx_weight").over(before), F.lit(0)))
        .withColumn("mx_level", F.col("mx_left") / F.col("mx_open"))
    )
    level = F.max(F.when(F.col("mx_level") <= ratio, F.col("mx_level"))).over(whole)
    target = F.least(F.col("mx_cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("mx_weight"))
    return rows.select("mx_key", "mx_place", "mx_source_size", "mx_total", F.coalesce(target, F.lit(0.0)).alias("mx_target"))


def highest_quotients(
    claims: DataFrame, seats: str, share: Column, weight: Column, limit: Column | None, group: list[str], tie: list[str], out: str
) -> DataFrame:
    """Sainte-Lague: within each group, as many seats as column seats holds go to the highest quotients weight / (2k + 1).

    Every claim gets at least its share less a bound and at most its share plus that bound, so only seats between them are
    ranked: about five a claim, however many seats there are. limit caps a claim's seats.
    """
    among = Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = claims.withColumn("mx_share", share).withColumn("mx_claims", F.count(F.lit(1)).over(among))
    slack = F.floor(F.col("mx_share") * F.col("mx_claims") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 2
    low = F.greatest(F.lit(0), F.floor(F.col("mx_share")) - slack).cast("long")
    high = (F.floor(F.col("mx_share")) + slack + 1).cast("long")
    if limit is not None:
        low, high = F.least(low, limit), F.least(high, limit)
    rows = rows.withColumn("mx_low", low).withColumn("mx_high", high)
    rows = rows.withColumn("mx_free", F.col(seats) - F.sum("mx_low").over(among))
    offers = rows.withColumn(
        "mx_seat", F.explode_outer(F.when(F.col("mx_high") > F.col("mx_low"), F.sequence("mx_low", F.col("mx_high") - 1)))
    ).withColumn("mx_quotient", weight / (2 * F.col("mx_seat") + 1))
    ranked = Window.partitionBy(*group).orderBy(F.col("mx_quotient").desc_nulls_last(), *tie, "mx_seat")
    offers = offers.withColumn("mx_rank", F.row_number().over(ranked))
    won = F.sum(F.when(F.col("mx_seat").isNotNull() & (F.col("mx_rank") <= F.col("mx_free")), 1).otherwise(0))
    keep = [c for c in claims.columns if c != out]
    return offers.groupBy(*keep, "mx_low").agg(won.alias("mx_won")).select(*keep, (F.col("mx_low") + F.col("mx_won")).alias(out))


def _apportioned(claims: DataFrame, seats: str, whole: str, size: str, blocks: str, group: list[str], tie: str, out: str) -> DataFrame:
    """Seats of each group to its claims by size, none more than MAX_EPOCHS times its blocks."""
    share = F.coalesce(F.try_divide((F.col(seats) * F.col(size)).cast("double"), F.col(whole)), F.lit(0.0))
    return highest_quotients(claims, seats, share, F.col(size), F.col(blocks) * MAX_EPOCHS, group, [tie], out)


def mix_plan(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, the carried columns, and the line of its shard: mx_start, mx_block, mx_quota,
    mx_blocks and mx_begin (see selected()).

    Null texts have size 0 and take nothing. Null sources are one source, last in order. Equal doc_ids are separate rows; equal rows stand next to
    each other on the line, and which of them gives which words is all the same. Equal quotients go to the source, then the shard, that comes
    first. Texts are counted whole, however long. A table without rows or words takes nothing. Columns other than doc_id, text, source and the
    carried ones are ignored, whatever their names.

    The number of shards grows with the table, so windows over a shard's documents do not. Quotas go from a source to rows of SHARDS_PER_ROW shards, then
    to the shards of each, so a window holds the shards of a row, or a line for every million documents of a source; windows over
    sources hold one line each.
    """
    rows = docs.select(
        F.col("doc_id").alias("mx_doc"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("mx_key"),
        word_count(F.col("text")).alias("mx_size"),
        _half_of_md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))).alias("mx_hash"),
        *[F.col(c).alias(f"mx_c_{c}") for c in carry],
    )
    if not carry:
        rows = scratch(rows, "sizes")
    shards = max(1, -(-docs.count() // DOCS_PER_SHARD))
    rows = rows.withColumn("mx_shard", F.col("mx_hash") % shards)
    groups = rows.groupBy("mx_key", "mx_shard").agg(F.sum("mx_size").alias("mx_group_size"))
    groups = scratch(groups, "groups")
    sources = source_targets(groups.groupBy("mx_key").agg(F.sum("mx_group_size").alias("mx_source_size")))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("mx_total") / (BLOCKS_PER_GROUP * groups.count() or 1)))).cast("long")
    sources = sources.withColumn("mx_block", block).withColumn("mx_one", F.lit(1))
    sources = sources.withColumn("mx_seats", F.floor(F.col("mx_total") / F.col("mx_block")).cast("long"))
    quota = highest_quotients(
        sources,
        "mx_seats",
        F.coalesce(F.try_divide(F.col("mx_target") * F.col("mx_seats"), F.col("mx_total")), F.lit(0.0)),
        F.col("mx_target"),
        None,
        ["mx_one"],
        ["mx_place"],
        "mx_source_quota",
    )
    parts = groups.join(quota, "mx_key").withColumn("mx_blocks", F.ceil(F.col("mx_group_size") / F.col("mx_block")).cast("long"))
    parts = parts.withColumn("mx_row", F.floor(F.col("mx_shard") / SHARDS_PER_ROW))
    shelves = parts.groupBy("mx_key", "mx_row", "mx_source_size", "mx_source_quota").agg(F.sum("mx_group_size").alias("mx_row_size"), F.sum("mx_blocks").alias("mx_row_blocks"))
    shelves = _apportioned(shelves, "mx_source_quota", "mx_source_size", "mx_row_size", "mx_row_blocks", ["mx_key"], "mx_row", "mx_row_quota")
    parts = parts.join(shelves.select("mx_key", "mx_row", "mx_row_size", "mx_row_quota"), ["mx_key", "mx_row"])
    parts = _apportioned(parts, "mx_row_quota", "mx_row_size", "mx_group_size", "mx_blocks", ["mx_key", "mx_row"], "mx_shard", "mx_quota")
    start = _half_of_md5(F.concat_ws(":", F.lit(SEED), "mx_key", "mx_shard")) % F.greatest("mx_blocks", F.lit(1))
    parts = scratch(parts.select("mx_key", "mx_shard", "mx_source_size", "mx_target", "mx_block", "mx_blocks", "mx_quota", start.alias("mx_begin")), "quotas")
    line = Window.partitionBy("mx_key", "mx_shard").orderBy("mx_hash", "mx_doc", "mx_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(parts, ["mx_key", "mx_shard"]).withColumn("mx_end", F.sum("mx_size").over(line))
    placed = placed.withColumn("mx_start", F.col("mx_end") - F.col("mx_size"))
    passes = F.when(F.col("mx_blocks") > 0, F.floor(F.col("mx_quota") / F.greatest("mx_blocks", F.lit(1)))).otherwise(0)
    taken = passes * F.col("mx_size") + _taken_before(F.col("mx_end")) - _taken_before(F.col("mx_start"))
    return placed.select(
        F.col("mx_doc").alias("doc_id"),
        F.col("mx_size").alias("size"),
        F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"),
        taken.cast("long").alias("taken"),
        *[f"mx_c_{c}" for c in carry],
        "mx_start",
        "mx_block",
        "mx_quota",
        "mx_blocks",
        "mx_begin",
    )


def _extra_before(block: Column) -> Column:
    """Blocks of the last, partial pass among the first ones of the line."""
    blocks = F.greatest(F.col("mx_blocks"), F.lit(1))
    return F.expr("0L") + F.floor((block * (F.col("mx_quota") % blocks) + F.col("mx_begin")) / blocks).cast("long")


def selected(word: Column) -> Column:
    """Whether the partial pass takes this word of the line."""
    block = F.floor(word / F.col("mx_block")).cast("long")
    return _extra_before(block + 1) > _extra_before(block)


def _taken_before(words: Column) -> Column:
    """Words that the partial pass takes among the first ones of the line."""
    block = F.floor(words / F.col("mx_block")).cast("long")
    return _extra_before(block) * F.col("mx_block") + F.when(selected(words), words % F.col("mx_block")).otherwise(0)


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken); see mix_plan for the cases."""
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as whole passes take it, and once more with the words that the
    partial pass takes (white space before each kept, n_chars counted anew). A document of which nothing is taken goes."""
    plan = mix_plan(docs, tuple(docs.columns))
    chunks = F.split(F.col("mx_c_text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    some = F.array_join(F.filter(chunks, lambda _, i: (i < F.col("size")) & selected(F.col("mx_start") + i)), "")
    passes = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("int")
    rest = F.col("taken") - passes * F.col("size")
    texts = F.concat(
        F.array_repeat(F.col("mx_c_text"), passes), F.when(rest > 0, F.array(F.ltrim(some))).otherwise(F.array().cast("array<string>"))
    )
    rows = plan.withColumn("mx_text", F.explode(texts))
    made = {"text": F.col("mx_text"), "n_chars": F.length("mx_text").cast("long")}
    return rows.select(*[made.get(c, F.col(f"mx_c_{c}")).alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """The mix as DuckDB SQL."""
    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || COALESCE(doc_id::VARCHAR, '-') || ':' || md5(COALESCE(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
n AS (SELECT greatest(1, (count(*) + {DOCS_PER_SHARD - 1}) // {DOCS_PER_SHARD}) AS shards FROM d),
r AS (SELECT d.*, h % shards AS sh FROM d, n),
g AS (SELECT k, sh, sum(size)::BIGINT AS gs FROM r GROUP BY ALL),
s0 AS (SELECT k, sum(gs)::BIGINT AS ss FROM g GROUP BY k),
s1 AS (SELECT *, row_number() OVER (ORDER BY k) AS place FROM s0),
s2 AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS w, {MAX_EPOCHS} * ss AS cap FROM s1),
s3 AS (SELECT *, cap / w AS ratio, (sum(ss) OVER ())::BIGINT AS total,
    (sum(ss) OVER () - COALESCE(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(w) OVER () - COALESCE(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS open_w
  FROM s2),
s4 AS (SELECT *, max(CASE WHEN rest / open_w <= ratio THEN rest / open_w END) OVER () AS level FROM s3),
s5 AS (SELECT k, place, ss, total, least(cap::DOUBLE, COALESCE(level, 0) * w) AS target,
    greatest(1, least({BLOCK_WORDS}, total // ({BLOCKS_PER_GROUP} * (SELECT count(*) FROM g))))::BIGINT AS b FROM s4),
s6 AS (SELECT *, total // b AS seats, COALESCE(target * (total // b) / total, 0) AS share, count(*) OVER () AS claims FROM s5),
s7 AS (SELECT *, floor(share * claims / (2 * greatest(seats, 1)))::BIGINT + 2 AS slack FROM s6),
s8 AS (SELECT *, greatest(0, floor(share)::BIGINT - slack) AS low, floor(share)::BIGINT + slack + 1 AS high FROM s7),
s9 AS (SELECT *, seats - sum(low) OVER () AS free FROM s8),
o1 AS (SELECT k, place, target, free, unnest(range(low, high)) AS seat FROM s9),
o2 AS (SELECT k, free, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, place, seat) AS rk FROM o1),
q AS (SELECT s9.k, s9.ss, s9.target, s9.b, s9.low + COALESCE(won, 0) AS quota FROM s9
  LEFT JOIN (SELECT k, count(*) AS won FROM o2 WHERE rk <= free GROUP BY k) USING (k)),
p1 AS (SELECT g.k, g.sh, g.sh // {SHARDS_PER_ROW} AS rw, g.gs, q.ss, q.target, q.b, q.quota AS source_quota, ((g.gs + q.b - 1) // q.b) AS nb FROM g JOIN q USING (k)),
v1 AS (SELECT k, rw, ss, source_quota, sum(gs)::BIGINT AS gs, sum(nb)::BIGINT AS nb FROM p1 GROUP BY ALL),
v2 AS (SELECT *, COALESCE((source_quota * gs)::DOUBLE / ss, 0) AS share, count(*) OVER (PARTITION BY k) AS claims FROM v1),
v3 AS (SELECT *, floor(share * claims / (2 * greatest(source_quota, 1)))::BIGINT + 2 AS slack FROM v2),
v4 AS (SELECT *, least(greatest(0, floor(share)::BIGINT - slack), {MAX_EPOCHS} * nb) AS low, least(floor(share)::BIGINT + slack + 1, {MAX_EPOCHS} * nb) AS high FROM v3),
v5 AS (SELECT *, source_quota - sum(low) OVER (PARTITION BY k) AS free FROM v4),
v6 AS (SELECT k, rw, gs, free, unnest(range(low, high)) AS seat FROM v5),
v7 AS (SELECT k, rw, free, row_number() OVER (PARTITION BY k ORDER BY gs / (2 * seat + 1) DESC, rw, seat) AS rk FROM v6),
v AS (SELECT v5.k, v5.rw, v5.gs AS rs, (v5.low + COALESCE(won, 0))::BIGINT AS quota FROM v5 LEFT JOIN (SELECT k, rw, count(*) AS won FROM v7 WHERE rk <= free GROUP BY k, rw) USING (k, rw)),
p2 AS (SELECT p1.*, v.quota, COALESCE((v.quota * p1.gs)::DOUBLE / v.rs, 0) AS share, count(*) OVER (PARTITION BY p1.k, p1.rw) AS claims FROM p1 JOIN v USING (k, rw)),
p3 AS (SELECT *, floor(share * claims / (2 * greatest(quota, 1)))::BIGINT + 2 AS slack FROM p2),
p4 AS (SELECT *, least(greatest(0, floor(share)::BIGINT - slack), {MAX_EPOCHS} * nb) AS low, least(floor(share)::BIGINT + slack + 1, {MAX_EPOCHS} * nb) AS high FROM p3),
p5 AS (SELECT *, quota - sum(low) OVER (PARTITION BY k, rw) AS free FROM p4),
o3 AS (SELECT k, rw, sh, gs, free, unnest(range(low, high)) AS seat FROM p5),
o4 AS (SELECT k, sh, free, row_number() OVER (PARTITION BY k, rw ORDER BY gs / (2 * seat + 1) DESC, sh, seat) AS rk FROM o3),
p AS (SELECT p5.k, p5.sh, p5.ss, p5.target, p5.b, p5.nb, (p5.low + COALESCE(won, 0))::BIGINT AS quota,
    ('0x' || substr(md5('{SEED}:' || p5.k || ':' || p5.sh), 1, 15))::BIGINT % greatest(p5.nb, 1) AS o
  FROM p5 LEFT JOIN (SELECT k, sh, count(*) AS won FROM o4 WHERE rk <= free GROUP BY k, sh) USING (k, sh)),
l AS (SELECT r.doc_id, r.size, p.*, greatest(nb, 1) AS n1, quota % greatest(nb, 1) AS m,
    (sum(r.size) OVER (PARTITION BY r.k, r.sh ORDER BY h, r.doc_id, r.size ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM r JOIN p ON r.k = p.k AND r.sh = p.sh),
t AS (SELECT *, e - size AS s,
    ((e // b) * m + o) // n1 * b + CASE WHEN ((e // b + 1) * m + o) // n1 > ((e // b) * m + o) // n1 THEN e % b ELSE 0 END AS te,
    (((e - size) // b) * m + o) // n1 * b
      + CASE WHEN (((e - size) // b + 1) * m + o) // n1 > (((e - size) // b) * m + o) // n1 THEN (e - size) % b ELSE 0 END AS ts FROM l)
SELECT doc_id, size, ss AS source_size, target, (CASE WHEN nb > 0 THEN quota // n1 ELSE 0 END * size + te - ts)::BIGINT AS taken FROM t
"""


ORACLE_SQL = oracle_sql()
