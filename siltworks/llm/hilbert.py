"""Sharding along a Hilbert curve, so that files can be pruned by several metadata columns at once.

Each column is quantised to BITS bits (numbers on a logarithmic scale, strings by their place among the distinct ones), the
cells are numbered along the curve, rows are sorted by that number, and runs of equal row counts are cut off as shards. Rows of equal
text take the least place of them all, so copies from several sources stand together. Only metadata moves; texts stay where they are
until write_clustered deals them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.session import scratch, ship_package

SHARDS = 40
BITS = 10
ROW_BYTES = 16
#: Rows of one range of the order, and ranges at most (they grow beyond that).
ROWS_PER_TASK, MOST_TASKS = 250_000, 20_000
#: Parts into which the rows of one text are dealt when their common place is looked up.
SALTS = 32
#: Steps of the logarithmic scale for each doubling.
STEPS_PER_DOUBLING = 40


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of each row of cells (n x dims, below 2**bits), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & q, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def number_cell(value: Column, bits: int = BITS) -> Column:
    """A cell on a logarithmic scale; null and values below 1 are cell 0."""
    scaled = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(1.0))) * STEPS_PER_DOUBLING)
    return F.coalesce(F.least(scaled, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def with_string_cell(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """Adds the cell of a string column: its place among the distinct values in code point order, spread over the cells; null is before all."""
    values = df.select(column).distinct()
    order = Window.orderBy(F.col(column).asc_nulls_first())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(order) - 1) * (1 << bits) / F.count(F.lit(1)).over(whole)
    cells = values.select(F.col(column).alias("hc_value"), F.floor(place).cast("long").alias(out))
    return df.join(cells, F.col(column).eqNullSafe(F.col("hc_value")), "left").drop("hc_value")


def with_curve(df: DataFrame, cells: list[str], out: str = "curve", bits: int = BITS) -> DataFrame:
    """Adds the place along the curve of the given cell columns."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in cells], 1)
            index = curve_index(grid, bits) if len(grid) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index)], [*batch.schema.names, out])

    ship_package(df.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` long"
    return df.mapInArrow(number, schema)


def ranked(df: DataFrame, keys: list[str], n: int, out: str = "rank") -> DataFrame:
    """Adds the exact place (from 0) in the order of keys without a global window: ranges are sorted by themselves, and the counts of the ranges
    before (one number each) are added."""
    tasks = min(MOST_TASKS, max(1, -(-n // ROWS_PER_TASK)))
    local = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("rk_id", F.monotonically_increasing_id())
    local = scratch(local, "ranked")
    part, place = F.shiftright("rk_id", 33), F.col("rk_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = local.groupBy(part.alias("rk_part")).agg(F.count(F.lit(1)).alias("rk_n"))
    before = Window.orderBy("rk_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rk_part", F.coalesce(F.sum("rk_n").over(before), F.lit(0)).alias("rk_start"))
    joined = local.withColumn("rk_part", part).join(starts, "rk_part")
    return joined.withColumn(out, F.col("rk_start") + place).drop("rk_id", "rk_part", "rk_start")


def curve_order(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_key, curve) over lang, source and size, for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = scratch(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
            F.col("lang").cast("string").alias("m_lang"),
            F.col("source").cast("string").alias("m_source"),
        ),
        "metadata",
    )
    cells = with_string_cell(with_string_cell(meta, "m_lang", "c_lang"), "m_source", "c_source")
    cells = cells.withColumn("c_size", number_cell(F.col("size")))
    kept = ["doc_id", "size", "text_crc32", "text_key"]
    return with_curve(cells.select(*kept, "c_lang", "c_source", "c_size"), ["c_lang", "c_source", "c_size"]).select(*kept, "curve")


def one_place(rows: DataFrame, key: str = "text_key", place: str = "curve") -> DataFrame:
    """rows with place lowered to the least of all rows of the same key. Only keys with several places are looked up, their rows dealt over
    SALTS parts, so that a text that a third of all rows hold is no single group."""
    several = rows.groupBy(key).agg(F.min(place).alias("op_low"), F.max(place).alias("op_high")).where("op_low < op_high")
    salted = several.select(F.col(key).alias("op_key"), "op_low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("op_salt"))
    dealt = rows.withColumn("op_part", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, (F.col(key) == F.col("op_key")) & (F.col("op_part") == F.col("op_salt")), "left")
    return joined.select(*[c for c in rows.columns if c != place], F.coalesce("op_low", place).alias(place))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve): runs of the curve whose row counts differ by one at most.

    Equal texts are neighbours whatever their metadata (the order goes on by text, then doc_id), so only the shards - 1 cuts part any. Null texts
    have ROW_BYTES and the checksum of the empty text; null lang or source are before all others; repeated rows and rows of equal or null doc_id are
    separate, nulls first among their text. With fewer rows than shards some shards stay empty; an empty table gives no rows. Texts are read
    whole, however long. Other columns of docs are ignored, whatever their names.
    """
    n = docs.count()
    rows = scratch(curve_order(docs), "curve")
    rows = ranked(one_place(rows), ["curve", "text_crc32", "text_key", "doc_id", "size"], n)
    home = F.expr(f"CAST(rank * {shards}L DIV {max(n, 1)}L AS INT)")
    return rows.withColumn("shard", home).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"rank - (shard * {max(n, 1)}L + {shards - 1}L) DIV {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_clustered(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write docs along the curve, so that each file spans few languages, sources and sizes. Files are cut by ranges of the curve."""
    names = docs.columns
    held = docs.select(*[F.col(n).alias(f"d_{n}") for n in names])
    held = held.withColumn("m_lang", F.col("d_lang").cast("string")).withColumn("m_source", F.col("d_source").cast("string"))
    held = with_string_cell(with_string_cell(held, "m_lang", "c_lang"), "m_source", "c_source")
    held = with_curve(held.withColumn("c_size", number_cell(F.octet_length("d_text"))), ["c_lang", "c_source", "c_size"])
    ranged = held.repartitionByRange(shards, "curve", "d_doc_id").sortWithinPartitions("curve", "d_doc_id")
    ranged.select(*[F.col(f"d_{n}").alias(n) for n in names]).write.mode("overwrite").parquet(path)
