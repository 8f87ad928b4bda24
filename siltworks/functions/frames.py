"""Whole-frame helpers: packing columns, uniting files, ranking without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.session import scratch

#: Rows of one range of an order, and ranges at most (they grow beyond that).
ROWS_PER_RANGE, MOST_RANGES = 250_000, 20_000


def ranked(rows: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Exact place (from 1) in the order of keys: ranges are sorted apart and shifted by the counts of the ranges before."""
    n = rows.count()
    local = rows.repartitionByRange(min(MOST_RANGES, max(1, -(-n // ROWS_PER_RANGE))), *keys).sortWithinPartitions(*keys)
    local = scratch(local.withColumn("rk", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("rk", 33)
    counts = local.groupBy(part.alias("rk_part")).agg(F.count(F.lit(1)).alias("rk_n"))
    before = Window.orderBy("rk_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("rk_part", F.coalesce(F.sum("rk_n").over(before), F.lit(0)).alias("rk_start"))
    joined = local.withColumn("rk_part", part).join(starts, "rk_part")
    return joined.withColumn(out, F.col("rk_start") + F.col("rk").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("rk", "rk_part", "rk_start")


def compact_columns(rows: DataFrame, order: str, columns: Sequence[str], place: str = "rn") -> DataFrame:
    """Each column's values that are not null, packed to the top in order."""
    tall = None
    for c in columns:
        one = ranked(rows.where(F.col(c).isNotNull()).select(order, F.col(c).alias("v")), [order], place).select(place, F.lit(c).alias("c"), "v")
        tall = one if tall is None else tall.unionByName(one)
    return tall.groupBy(place).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in columns])


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns aligned by name, nulls where a frame lacks one."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
