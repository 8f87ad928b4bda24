"""Running folds over an exact order, in ranges: no key and no order goes through one task.

Rows are cut into ranges of the order; each range folds its own rows, and what a key has before a range is carried in. Only the first key of a range can
have rows before it, so there are at most as many carried rows as ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions import frames
from siltworks.session import scratch


def in_ranges(rows: DataFrame, order: Sequence[str], rows_per_range: int | None = None) -> DataFrame:
    """A table of rows with sc_part and sc_at: (sc_part, sc_at) ascends in the order of columns order."""
    n = rows.count()
    tasks = min(frames.MOST_RANGES, max(1, -(-n // (rows_per_range or frames.ROWS_PER_RANGE))))
    local = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("sc_at", F.monotonically_increasing_id())
    return scratch(local.withColumn("sc_part", F.shiftright("sc_at", 33)), "ranges")


def folded(local: DataFrame, key: Sequence[str], last: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds, for rows of in_ranges(.., [*key, ...]), the last value that is not null (last) and the running sum (total) of expressions over each key, the
    row itself included. Null keys are one key; a sum over nothing but nulls is 0."""
    last, total = dict(last or {}), dict(total or {})
    local = local.withColumns({f"sc_{name}": e for name, e in {**last, **total}.items()})
    here = Window.partitionBy("sc_part", *key).orderBy("sc_at").rowsBetween(Window.unboundedPreceding, 0)
    ends = local.groupBy(*key, "sc_part").agg(
        *[F.max_by(f"sc_{n}", F.when(F.col(f"sc_{n}").isNotNull(), F.col("sc_at"))).alias(f"e_{n}") for n in last],
        *[F.coalesce(F.sum(f"sc_{n}"), F.lit(0)).alias(f"e_{n}") for n in total],
    )
    parts = Window.partitionBy(*key).orderBy("sc_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"c_{k}") for k in key],
        F.col("sc_part").alias("c_part"),
        F.lag("sc_part").over(parts).alias("c_before"),
        *[F.last(f"e_{n}", ignorenulls=True).over(before).alias(f"c_{n}") for n in last],
        *[F.sum(f"e_{n}").over(before).alias(f"c_{n}") for n in total],
    ).where("c_before IS NOT NULL")
    local = local.withColumns({n: F.last(f"sc_{n}", ignorenulls=True).over(here) for n in last} | {n: F.coalesce(F.sum(f"sc_{n}").over(here), F.lit(0)) for n in total})
    match = F.col("sc_part") == F.col("c_part")
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    joined = local.join(F.broadcast(carried), match, "left")  # at most one row per range
    put = {n: F.coalesce(n, f"c_{n}") for n in last} | {n: F.col(n) + F.coalesce(f"c_{n}", F.lit(0)) for n in total}
    gone = [c for c in joined.columns if c.startswith("c_") and c not in local.columns] + [f"sc_{n}" for n in (*last, *total)]
    return joined.withColumns(put).drop(*gone)


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str], last: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None, rows_per_range: int | None = None) -> DataFrame:
    """folded() over rows in the order of columns order within each key."""
    return folded(in_ranges(rows, [*key, *order], rows_per_range), key, last, total).drop("sc_part", "sc_at")


def first_fit(
    rows: DataFrame, order: Sequence[str], size: str, most_rows: int, most_total: int, eligible: Column | None = None, out: str = "fits", rows_per_range: int | None = None
) -> DataFrame:
    """rows with whether each is taken, by a taker that goes through them in order and takes what is eligible and still fits: at most most_rows rows and
    most_total of size together; a row that does not fit is passed over and uses up nothing. A null size is 0; sizes are not negative.

    What is taken depends on all that was taken before, but not beyond a phase: while more than half of the room r at its start is left, every row of at most
    r / 2 fits, so the room is r less a running sum, and the phase ends at the first larger row that fits, or where the sum reaches r / 2. Each
    phase halves the room, so there are at most about 60 of them, each one pass over the rows that could still fit; the driver holds its bounds.
    """
    if most_rows < 0 or most_total < 0:
        raise ValueError("limits are not negative")
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    local = in_ranges(rows.withColumns({"ff_ok": ok, "ff_size": F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))}), order, rows_per_range)
    phases: list[tuple[int, int | None, int]] = []
    start, room = -1, most_total
    while room:
        left = local.where(F.col("ff_ok") & (F.col("sc_at") > start) & (F.col("ff_size") <= room)).select("sc_part", "sc_at", "ff_size")
        small = F.col("ff_size") * 2 <= room
        summed = folded(left, [], total={"ff_sum": F.when(small, F.col("ff_size")).otherwise(0)})
        free = F.lit(room) - F.col("ff_sum")
        ends = summed.where(F.when(small, free * 2 <= room).otherwise(F.col("ff_size") <= free))
        end = ends.agg(F.min(F.struct("sc_at", F.when(small, free).otherwise(free - F.col("ff_size")).alias("free"))).alias("e")).first()["e"]
        phases.append((start, None if end is None else end["sc_at"], room))
        if end is None:
            break
        start, room = end["sc_at"], end["free"]
    else:
        phases.append((start, None, 0))
    taken = F.lit(False)
    for after, end, room in phases:
        inside, fits = F.col("sc_at") > after, F.col("ff_size") * 2 <= room
        if end is not None:
            inside, fits = inside & (F.col("sc_at") <= end), fits | (F.col("sc_at") == end)
        taken = taken | (inside & fits)
    marked = local.withColumn("ff_taken", F.col("ff_ok") & taken)
    numbered = folded(marked, [], total={"ff_n": F.col("ff_taken").cast("long")})
    return numbered.withColumn(out, F.col("ff_taken") & (F.col("ff_n") <= most_rows)).drop("sc_part", "sc_at", "ff_ok", "ff_size", "ff_taken", "ff_n")
