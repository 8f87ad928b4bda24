"""Counters, gauges, histograms, spans and health from sample rows. Every fold is combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.text import label_escape

# Upper bounds of the default histogram.
BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
HEALTH_RANK = {"ok": 0, "degraded": 1, "error": 2}


def counters(samples: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """Sums by labels; negative increments are refused, they go to n_rejected."""
    ok = F.col(value) >= 0
    return samples.groupBy(*labels).agg(F.sum(F.when(ok, F.col(value)).otherwise(0)).alias("total"), F.count_if(~ok).alias("n_rejected"))


def gauges(samples: DataFrame, labels: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last value set."""
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def gauge_deltas(samples: DataFrame, labels: Sequence[str], delta: Column) -> DataFrame:
    return samples.groupBy(*labels).agg(F.sum(delta).alias("value"))


def histogram(samples: DataFrame, labels: Sequence[str], value: str, buckets: Sequence[float] = BUCKETS, compat_double_cumulative: bool = False) -> DataFrame:
    """(labels, le, bucket_count, count): cumulative buckets. compat sums them up once more, as the service this replaces exported them."""
    counts = samples.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("count")
    )
    made = [F.col(f"b{i}") for i in range(len(buckets))]
    if compat_double_cumulative:
        for i in range(1, len(made)):
            made[i] = made[i - 1] + made[i]
    spread = F.array(*[F.struct(F.lit(float(b)).alias("le"), m.alias("bucket_count")) for b, m in zip(buckets, made, strict=True)])
    return counts.select(*labels, F.explode(spread).alias("b"), "count").select(*labels, "b.le", "b.bucket_count", "count")


def spans_summary(spans: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    return spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds), 4).alias("seconds"), F.max(seconds).alias("longest"))


def health(checks: DataFrame, group: Sequence[str], status: str) -> DataFrame:
    """Counts by status and the worst of them, by group."""
    rank = F.when(F.col(status) == "error", 2).when(F.col(status) == "degraded", 1).otherwise(0)
    worst = F.max(rank)
    return checks.groupBy(*group).agg(
        *[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in HEALTH_RANK],
        F.when(worst == 2, "error").when(worst == 1, "degraded").otherwise("ok").alias("worst"),
    )


def ring_buffer(events: DataFrame, order: Sequence[str], size: int = 200) -> DataFrame:
    """The last size events, oldest first. A top-k, not a sort of everything."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(size)


def last_events(events: DataFrame, key: Sequence[str], order: Sequence[str], size: int = 200) -> DataFrame:
    """The last size events of each key. Each task keeps only its own last ones of a key before the shuffle."""
    latest = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return events.withColumn("le_place", F.row_number().over(latest)).where(F.col("le_place") <= size).drop("le_place")


def prometheus_lines(name: str, help_text: str, kind: str, samples: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """Text exposition: HELP and TYPE, then a line per sample, in order of line."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), label_escape(F.coalesce(F.col(k).cast("string"), F.lit(""))), F.lit('"')) for k in sorted(labels)])
    lines = samples.select(F.lit(2).alias("part"), F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
    head = samples.sparkSession.createDataFrame([(0, f"# HELP {name} {help_text}"), (1, f"# TYPE {name} {kind}")], "part int, line string")
    return head.unionByName(lines)


def crawl_health(events: DataFrame, key: Sequence[str], order: Sequence[str], failed: Column, limit: int = 1) -> DataFrame:
    """State after each event: degraded after limit failures in a row (one that is final is enough), healthy after a success, running before either."""
    line = Window.partitionBy(*key).orderBy(*order)
    since = F.sum(F.when(failed, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("ch_failed", failed).withColumn("ch_since", since)
    in_row = F.sum(F.col("ch_failed").cast("int")).over(Window.partitionBy(*key, "ch_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("ch_row") >= limit, "degraded").when(F.col("ch_since") > 0, "healthy").otherwise("running")
    return rows.withColumn("ch_row", in_row).withColumn("state", state).drop("ch_failed", "ch_since", "ch_row")
