"""Structured Streaming forms of the stateful operators. Windowed analytics go beyond what the batch operators need and are extensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltworks.sources.sinks import path_exists

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped with the state."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def running_counters(events: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Totals by label set, for update mode."""
    return events.where(F.col(value) >= 0).groupBy(*labels).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def health_states(events: DataFrame, limit: int = 3) -> DataFrame:
    """(user_id, state, failures) after each batch: degraded after limit failures in a row, else healthy."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (in_row,) = state.get if state.exists else (0,)
        # A key's rows come in several chunks, in any order: times and marks of all of them are put in order first.
        rows = pd.concat([batch[["ts", "event_id", "failed"]] for batch in batches]).sort_values(["ts", "event_id"])
        failed = rows["failed"].to_numpy(dtype=bool)
        good = (~failed).nonzero()[0]
        in_row = int(len(failed) - 1 - good[-1]) if len(good) else in_row + len(failed)
        state.update((in_row,))
        yield pd.DataFrame({"user_id": [key[0]], "state": ["degraded" if in_row >= limit else "healthy"], "failures": [in_row]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, state string, failures int", "in_row int", "update", GroupStateTimeout.NoTimeout)


def latest_generation_sink(path: str, key: str, generation: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer for the rows of the highest generation of each key. Each batch adds only its own best rows, in a folder of its own, and a
    pointer row names the folder last; read_latest() takes the best over all folders. A batch that the pointer table holds already is not
    written again, and a folder without a pointer, left by a job that died, is written anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _pointers(spark, path)
        if done is not None and not done.where(F.col("batch") == batch_id).isEmpty():
            return
        best = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), generation).alias("r")).select("r.*")
        target = f"{path}/batch={batch_id}"
        best.write.mode("overwrite").parquet(target)
        spark.createDataFrame([(batch_id, target)], "batch long, target string").coalesce(1).write.mode("append").parquet(f"{path}/_pointer_table")

    return write


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    folder = f"{path}/_pointer_table"
    return spark.read.schema("batch long, target string").parquet(folder) if path_exists(spark, folder) else None


def read_latest(spark: SparkSession, path: str, key: str, generation: str) -> DataFrame | None:
    """The row of the highest generation of each key over all finished batches, the later batch's of equal ones; None before the first."""
    done = _pointers(spark, path)
    if done is None:
        return None
    # One short row per batch.
    targets = [r["target"] for r in done.orderBy("batch").collect()]
    rows = spark.read.option("basePath", path).parquet(*targets)
    best = F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), F.struct(generation, "batch"))
    return rows.groupBy(key).agg(best.alias("r")).select("r.*")
