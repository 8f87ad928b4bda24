"""Sinks: tables by Spark's commit protocol, small reports by an atomic rename on the driver."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import matches_any_glob


def write_atomically(path: str, data: str | bytes) -> None:
    """A report file that is there whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    if os.path.isdir(path):
        raise ValueError(f"{path} is a folder")
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data.encode() if isinstance(data, str) else data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_snapshot(sections: Mapping[str, DataFrame], path: str, snapshot_id: str) -> DataFrame:
    """Each section under its own folder, partitioned by snapshot; the manifest row is written last, so readers that start from manifests never see a
    partial snapshot. A snapshot that has a manifest already is left as it is."""
    spark = next(iter(sections.values())).sparkSession
    done = read_manifests(spark, path)
    if not done.where(F.col("snapshot_id") == snapshot_id).isEmpty():
        return done
    for name, rows in sections.items():
        rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{path}/{name}")
    row = spark.createDataFrame([(snapshot_id, sorted(sections))], "snapshot_id string, sections array<string>")
    row.coalesce(1).write.mode("append").parquet(f"{path}/_manifests_table")
    return read_manifests(spark, path)


def path_exists(spark, path: str) -> bool:  # noqa: ANN001
    """Whether there is anything at a path of any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_manifests(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Finished snapshots; none where no manifest was ever written. A folder that is there and cannot be read is an error."""
    shape = "snapshot_id string, sections array<string>"
    folder = f"{path}/_manifests_table"
    return spark.read.schema(shape).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], shape)


def read_section(spark, path: str, name: str, snapshot_id: str) -> DataFrame:  # noqa: ANN001
    """One section of a finished snapshot; the partition filter prunes the others."""
    if read_manifests(spark, path).where(F.col("snapshot_id") == snapshot_id).isEmpty():
        raise ValueError(f"no snapshot {snapshot_id}")
    return spark.read.parquet(f"{path}/{name}").where(F.col("snapshot_id") == snapshot_id)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True)


def write_pages(pages: DataFrame, path: str, key: str, text: str, metadata: Sequence[str]) -> None:
    """Texts and metadata of crawled pages as two tables."""
    pages.select(key, text).write.mode("overwrite").parquet(f"{path}/text")
    pages.select(key, *metadata).write.mode("overwrite").json(f"{path}/metadata")


def write_html_pairs(pairs: DataFrame, path: str) -> None:
    """pairs (key, before, after) as a table of named files."""
    files = F.explode(F.array(F.struct(F.concat("key", F.lit("_before.html")).alias("name"), F.col("before").alias("text")), F.struct(F.concat("key", F.lit("_after.html")).alias("name"), F.col("after").alias("text"))))
    pairs.select(files.alias("f")).select("f.*").write.mode("overwrite").json(path)


def bundle(files: DataFrame, group: str, path: str = "relative_path", text: str = "text", ignore: Sequence[str] = ()) -> DataFrame:
    """(group, content): files of a group under each other with their names, in order, ignored ones left out."""
    kept = files.where(~matches_any_glob(F.col(path), ignore)) if ignore else files
    parts = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(text).alias("t"))))
    rows = kept.groupBy(group).agg(parts.alias("parts"))
    return rows.select(group, F.array_join(F.transform("parts", lambda s: F.concat(F.lit("# File: "), s["p"], F.lit("\n"), s["t"])), "\n\n").alias("content"))
