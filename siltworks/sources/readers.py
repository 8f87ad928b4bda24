"""Sources: logs, tables, JSON, pairs, repositories. Text and bytes are opened by Spark's readers on the executors."""

from __future__ import annotations

import json
import os
import subprocess
import tomllib
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import masked_path, matches_any_glob, safe_relative_path
from siltworks.operators.scans import first_fit

# What counts as a log, folders that are never walked, names that are never shown.
LOG_SUFFIXES = (".log", ".txt", ".out", ".json", ".jsonl")
PRUNED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist")
SENSITIVE = ("*.pem", "*.key", ".env", ".env.*", "id_rsa*", "*.p12", "*secret*", "*credential*")
MOST_FILES, MOST_FILE_BYTES, MOST_TOTAL_BYTES = 5000, 1_000_000, 100_000_000


def read_logs(spark: SparkSession, path: str, adapter: str) -> DataFrame:
    """(doc_id, adapter, raw), a row per file with an allowed suffix; blank files are left out."""
    globs = ",".join(s.lstrip(".") for s in LOG_SUFFIXES)
    rows = spark.read.option("pathGlobFilter", "*.{" + globs + "}").text(path, wholetext=True)
    return rows.where(F.col("value").rlike(r"\S")).select(F.col("_metadata.file_path").alias("doc_id"), F.lit(adapter).alias("adapter"), F.col("value").alias("raw"))


def select_source(command: Sequence[str] | None, path: str | None, stdin: str | None) -> tuple[str, object]:
    """What a run reads: a command before a file before standard input. Other suffixes and blank input are refused."""
    if command:
        return "command", list(command)
    if path:
        if os.path.splitext(path)[1] not in LOG_SUFFIXES:
            raise ValueError(f"not a log: {path}")
        return "file", path
    if not stdin or not stdin.strip():
        raise ValueError("no input")
    return "stdin", stdin


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All CSV files of a path, columns by header; types are inferred only without a schema."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(name, description) from lines that have a closing bracket and an en dash between spaces."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(")")) & F.contains("value", F.lit(" – ")))
    parts = F.split("value", " – ", 2)
    return lines.select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("description"))


def read_html_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, before, after) of files whose names differ in _before and _after."""
    from siltworks.operators.joining import pair_files

    rows = spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return pair_files(rows, "name", "text")


def read_text_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("cell"))


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size_bytes, content) for files below root, pruned folders left out. Bytes are read on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = files.select(F.regexp_replace("path", "^file:/+", "/").alias("p"), F.col("length").alias("size_bytes"), "content")
    relative = base.withColumn("relative_path", F.expr(f"substring(p, {len(root.rstrip('/')) + 2})"))
    folders = F.slice(F.split("relative_path", "/"), F.lit(1), F.greatest(F.size(F.split("relative_path", "/")) - 1, F.lit(0)))
    return relative.where(~F.arrays_overlap(folders, F.array(*map(F.lit, PRUNED)))).select("relative_path", "size_bytes", "content")


def git_files(root: str) -> list[str]:
    """Tracked and unignored files of a working tree; names that leave it are dropped."""
    out = subprocess.run(["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"], capture_output=True, check=True)
    names = [n for n in out.stdout.decode("utf-8", "replace").split("\0") if n]
    return sorted(n for n in names if not n.startswith("/") and ".." not in n.split("/"))


def inspect_candidates(files: DataFrame, excludes: Sequence[str] = ()) -> DataFrame:
    """files (relative_path, size_bytes, content) with content_hash and the first exclusion_reason that holds: unsafe-path, sensitive,
    configured, too-large, binary. Sensitive names are masked."""
    head = F.substring("content", 1, 8192)
    binary = (F.locate("\x00", F.decode(head, "ISO-8859-1")) > 0) | ~F.is_valid_utf8(F.col("content").cast("string"))
    path = F.col("relative_path")
    sensitive = matches_any_glob(path, SENSITIVE)
    reason = (
        F.when(~safe_relative_path(path), "unsafe-path")
        .when(sensitive, "sensitive")
        .when(matches_any_glob(path, excludes) if excludes else F.lit(False), "configured")
        .when(F.col("size_bytes") > MOST_FILE_BYTES, "too-large")
        .when(binary, "binary")
    )
    return files.select(F.when(sensitive, masked_path(path)).otherwise(path).alias("relative_path"), "size_bytes", F.sha2("content", 256).alias("content_hash"), reason.alias("exclusion_reason"))


def running_limits(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_TOTAL_BYTES) -> DataFrame:
    """Marks files, in order of path, that no longer fit a limit on count or bytes; one that is skipped uses up nothing."""
    columns = files.select("relative_path", "size_bytes", "exclusion_reason")
    fitted = first_fit(columns, ["relative_path"], "size_bytes", most_files, most_bytes, F.col("exclusion_reason").isNull())
    reason = F.coalesce("exclusion_reason", F.when(~F.col("fits"), "limit-reached"))
    return fitted.select("relative_path", "size_bytes", reason.alias("exclusion_reason"))


def list_examples(spark: SparkSession, path: str, adapter: str | None = None) -> DataFrame:
    """(adapter, name, path) of the *.log files under a folder per adapter, in order; files are listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path).select("path")
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("adapter"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path")
    return (rows.where(F.col("adapter") == adapter) if adapter else rows).orderBy("adapter", "name")


def read_config(path: str) -> dict:
    """A TOML or JSON settings file, read on the driver."""
    with open(path, "rb") as f:
        if path.endswith(".toml"):
            return tomllib.load(f)
        if path.endswith(".json"):
            return json.load(f)
    raise ValueError(f"{path} is neither TOML nor JSON")
