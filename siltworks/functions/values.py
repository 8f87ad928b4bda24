"""Numbers, arrays, digests and small decision rules as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def stable_digest(namespace: str, canonical: Column) -> Column:
    """sha256 of the namespace, a zero byte and the canonical JSON with its trailing newline."""
    return F.sha2(F.concat(F.lit(namespace), F.lit("\x00"), canonical, F.lit("\n")), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Fixed fields as JSON with sorted keys, no spaces, nulls kept. Values are strings, integers, booleans or arrays of them."""
    parts = []
    for name in sorted(fields):
        value = F.get_json_object(F.to_json(F.struct(fields[name].alias("v")), {"ignoreNullFields": "false"}), "$")
        body = F.regexp_replace(value, r'^\{"v":(?s)(.*)\}$', "$1")
        parts.append(F.concat(F.lit(f'"{name}":'), body))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


@F.pandas_udf(StringType())
def blake2s_hex(text: pd.Series) -> pd.Series:
    """BLAKE2s of the UTF-8 text; no built-in function has it."""
    return text.map(lambda t: None if t is None else hashlib.blake2s(t.encode()).hexdigest())


def threshold_severity(value: Column, threshold: Column) -> Column:
    return F.when(value > 2 * threshold, "high").when(value > 1.5 * threshold, "medium").otherwise("low")


def report_severity(status: Column, has_errors: Column, failed_tests: Column, has_warnings: Column) -> Column:
    """The first rule that applies: an error status, errors, failed tests; warnings or a warning status; else ok."""
    status = F.lower(F.trim(status))
    error = status.isin("failed", "error", "failure", "fatal") | has_errors | (F.coalesce(failed_tests, F.lit(0)) > 0)
    return F.when(error, "error").when(has_warnings | status.isin("warning", "warn"), "warning").otherwise("ok")


SEVERITY_RANK = {"ok": 0, "warning": 1, "error": 2}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[severity], F.lit(0))


def should_fail(severity: Column, fail_on: Column) -> Column:
    """Exit policy: never for "never", else from the named severity on."""
    return (fail_on != "never") & (severity_rank(severity) >= severity_rank(fail_on)) & (severity_rank(severity) > 0)


def metric_delta(before: Column, after: Column) -> Column:
    """absolute, direction and percent; not comparable where a side is missing or nothing moved, no percent from 0."""
    change = after - before
    direction = F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("not-comparable")
    return F.struct(change.alias("absolute"), direction.alias("direction"), (F.try_divide(change, before) * 100).alias("percent"))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """A Retry-After header as seconds from now: a number, or an HTTP date not before now."""
    at = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    wait = (F.unix_timestamp(at) - F.unix_timestamp(now)).cast("double")
    return F.coalesce(header.try_cast("double"), F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait)))


def to_sexagesimal(degrees: Column) -> Column:
    whole = F.floor(F.abs(degrees))
    minutes = F.floor((F.abs(degrees) - whole) * 60)
    seconds = ((F.abs(degrees) - whole) * 60 - minutes) * 60
    return F.struct((F.signum(degrees) * whole).cast("long").alias("degrees"), minutes.cast("long").alias("minutes"), seconds.alias("seconds"))


def from_sexagesimal(degrees: Column, minutes: Column, seconds: Column) -> Column:
    sign = F.when(degrees < 0, -1.0).otherwise(1.0)
    return sign * (F.abs(degrees) + minutes / 60 + seconds / 3600)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pipe_list(text: Column) -> Column:
    """Distinct parts between pipes, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.split(text, r"\|"), lambda p: F.trim(p))))


def label_entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def padded(ids: Column, length: int, fill: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), length)), 1, length)


def normalise_columns(rows: DataFrame, columns: list[str], eps: float = 1e-12) -> DataFrame:
    """Columns divided by their L2 norm; one with a norm below eps stays. Norms are one aggregate row."""
    norms = rows.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"norm_{c}") for c in columns])
    joined = rows.crossJoin(F.broadcast(norms))  # one row
    made = {c: F.when(F.col(f"norm_{c}") < eps, F.col(c)).otherwise(F.col(c) / F.col(f"norm_{c}")) for c in columns}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns])


def rolling_windows(rows: DataFrame, group: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Each full window of width values in order; no partial ones."""
    span = Window.partitionBy(*group).orderBy(*order).rowsBetween(0, width - 1)
    return rows.withColumn("window", F.collect_list(value).over(span)).where(F.size("window") == width)


def batched(rows: DataFrame, group: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Values in groups of size, in order; the last may be short."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    numbered = rows.withColumn("bt_pos", place).withColumn("batch", F.floor(F.col("bt_pos") / size).cast("long"))
    items = F.array_sort(F.collect_list(F.struct("bt_pos", F.col(value).alias("v"))))
    return numbered.groupBy(*group, "batch").agg(F.transform(items, lambda s: s["v"]).alias("items"))


def word_diff_ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: (key, before, after) to (key, ratio, differs) by difflib over words."""
    from difflib import SequenceMatcher

    for batch in batches:
        ratio = [SequenceMatcher(None, (b or "").split(), (a or "").split()).ratio() for b, a in zip(batch["before"], batch["after"], strict=True)]
        yield pd.DataFrame({"key": batch["key"], "ratio": ratio, "differs": [r < 0.96 for r in ratio]})


def local_time(seconds: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Unix seconds as time of a zone. Years beyond 9999 are written without the sign that Java puts before them."""
    return F.regexp_replace(F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), pattern), r"^\+", "")


def utc_stamp(ts: Column) -> Column:
    """A timestamp as UTC with milliseconds and Z, in a session whose zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def flat_metadata(fixed: dict[str, Column], extra: Column, last: dict[str, Column]) -> Column:
    """One map of strings: fixed fields, overlaid by extra ones, overlaid by the last."""
    made = [F.create_map(*[x for k, v in part.items() for x in (F.lit(k), v.cast("string"))]) for part in (fixed, last)]
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return over(over(made[0], F.coalesce(extra, F.create_map().cast("map<string,string>"))), made[1])
