"""Structured logs to nested records: one row per document in and out, no shuffle.

A document's lines become an array that higher-order functions fold, so parsing needs neither an explode nor a regroup.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import DEFAULT_REDACTIONS, key_values, redact
from siltworks.functions.values import report_severity

# Adapter id, tool, default status, language.
ADAPTERS = (
    ("ci", "ci", "failed", "automation"),
    ("docker", "docker build", "failed", "dockerfile"),
    ("dotnet", "dotnet test", "passed", "csharp"),
    ("go", "go test", "passed", "go"),
    ("java", "maven", "failed", "java"),
    ("javascript", "jest", "passed", "javascript"),
    ("python", "pytest", "failed", "python"),
    ("rust", "cargo", "passed", "rust"),
)
META_KEYS = ("tool", "ecosystem", "command", "status", "summary", "timestamp")
NO_SUMMARY = "No summary provided."


def adapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ADAPTERS), "adapter string, default_tool string, default_status string, language string")


def log_lines(raw: Column) -> Column:
    """Array of (token, payload, kv) for lines that are neither blank nor comments. The token ends at the first space only."""
    lines = F.transform(F.split(raw, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))
    kept = F.filter(lines, lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    split = F.transform(
        kept,
        lambda x: F.struct(
            F.upper(F.substring_index(x, " ", 1)).alias("token"),
            F.trim(F.substring(x, F.length(F.substring_index(x, " ", 1)) + 2, F.length(x))).alias("payload"),
        ),
    )
    return F.transform(split, lambda s: F.struct(s["token"].alias("token"), s["payload"].alias("payload"), key_values(s["payload"]).alias("kv")))


def _of(lines: Column, token: str) -> Column:
    return F.filter(lines, lambda x: x["token"] == token)


def _last_value(lines: Column, key: str) -> Column:
    given = F.filter(lines, lambda x: F.map_contains_key(x["kv"], key))
    return F.try_element_at(F.transform(given, lambda x: x["kv"][key]), F.lit(-1))


def _issues(lines: Column, token: str) -> Column:
    return F.transform(
        _of(lines, token),
        lambda x: F.struct(
            F.coalesce(x["kv"]["message"], x["payload"]).alias("message"),
            x["kv"]["file"].alias("file"),
            x["kv"]["line"].try_cast("int").alias("line"),
            F.lit(None).cast("int").alias("column"),
            x["kv"]["code"].alias("code"),
        ),
    )


def _bad_number(x: Column, key: str, kind: str) -> Column:
    return F.map_contains_key(x["kv"], key) & x["kv"][key].try_cast(kind).isNull()


def parse_logs(logs: DataFrame, raw: str = "raw", adapter: str = "adapter") -> DataFrame:
    """The other columns of logs plus the normalized record, with reject_reason where a number cannot be read (the record is kept)."""
    known = logs.join(F.broadcast(adapters(logs.sparkSession)), adapter, "left")
    rows = known.withColumn("lg", log_lines(F.coalesce(F.col(raw), F.lit(""))))
    lines = F.col("lg")
    rows, meta = rows.withColumn("lg_meta", _of(lines, "META")), F.col("lg_meta")  # read for each of its keys
    at = F.expr("size(lg) - coalesce(array_position(transform(reverse(lg), x -> x.token), 'TESTS'), 0) + 1")
    rows = rows.withColumn("lg_tests_at", F.when(F.exists(lines, lambda x: x["token"] == "TESTS"), at).otherwise(0))
    later = F.filter(lines, lambda x, i: (x["token"] == "TESTCASE") & (i + 1 > F.col("lg_tests_at")))
    rows = rows.withColumn("lg_cases", later)
    cases = F.transform(
        F.col("lg_cases"),
        lambda x: F.struct(
            F.coalesce(x["kv"]["name"], F.lit("unknown")).alias("name"),
            F.coalesce(x["kv"]["status"], F.lit("unknown")).alias("status"),
            x["kv"]["duration"].try_cast("double").alias("duration"),
            x["kv"]["message"].alias("message"),
        ),
    )
    declared = F.try_element_at(_of(lines, "TESTS"), F.lit(-1))["kv"]

    def count(status: str) -> Column:
        n = F.size(F.filter(F.col("lg_cases"), lambda x: F.lower(x["kv"]["status"]) == status))
        return F.when(n > 0, n).otherwise(F.coalesce(declared[status].try_cast("int"), F.lit(0)))

    has_tests = (F.col("lg_tests_at") > 0) | (F.size("lg_cases") > 0)
    tests = F.when(
        has_tests,
        F.struct(
            count("passed").alias("passed"), count("failed").alias("failed"), count("skipped").alias("skipped"), declared["duration"].try_cast("double").alias("duration"), cases.alias("cases")
        ),
    )
    extra = F.transform(meta, lambda x: F.map_filter(x["kv"], lambda k, _: ~k.isin(*META_KEYS)))
    info = F.transform(_of(lines, "INFO"), lambda x: x["kv"])
    stamp = _last_value(meta, "timestamp")
    bad_stamp = F.when(
        stamp.isNotNull() & F.to_timestamp_ntz(F.lit("2000-01-01")).isNotNull() & F.try_to_timestamp(stamp).isNull(), F.create_map(F.lit("timestamp_parse_error"), stamp)
    )
    empty = F.create_map().cast("map<string,string>")
    folded = F.aggregate(
        F.concat(F.array(F.create_map(F.lit("language"), F.col("language"))), extra, info, F.array(F.coalesce(bad_stamp, empty))),
        empty,
        lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m),
    )
    broken = F.exists(lines, lambda x: x["token"].isin("ERROR", "WARNING") & _bad_number(x, "line", "int"))
    broken = broken | F.exists(lines, lambda x: (x["token"] == "TESTS") & (_bad_number(x, "passed", "int") | _bad_number(x, "failed", "int") | _bad_number(x, "skipped", "int")))
    negative = F.coalesce(F.least(tests["passed"], tests["failed"], tests["skipped"]) < 0, F.lit(False))
    artifacts = F.transform(_of(lines, "ARTIFACT"), lambda x: F.coalesce(x["kv"]["path"], x["payload"]))
    status = F.coalesce(_last_value(meta, "status"), F.col("default_status"), F.lit("unknown"))
    return rows.select(
        *[c for c in logs.columns if c not in (raw,)],
        F.coalesce(_last_value(meta, "tool"), F.col("default_tool")).alias("tool"),
        F.coalesce(_last_value(meta, "ecosystem"), F.col(adapter)).alias("ecosystem"),
        F.coalesce(_last_value(meta, "command"), F.lit("")).alias("command"),
        status.alias("status"),
        F.coalesce(_last_value(meta, "summary"), F.lit(NO_SUMMARY)).alias("summary"),
        stamp.alias("timestamp"),
        _issues(lines, "ERROR").alias("errors"),
        _issues(lines, "WARNING").alias("warnings"),
        tests.alias("tests"),
        artifacts.alias("artifacts"),
        folded.alias("metadata"),
        F.when(broken, "unreadable number").when(negative, "negative count").alias("reject_reason"),
    )


def severity() -> Column:
    return report_severity(F.col("status"), F.size("errors") > 0, F.col("tests.failed"), F.size("warnings") > 0)


def summary_line() -> Column:
    """Tool, status, summary and counts in one line."""
    tests = F.when(F.col("tests").isNotNull(), F.format_string("tests: %d passed, %d failed, %d skipped", "tests.passed", "tests.failed", "tests.skipped"))
    return F.concat_ws(" | ", F.concat(F.col("tool"), F.lit(" ["), F.col("status"), F.lit("]")), F.col("summary"), tests, F.format_string("errors: %d", F.size("errors")), F.format_string("warnings: %d", F.size("warnings")))


def explanation() -> Column:
    """Lines of what the record holds; a missing file or line reads None."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

    def issues(name: str, column: str) -> Column:
        body = F.transform(F.col(column), lambda x: F.concat(F.lit("  - "), x["message"], F.lit(" ("), none(x["file"]), F.lit(":"), none(x["line"]), F.lit(")")))
        return F.when(F.size(column) > 0, F.concat(F.array(F.lit(f"{name}:")), body)).otherwise(F.array().cast("array<string>"))

    head = F.array(*[F.concat(F.lit(f"{n}: "), F.col(c)) for n, c in (("Tool", "tool"), ("Ecosystem", "ecosystem"), ("Status", "status"), ("Summary", "summary"))])
    tests = F.when(
        F.col("tests").isNotNull(), F.array(F.format_string("Tests: passed=%d failed=%d skipped=%d", "tests.passed", "tests.failed", "tests.skipped"))
    ).otherwise(F.array().cast("array<string>"))
    files = F.when(F.size("artifacts") > 0, F.concat(F.array(F.lit("Artifacts:")), F.transform("artifacts", lambda a: F.concat(F.lit("  - "), a)))).otherwise(F.array().cast("array<string>"))
    meta = F.transform(F.map_entries("metadata"), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"]))
    more = F.when(F.size("metadata") > 0, F.concat(F.array(F.lit("Metadata:")), meta)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, tests, issues("Errors", "errors"), issues("Warnings", "warnings"), files, more), "\n")


def redact_record(rows: DataFrame, patterns: Sequence[str] = DEFAULT_REDACTIONS) -> DataFrame:
    """Every text of the record is redacted, nested ones and metadata values too; keys, numbers and the timestamp are not."""
    clean = lambda c: redact(c, patterns)
    issue = lambda x: F.struct(clean(x["message"]).alias("message"), clean(x["file"]).alias("file"), x["line"].alias("line"), x["column"].alias("column"), clean(x["code"]).alias("code"))
    case = lambda x: F.struct(clean(x["name"]).alias("name"), clean(x["status"]).alias("status"), x["duration"].alias("duration"), clean(x["message"]).alias("message"))
    made = {c: clean(F.col(c)) for c in ("tool", "ecosystem", "command", "status", "summary")}
    made |= {c: F.transform(c, issue) for c in ("errors", "warnings")}
    made["tests"] = F.when(F.col("tests").isNotNull(), F.col("tests").withField("cases", F.transform("tests.cases", case)))
    made["artifacts"] = F.transform("artifacts", clean)
    made["metadata"] = F.transform_values("metadata", lambda _, v: clean(v))
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in rows.columns])


def _issue_line(x: Column) -> Column:
    place = F.concat_ws(":", x["file"], x["line"].cast("string"), x["column"].cast("string"))
    return F.concat(F.lit("- "), x["message"], F.when(x["code"].isNotNull(), F.concat(F.lit(" ["), x["code"], F.lit("]"))).otherwise(""), F.when(x["file"].isNotNull(), F.concat(F.lit(" ("), place, F.lit(")"))).otherwise(""))


def markdown_report(guardrails: Mapping[str, object] | None = None, generated: Column | None = None) -> Column:
    """The record as Markdown: title and facts (with the time of the report, if it is given), then seven sections apart by blank lines."""
    def section(title: str, *body: Column) -> Column:
        return F.concat_ws("\n\n", F.lit(f"## {title}"), *body)

    issues = F.when((F.size("errors") == 0) & (F.size("warnings") == 0), F.lit("No issues were reported by this adapter.")).otherwise(
        F.concat_ws(
            "\n\n",
            F.when(F.size("errors") > 0, F.concat(F.lit("### Errors\n\n"), F.array_join(F.transform("errors", _issue_line), "\n"))),
            F.when(F.size("warnings") > 0, F.concat(F.lit("### Warnings\n\n"), F.array_join(F.transform("warnings", _issue_line), "\n"))),
        )
    )
    said = lambda c: F.when(F.length(F.coalesce(c["message"], F.lit(""))) > 0, F.concat(F.lit(": "), c["message"])).otherwise("")
    took = lambda c: F.when(c["duration"].isNotNull(), F.format_string(" (%.2fs)", c["duration"])).otherwise("")
    case = lambda c: F.concat(F.lit("- "), c["name"], F.lit(" — "), c["status"], took(c), said(c))
    tests = F.when(F.col("tests").isNull(), F.lit("No test results were provided.")).otherwise(
        F.concat_ws(
            "\n\n",
            F.lit("### Summary"),
            F.concat_ws(
                "\n",
                F.format_string("- Passed: %d", "tests.passed"),
                F.format_string("- Failed: %d", "tests.failed"),
                F.format_string("- Skipped: %d", "tests.skipped"),
                F.when(F.col("tests.duration").isNotNull(), F.format_string("- Duration: %.2fs", "tests.duration")),
            ),
            F.lit("### Cases"),
            F.when(F.size("tests.cases") > 0, F.array_join(F.transform("tests.cases", case), "\n")).otherwise("No individual test cases were reported."),
        )
    )
    files = F.when(F.size("artifacts") > 0, F.array_join(F.transform("artifacts", lambda a: F.concat(F.lit("  - "), a)), "\n")).otherwise("No artifacts recorded.")
    meta = F.when(
        F.size("metadata") > 0, F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    ).otherwise("No additional metadata captured.")
    head = F.concat(F.lit("# "), F.col("tool"), F.lit(" Report\n\n- **Ecosystem:** "), F.col("ecosystem"), F.lit("\n- **Command:** `"), F.col("command"), F.lit("`\n- **Status:** "), F.col("status"), F.lit("\n- **Severity:** "), severity())
    if generated is not None:
        head = F.concat(head, F.lit("\n- **Generated:** "), generated)
    rails = [f"- {k}: {', '.join(map(str, v)) if isinstance(v, list | tuple) else v}" for k, v in sorted((guardrails or {}).items())]
    guards = F.lit("\n".join(rails) or "No guardrail configuration available.")
    return F.concat_ws("\n\n", head, section("Summary", F.col("summary")), section("Explanation", explanation()), section("Issues", issues), section("Tests", tests), section("Guardrails", guards), section("Artifacts", files), section("Metadata", meta))


def json_report() -> Column:
    """The record as JSON, fields in alphabetical order, nulls kept."""
    fields = sorted(("tool", "ecosystem", "command", "status", "summary", "timestamp", "errors", "warnings", "tests", "artifacts", "metadata"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


FORMATTERS = {"json": json_report, "markdown": markdown_report}


def report(rows: DataFrame, kind: str, **how: object) -> DataFrame:
    if kind not in FORMATTERS:
        raise ValueError(f"unknown report format: {kind}")
    return rows.withColumn("report", FORMATTERS[kind](**how))
