"""The log parser over lines synthesised from orders and their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import logs as L
from siltworks.plans.registry import query
from siltworks.session import table


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per order: META and TESTS from the order, an ERROR per returned item, a WARNING per large one, a TESTCASE per item."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    line = F.concat_ws(
        "\n",
        F.format_string("TESTCASE name=case%d status=%s duration=0.5", "l_linenumber", F.when(F.col("l_returnflag") == "R", "failed").otherwise("passed")),
        F.when(F.col("l_returnflag") == "R", F.format_string('ERROR message="returned token=t%d" file=src/m%d.py line=%d', "l_linenumber", "l_orderkey", "l_linenumber")),
        F.when(F.col("l_quantity") > 45, F.format_string("WARNING large order %d", "l_linenumber")),
    )
    bodies = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda s: s["t"]), "\n").alias("body"))
    o = table(spark, sf_dir, "orders").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    adapter = F.element_at(F.array(*[F.lit(a[0]) for a in L.ADAPTERS]), (F.col("o_orderkey") % len(L.ADAPTERS) + 1).cast("int"))
    meta = F.when(F.col("o_orderkey") % 4 != 0, F.format_string('META command="run %d" status=%s extra=e%d', "o_orderkey", F.when(F.col("o_orderstatus") == "P", "passed").otherwise("done"), "o_custkey"))
    raw = F.concat_ws("\n", F.lit("# order"), meta, F.lit("TESTS passed=9 failed=0 skipped=1 duration=2.5"), F.col("body"), F.lit("\nUNKNOWN token"), F.lit("ARTIFACT out/a.xml"), F.lit("INFO zone=eu"))
    # The tables are small files of one partition each; logs that are read from many files need no such step.
    return o.select(F.col("o_orderkey").alias("doc_id"), adapter.alias("adapter"), raw.alias("raw")).repartition(spark.sparkContext.defaultParallelism)


_ITEMS = """
i AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag <> 'R') AS p, count(*) FILTER (WHERE l_quantity > 45) AS w FROM lineitem GROUP BY 1),
a AS (SELECT unnest(range(8)) AS i, unnest(['ci', 'docker', 'dotnet', 'go', 'java', 'javascript', 'python', 'rust']) AS adapter, unnest(['ci', 'docker build', 'dotnet test', 'go test', 'maven', 'jest', 'pytest', 'cargo']) AS tool,
  unnest(['failed', 'failed', 'passed', 'passed', 'failed', 'passed', 'failed', 'passed']) AS st, unnest(['automation', 'dockerfile', 'csharp', 'go', 'java', 'javascript', 'python', 'rust']) AS language),
o AS (SELECT o_orderkey AS doc_id, a.*, o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderstatus = 'P' THEN 'passed' ELSE 'done' END ELSE st END AS status,
  COALESCE(r, 0) AS r, COALESCE(p, 0) AS p, COALESCE(w, 0) AS w FROM orders JOIN a ON o_orderkey % 8 = a.i LEFT JOIN i ON o_orderkey = l_orderkey)"""


@query(f"""
WITH {_ITEMS} SELECT doc_id, tool, adapter AS ecosystem, CASE WHEN doc_id % 4 <> 0 THEN 'run ' || doc_id ELSE '' END AS command, status, r::INT AS n_errors, w::INT AS n_warnings,
  CASE WHEN p > 0 THEN p ELSE 9 END::INT AS passed, r::INT AS failed, 1 AS skipped, (r + p)::INT AS n_cases, language, CASE WHEN doc_id % 4 <> 0 THEN 'e' || o_custkey END AS extra, 'eu' AS zone, 'out/a.xml' AS artifact,
  CASE WHEN status = 'failed' OR r > 0 THEN 'error' WHEN w > 0 THEN 'warning' ELSE 'ok' END AS severity FROM o""")
def parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = L.parse_logs(order_logs(spark, sf_dir))
    return parsed.select(
        "doc_id", "tool", "ecosystem", "command", "status", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), F.col("tests.passed").alias("passed"), F.col("tests.failed").alias("failed"),
        F.col("tests.skipped").alias("skipped"), F.size("tests.cases").alias("n_cases"), F.col("metadata.language").alias("language"), F.col("metadata.extra").alias("extra"), F.col("metadata.zone").alias("zone"),
        F.col("artifacts")[0].alias("artifact"), L.severity().alias("severity"),
    )


@query(f"""
WITH {_ITEMS} SELECT doc_id, tool || ' [' || status || '] | No summary provided. | tests: ' || CASE WHEN p > 0 THEN p ELSE 9 END || ' passed, ' || r || ' failed, 1 skipped | errors: ' || r || ' | warnings: ' || w AS line FROM o""")
def log_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_logs(order_logs(spark, sf_dir)).select("doc_id", L.summary_line().alias("line"))


@query("""
SELECT l_orderkey AS doc_id, 'returned to[REDACTED]' AS message, 'src/m' || l_orderkey || '.py' AS file, l_linenumber::INT AS line FROM lineitem WHERE l_returnflag = 'R'""")
def redacted_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.redact_record(L.parse_logs(order_logs(spark, sf_dir)))
    return rows.select("doc_id", F.explode("errors").alias("e")).select("doc_id", "e.message", "e.file", "e.line")


@query()
def log_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: Markdown of the whole record; a test compares it with a written-out report."""
    rows = L.redact_record(L.parse_logs(order_logs(spark, sf_dir)))
    return L.report(rows, "markdown").select("doc_id", F.md5("report").alias("digest"), F.length("report").alias("n_chars"))


@query()
def log_json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: JSON text of the whole record."""
    rows = L.redact_record(L.parse_logs(order_logs(spark, sf_dir)))
    return L.report(rows, "json").select("doc_id", F.md5("report").alias("digest"))


@query(f"WITH {_ITEMS} SELECT adapter, count(*) AS n_docs, count(*) FILTER (WHERE status = 'failed' OR r > 0) AS n_error, sum(w)::BIGINT AS n_warnings FROM o GROUP BY adapter")
def adapter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.parse_logs(order_logs(spark, sf_dir)).withColumn("severity", L.severity())
    return rows.groupBy("adapter").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("severity") == "error").alias("n_error"), F.sum(F.size("warnings")).alias("n_warnings"))
