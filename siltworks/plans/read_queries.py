"""Filters, search, sorting, pages, facets and summaries. Parts stand for symbols, orders for findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.operators import paging as P
from siltworks.plans.registry import query
from siltworks.session import table

_FAMILIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")
#: Orders as findings: severity, confidence and family from their columns.
_FINDINGS = """
f AS (SELECT o_orderkey AS finding_id, o_custkey AS subject_id, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
  CASE o_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE o_orderkey % 5 WHEN 0 THEN 'dependency-cycle' WHEN 1 THEN 'complexity' WHEN 2 THEN 'nesting' WHEN 3 THEN 'documentation' ELSE 'orphan-candidate' END AS family,
  CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'active' END AS state, CASE o_custkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'dismissed' ELSE 'planned' END AS review FROM orders)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(column: str, *values: str):
        n = F.col(column) % len(values)
        out = F.lit(values[-1])
        for i, v in reversed(list(enumerate(values[:-1]))):
            out = F.when(n == i, v).otherwise(out)
        return out

    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("finding_id"),
        F.col("o_custkey").alias("subject_id"),
        pick("o_orderkey", "high", "medium", "low").alias("severity"),
        pick("o_custkey", "high", "medium", "low").alias("confidence"),
        pick("o_orderkey", "dependency-cycle", "complexity", "nesting", "documentation", "orphan-candidate").alias("family"),
        F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("active").alias("state"),
        pick("o_custkey", "new", "confirmed", "dismissed", "planned").alias("review"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' AND p_type = 'SMALL'")
def equality_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(P.equals({"p_brand": "Brand#13", "p_type": "SMALL", "p_size": None})).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red w') OR contains(lower(p_type), 'e_o') OR contains(lower(p_type), 'omo')")
def escaped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = P.like_anywhere(["p_name"], "RED W") | P.like_anywhere(["p_type"], "e_o") | P.like_anywhere(["p_name", "p_type"], "omo")
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_name", "p_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def bounded_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(P.one_of("o_custkey", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_type, p_brand FROM part ORDER BY lower(p_type), p_partkey LIMIT 50 OFFSET 50")
def symbol_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = P.ordering("type", "asc", {"type": P.no_case("p_type"), "brand": P.no_case("p_brand")}, "p_partkey")
    return P.page(table(spark, sf_dir, "part"), order, 2, 50).select("p_partkey", "p_type", "p_brand")


@query(f"WITH {_FINDINGS} SELECT finding_id, severity, family FROM f ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END DESC, finding_id LIMIT 100")
def finding_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = P.ordering("severity", "desc", {"severity": P.severity_rank(F.col("severity"))}, "finding_id")
    return P.page(findings(spark, sf_dir), order, 1, 100).select("finding_id", "severity", "family")


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY lower(c_mktsegment) DESC, c_custkey DESC LIMIT 40")
def comparison_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = P.ordering("label", "desc", {"label": F.lower("c_mktsegment")}, "c_custkey", flip_tie=True)
    return P.page(table(spark, sf_dir, "customer"), order, 1, 40, 100).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey, true AS truncated FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def truncated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.truncated_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey").desc()], 50)


@query(f"WITH {_FINDINGS} SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'high') AS matching FROM f WHERE state = 'active'")
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).where("state = 'active'").agg(F.count(F.lit(1)).alias("total"), P.flagged_sum(F.col("severity") == "high").alias("matching"))


@query("SELECT p_type AS value, count(*) AS n FROM part WHERE p_type <> '' GROUP BY p_type")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.facet(table(spark, sf_dir, "part"), "p_type")


@query("SELECT DISTINCT p_brand AS value FROM part ORDER BY lower(p_brand), p_brand")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("value")).distinct().orderBy(P.no_case("value"), "value")


@query("SELECT d.value, count(o_orderkey) AS n FROM (VALUES " + ", ".join(f"('{f}')" for f in _FAMILIES) + ") d(value) LEFT JOIN orders ON o_orderpriority = d.value GROUP BY d.value")
def zero_filled_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.histogram_over(table(spark, sf_dir, "orders"), "o_orderpriority", _FAMILIES)


@query(f"""
WITH {_FINDINGS} SELECT count(*) FILTER (WHERE state = 'active') AS n_active, count(*) FILTER (WHERE state = 'resolved') AS n_resolved,
  count(*) FILTER (WHERE state = 'active' AND review = 'new') AS n_new, count(*) FILTER (WHERE state = 'active' AND review = 'dismissed') AS n_dismissed,
  count(*) FILTER (WHERE severity = 'high') AS n_high, count(*) FILTER (WHERE confidence = 'low') AS n_low_confidence FROM f""")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.col("state") == "active"
    return findings(spark, sf_dir).agg(
        P.flagged_sum(active).alias("n_active"),
        P.flagged_sum(~active).alias("n_resolved"),
        P.flagged_sum(active & (F.col("review") == "new")).alias("n_new"),
        P.flagged_sum(active & (F.col("review") == "dismissed")).alias("n_dismissed"),
        P.flagged_sum(F.col("severity") == "high").alias("n_high"),
        P.flagged_sum(F.col("confidence") == "low").alias("n_low_confidence"),
    )


@query(f"WITH {_FINDINGS} SELECT CASE WHEN state = 'resolved' THEN 'resolved' ELSE review END AS status, count(*) AS n FROM f GROUP BY 1")
def derived_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(P.derived_status(F.col("state"), F.col("review")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_FINDINGS} SELECT finding_id FROM f WHERE family = 'dependency-cycle' OR (family IN ('complexity', 'nesting') AND severity IN ('high', 'medium') AND confidence IN ('high', 'medium'))""")
def high_signal_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = P.high_signal(F.col("family"), F.col("severity"), F.col("confidence"), ("complexity", "nesting"))
    return findings(spark, sf_dir).where(keep).select("finding_id")


@query("SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE 'pending' END AS phase FROM orders")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "final").otherwise("pending")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", phase.alias("phase"))


@query("""
WITH t AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n_groups, COALESCE(max(n), 0) AS largest, sum(k)::BIGINT AS n_members FROM t""")
def two_level_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.sum("k").alias("n_members"))


@query("""
SELECT rn, max(a) AS a, max(b) AS b FROM (
  SELECT row_number() OVER (ORDER BY p_partkey) AS rn, p_partkey AS a, NULL::BIGINT AS b FROM part WHERE p_size > 25
  UNION ALL SELECT row_number() OVER (ORDER BY p_partkey), NULL, p_partkey FROM part WHERE p_size <= 25) GROUP BY rn""")
def compacted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's values packed to the top. Ranks come range by range, so no task sorts all rows."""
    from siltworks.functions.frames import compact_columns

    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_partkey")).alias("a"), F.when(F.col("p_size") <= 25, F.col("p_partkey")).alias("b"))
    return compact_columns(p, "p_partkey", ["a", "b"])


@query("""
SELECT p_partkey, k FROM (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY k) AS rn FROM part JOIN (VALUES ('in'), ('RED'), ('bolt'), ('Ring'), ('dget')) w(k) ON contains(lower(p_name), lower(k))) WHERE rn <= 2""")
def keyword_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a small list found in each text, at most two each. The list is a literal array, so nothing is joined."""
    words = sorted(["in", "RED", "bolt", "Ring", "dget"])
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("p_name"), F.lower(w)))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.slice(found, 1, 2)).alias("k"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltworks.operators.telemetry import ring_buffer as last

    return last(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT source, lang, first_doc FROM (SELECT source, lang, min(doc_id) AS first_doc FROM documents GROUP BY source, lang)")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("first_doc"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
u AS (SELECT *, sum(strlen(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS used FROM l)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(line_text, chr(10) ORDER BY line_no)) AS excerpt FROM u WHERE used <= 16384 AND line_no <= 200 GROUP BY doc_id""")
def source_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of every document, up to 200 lines and 16 KiB; those that fit are found within the document's own array."""
    lines = F.slice(F.split("text", "\n", -1), 1, 200)
    used = F.aggregate("lines", F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), lambda a, x: F.struct((a["used"] + F.octet_length(x) + 1).alias("used"), (a["n"] + (a["used"] + F.octet_length(x) + 1 <= 16384).cast("int")).alias("n")))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines")).withColumn("n", used["n"])
    return d.where("n > 0").select("doc_id", F.col("n").cast("long").alias("n_lines"), F.md5(F.array_join(F.slice("lines", 1, F.col("n")), "\n")).alias("excerpt"))
