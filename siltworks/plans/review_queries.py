"""The analysis of sources from scan to findings, over the generated files of code_queries and tests that import every second brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import code, review
from siltworks.plans.code_queries import _FILES, _IMPORTS, RUN, part_sources
from siltworks.plans.registry import query
from siltworks.session import scratch


def review_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scratch(part_sources(spark, sf_dir), "sources")
    name = F.regexp_extract("relative_path", r"(brand\d+_\d+)\.py$", 1)
    even = files.where(F.regexp_extract("relative_path", r"brand(\d+)_", 1).cast("int") % 2 == 0)
    tests = even.select(F.concat(F.lit("tests/test_"), name, F.lit(".py")).alias("relative_path"), F.concat(F.lit("import pkg."), name, F.lit("\n")).cast("binary").alias("content"))
    return files.unionByName(tests)


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch(code.scan_sources(review_sources(spark, sf_dir), code.EDGE_FACTS), "facts")


_X = f"{_IMPORTS}, x AS (SELECT src, dst FROM e UNION ALL SELECT 'tests.test_brand' || b || '_' || r, 'pkg.brand' || b || '_' || r FROM b WHERE b % 2 = 0)"
_RINGS = "g AS (SELECT src, dst FROM e UNION SELECT g.src, e.dst FROM g JOIN e ON g.dst = e.src), c AS (SELECT DISTINCT a.src AS node FROM g a JOIN g z ON a.src = z.dst AND a.dst = z.src)"
_MODULES = f"""
m AS (SELECT 'pkg.brand' || regexp_extract(p_brand, '(\\d+)', 1) || '_' || p_partkey // {RUN} AS module_name, 1 AS class_count, count(*) AS n FROM part GROUP BY 1
  UNION ALL SELECT 'tests.test_brand' || b || '_' || r, 0, 0 FROM b WHERE b % 2 = 0),
i AS (SELECT dst, count(*) AS n FROM x GROUP BY 1), o AS (SELECT src, count(*) AS n FROM x GROUP BY 1)"""


@query(f"""
WITH RECURSIVE {_X}, {_RINGS}, {_MODULES.replace("i AS", "fi AS").replace("o AS", "fo AS")}
SELECT module_name, class_count, m.n AS function_method_count, class_count + m.n AS public_symbol_count, class_count + m.n AS total_symbol_count, COALESCE(fi.n, 0) AS resolved_fan_in, COALESCE(fo.n, 0) AS resolved_fan_out,
  (c.node IS NOT NULL)::BIGINT AS import_cycle_membership, (module_name IN (SELECT dst FROM x WHERE src LIKE 'tests.%'))::BIGINT AS nearby_test_evidence
FROM m LEFT JOIN fi ON fi.dst = module_name LEFT JOIN fo ON fo.src = module_name LEFT JOIN c ON c.node = module_name""")
def review_module_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = scanned(spark, sf_dir)
    edges = scratch(review.relationships(facts), "edges")
    rows = review.module_metrics(facts, edges, review.cycle_members(edges, "imports"))
    return rows.drop("module_id", "relative_path", "file_line_count")


@query(f"""
WITH {_FILES}, n AS (SELECT count(*) AS parts FROM part), t AS (SELECT count(*) AS files, count(*) FILTER (WHERE b % 2 = 0) AS tests FROM b),
h AS (SELECT count(*) AS met FROM (SELECT r, b % 5 + 1 AS t FROM b UNION ALL SELECT r, b % 7 + 1 FROM b) WHERE (t, r) IN (SELECT (b, r) FROM b))
SELECT 'contains' AS relationship_type, 'resolved-static' AS resolution_status, 2 * files + tests + parts AS n FROM n, t UNION ALL SELECT 'imports', 'resolved-static', met + tests FROM h, t
UNION ALL SELECT 'imports', 'unresolved-dynamic', 3 * files - met FROM h, t""")
def review_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type and status: every file holds a class, imports os and two names of other files, some of which are not there."""
    return review.relationships(scanned(spark, sf_dir)).groupBy("relationship_type", "resolution_status").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


@query(f"""
WITH {_FILES}, s AS (SELECT 'pkg.brand' || regexp_extract(p_brand, '(\\d+)', 1) || '_' || p_partkey // {RUN} || '.f' || p_partkey AS qualified_name, (regexp_extract(p_brand, '(\\d+)', 1)::INT % 2 = 0) AS tested,
  (p_size % 20 + 2 + [0, 2, 1, 2, 2, 1, 0][p_partkey % 7 + 1])::BIGINT AS complexity, p_partkey % 11 + 2 AS parameters, p_partkey % 2 = 0 AS documented FROM part),
y AS (SELECT 'high-cyclomatic-complexity' AS rule_id, qualified_name AS subject FROM s WHERE complexity > 15 UNION ALL SELECT 'complexity-without-nearby-test-evidence', qualified_name FROM s WHERE complexity > 15 AND NOT tested
UNION ALL SELECT 'high-parameter-count', qualified_name FROM s WHERE parameters > 8 UNION ALL SELECT 'undocumented-public-symbol', qualified_name FROM s WHERE NOT documented
UNION ALL SELECT 'undocumented-public-symbol', 'pkg.brand' || b || '_' || r || '.Base' || b || '_' || r FROM b
UNION ALL SELECT 'orphan-looking-candidate', qualified_name FROM s UNION ALL SELECT 'orphan-looking-candidate', 'pkg.brand' || b || '_' || r || '.Base' || b || '_' || r FROM b)
SELECT rule_id, subject FROM y""")
def review_symbol_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over symbols, from the files alone; those that depend on line counts, fan and cycles have queries of their own."""
    rules = ("high-cyclomatic-complexity", "complexity-without-nearby-test-evidence", "high-parameter-count", "undocumented-public-symbol", "orphan-looking-candidate")
    return review.analyse(review_sources(spark, sf_dir)).where(F.col("rule_id").isin(*rules)).select("rule_id", "subject")
