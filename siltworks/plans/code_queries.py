"""Code evidence: sources synthesised from parts, scanned, resolved, measured and judged; exports of differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import is_test_path
from siltworks.operators import code as C
from siltworks.operators import findings as R
from siltworks.operators import cycles
from siltworks.operators import handoff as H
from siltworks.operators.diffing import snapshot_diff
from siltworks.plans.registry import query
from siltworks.session import spread, table
from siltworks.sources import readers, sinks


#: Parts of one run of keys; a brand has a file for each.
RUN = 500


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file per brand and run of parts: a class, a function per part with as many ifs as its size and one more construct, imports of other brands."""
    key = F.col("p_partkey")
    brand, run = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"), F.expr(f"p_partkey DIV {RUN}")
    # What makes a file is brought together first; the texts are made, and scanned, where it arrives.
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", brand.alias("b"), run.alias("r")), "b", "r")
    ifs = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 20 + 1), lambda i: F.concat(F.lit("    if x > "), i.cast("string"), F.lit(": x -= 1"))), "\n")
    arguments = F.array_join(F.transform(F.sequence(F.lit(1), key % 11 + 1), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")
    doc = F.when(key % 2 == 0, '    """Doc."""\n').otherwise("")
    constructs = F.array(*map(F.lit, (
        "    assert x", "    y = [i for i in x if i if not i]", "    match x:\n        case 1: pass\n        case _: pass", "    y = lambda z: z and x or z",
        "    if x: pass\n    elif a1: pass\n    else: pass", "    try: pass\n    except OSError: pass\n    finally: pass", "    with x as y: pass",
    )))
    more = F.element_at(constructs, (key % 7 + 1).cast("int"))
    function = F.concat(F.lit("def f"), key.cast("string"), F.lit("(x, "), arguments, F.lit("):\n"), doc, ifs, F.lit("\n"), more, F.lit("\n    return x\n"))
    files = p.groupBy("b", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", function.alias("t")))), lambda s: s["t"]), "\n\n").alias("body"))
    name = lambda b: F.concat(b.cast("string"), F.lit("_"), F.col("r").cast("string"))
    head = F.concat(F.lit("import os\nfrom pkg.brand"), name(F.col("b") % 5 + 1), F.lit(" import f1\nimport pkg.brand"), name(F.col("b") % 7 + 1), F.lit("\n\nclass Base"), name(F.col("b")), F.lit(":\n    pass\n\n\n"))
    return files.select(F.concat(F.lit("src/pkg/brand"), name(F.col("b")), F.lit(".py")).alias("relative_path"), F.concat(head, F.col("body")).cast("binary").alias("content"))


_FILES = f"b AS (SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::INT AS b, p_partkey // {RUN} AS r FROM part)"
_IMPORTS = f"{_FILES}, i AS (SELECT b, r, b % 5 + 1 AS t FROM b UNION ALL SELECT b, r, b % 7 + 1 FROM b), e AS (SELECT 'pkg.brand' || b || '_' || r AS src, 'pkg.brand' || t || '_' || r AS dst FROM i WHERE (t, r) IN (SELECT (b, r) FROM b))"


@query(f"""
SELECT 'pkg.brand' || regexp_extract(p_brand, '(\\d+)', 1) || '_' || p_partkey // {RUN} || '.f' || p_partkey AS qualified_name, (p_size % 20 + 2 + [0, 2, 1, 2, 2, 1, 0][p_partkey % 7 + 1])::INT AS complexity,
  CASE WHEN p_partkey % 7 = 4 THEN 2 ELSE 1 END AS nesting, (p_partkey % 11 + 2)::INT AS parameters, p_partkey % 2 = 0 AS documented FROM part""")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = C.scan_sources(part_sources(spark, sf_dir), ("kind", "qualified_name", "complexity", "nesting", "parameters", "documented"))
    return facts.where("kind = 'function'").select("qualified_name", "complexity", "nesting", "parameters", "documented")


@query(f"WITH {_IMPORTS} SELECT src, dst FROM e")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.import_edges(C.scan_imports(part_sources(spark, sf_dir)))


@query("""
SELECT unnest(['pkg', 'os']) AS top_level, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_partkey // 500 FROM part)) AS n_files""")
def import_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = part_sources(spark, sf_dir).select("relative_path", F.decode("content", "UTF-8").alias("text"))
    return C.import_census(files)


_SYMBOLS = """
s AS (SELECT p_partkey AS k, 'm' || p_size || CASE WHEN p_partkey % 9 = 0 THEN '._' ELSE '.' END || 's' || p_partkey AS qualified_name, CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind,
  CASE WHEN p_size % 10 = 0 THEN 'vendor/' WHEN p_size % 10 = 1 THEN 'tests/' ELSE 'src/' END || 'm' || p_size || '.py' AS relative_path, p_partkey::INT AS line, (p_partkey * 7 % 600)::INT AS span, (p_partkey % 40)::INT AS complexity,
  (p_partkey % 17)::INT AS nesting, (p_size % 19)::INT AS parameters, (p_partkey % 13)::INT AS depth, (p_partkey % 4 = 1)::INT AS in_cycle, (p_partkey % 2)::INT AS nearby_test, p_partkey % 5 <> 0 AS top_level,
  CASE WHEN p_partkey % 9 = 0 THEN 'private' ELSE 'public' END AS visibility, p_partkey % 6 = 0 AS documented, (p_partkey % 4)::INT AS incoming, p_partkey % 8 = 0 AS exported, 's' || p_partkey AS display_name, 'm' || p_size AS module_name FROM part)"""
_KEPT = "x AS (SELECT * FROM s WHERE p NOT LIKE 'vendor/%' AND k % 9 <> 0)".replace("p NOT", "relative_path NOT")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    private = k % 9 == 0
    folder = F.when(size % 10 == 0, "vendor/").when(size % 10 == 1, "tests/").otherwise("src/")
    return p.select(
        k.alias("k"), F.concat(F.lit("m"), size.cast("string"), F.when(private, "._").otherwise("."), F.lit("s"), k.cast("string")).alias("qualified_name"), F.when(k % 3 == 0, "class").when(k % 3 == 1, "function").otherwise("method").alias("kind"),
        F.concat(folder, F.lit("m"), size.cast("string"), F.lit(".py")).alias("relative_path"), k.cast("int").alias("line"), (k * 7 % 600).cast("int").alias("span"), (k % 40).cast("int").alias("complexity"), (k % 17).cast("int").alias("nesting"),
        (size % 19).cast("int").alias("parameters"), (k % 13).cast("int").alias("depth"), (k % 4 == 1).cast("int").alias("in_cycle"), (k % 2).cast("int").alias("nearby_test"), (k % 5 != 0).alias("top_level"),
        F.when(private, "private").otherwise("public").alias("visibility"), (k % 6 == 0).alias("documented"), (k % 4).cast("int").alias("incoming"), (k % 8 == 0).alias("exported"), F.concat(F.lit("s"), k.cast("string")).alias("display_name"),
        F.concat(F.lit("m"), size.cast("string")).alias("module_name"),
    )


def _sql_rule(rule: str, family: str, confidence: str, value: str, threshold: str, where: str, severity: str | None = None) -> str:
    graded = f"'{severity}'" if severity else f"CASE WHEN {value} > 2 * {threshold} THEN 'high' WHEN {value} > 1.5 * {threshold} THEN 'medium' ELSE 'low' END"
    return f"SELECT '{rule}' AS rule_id, '{family}' AS family, {graded} AS severity, '{confidence}' AS confidence, qualified_name AS subject, relative_path, line, {value}::DOUBLE AS value, {threshold}::DOUBLE AS threshold FROM x WHERE {where} AND {value} > {threshold}"


_CODE = "kind IN ('function', 'method')"
_TOP = "kind IN ('class', 'function') AND top_level AND visibility = 'public'"
_ALL_RULES = " UNION ALL ".join(
    (
        _sql_rule("oversized-symbol", "oversized", "high", "span", "CASE WHEN kind = 'class' THEN 400 ELSE 80 END", "true"),
        _sql_rule("high-cyclomatic-complexity", "complexity", "high", "complexity", "15", _CODE, "medium"),
        _sql_rule("complexity-without-nearby-test-evidence", "test-evidence-candidate", "medium", "complexity", "15", _CODE + " AND nearby_test = 0", "medium"),
        _sql_rule("high-maximum-nesting", "nesting", "high", "nesting", "5", _CODE),
        _sql_rule("high-parameter-count", "parameters", "high", "parameters", "8", _CODE),
        _sql_rule("deep-inheritance", "inheritance", "high", "depth", "5", "kind = 'class' AND in_cycle = 0", "medium"),
        f"SELECT 'undocumented-public-symbol', 'documentation', 'low', 'high', qualified_name, relative_path, line, NULL, NULL FROM x WHERE {_TOP} AND NOT documented",
        f"SELECT 'orphan-looking-candidate', 'orphan-candidate', 'low', 'low', qualified_name, relative_path, line, NULL, NULL FROM x WHERE {_TOP} AND incoming = 0 AND NOT exported AND relative_path NOT LIKE 'tests/%'",
    )
)


@query(f"WITH {_SYMBOLS}, {_KEPT} {_ALL_RULES}")
def symbol_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.symbol_findings(symbols(spark, sf_dir)).drop("node_id", "kind")


@query("""
WITH m AS (SELECT 's' || s_suppkey AS module_name, count(*)::INT AS fan_in, count(DISTINCT l_partkey)::INT AS fan_out, (s_suppkey * 700 % 3000)::INT AS line_count FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey),
r AS (SELECT 'oversized-module' AS rule_id, 'oversized' AS family, CASE WHEN line_count > 2000 THEN 'high' WHEN line_count > 1500 THEN 'medium' ELSE 'low' END AS severity, module_name AS subject, line_count::DOUBLE AS value, 1000::DOUBLE AS threshold FROM m WHERE line_count > 1000
UNION ALL SELECT 'high-resolved-fan-in', 'coupling', 'medium', module_name, fan_in, 12 FROM m WHERE fan_in > 12 UNION ALL SELECT 'high-resolved-fan-out', 'coupling', 'medium', module_name, fan_out, 12 FROM m WHERE fan_out > 12)
SELECT * FROM r""")
def module_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("int").alias("fan_in"), F.count_distinct("l_partkey").cast("int").alias("fan_out"))
    m = items.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("module_name"), F.lit(None).cast("string").alias("relative_path"), (F.col("l_suppkey") * 700 % 3000).cast("int").alias("line_count"), "fan_in", "fan_out")
    return R.module_findings(m).select("rule_id", "family", "severity", "subject", "value", "threshold")


@query(f"""
WITH {_SYMBOLS} SELECT k AS subject_id, m AS metric_name, CASE m WHEN 'span' THEN span WHEN 'complexity' THEN complexity WHEN 'nesting' THEN nesting ELSE parameters END::DOUBLE AS numeric_value
FROM s, (SELECT unnest(['span', 'complexity', 'nesting', 'parameters']) AS m)""")
def tall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tall(symbols(spark, sf_dir), "k", ["span", "complexity", "nesting", "parameters"])


@query(f"WITH {_SYMBOLS} SELECT k AS subject_id, span::DOUBLE AS span, complexity::DOUBLE AS complexity FROM s")
def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.wide(tall_metrics(spark, sf_dir), ["span", "complexity"])


@query("""
SELECT p_type AS kind, p_name AS name, n::INT AS n, s::VARCHAR AS subjects FROM (
 SELECT p_type, p_name, count(DISTINCT p_brand) AS n, list_sort(list(DISTINCT p_brand)) AS s FROM part GROUP BY ALL) WHERE n >= CASE WHEN p_type = 'SMALL' THEN 5 ELSE 2 END""")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), "p_brand")
    groups = R.duplicate_names(p, "kind", "name", "p_brand", F.when(F.col("kind") == "SMALL", 5).otherwise(2))
    return groups.withColumn("subjects", F.concat(F.lit("["), F.array_join("subjects", ", "), F.lit("]")))


@query(f"""
WITH RECURSIVE {_IMPORTS},
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), c AS (SELECT a.src AS node, min(least(a.src, a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT 'dependency-cycle' AS rule_id, string_agg(node, ',' ORDER BY node) AS subject, count(*)::DOUBLE AS value FROM c GROUP BY component""")
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = C.import_edges(C.scan_imports(part_sources(spark, sf_dir)))
    return R.cycle_findings(cycles.cycle_groups(edges), "imports").select("rule_id", "subject", "value")


@query(f"""
WITH {_SYMBOLS} SELECT relative_path, count(*) AS n, round(avg(complexity), 6) AS mean, max(complexity) AS most, count(*) FILTER (WHERE documented) AS n_documented FROM s GROUP BY relative_path ORDER BY mean DESC, relative_path LIMIT 5""")
def complexity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = symbols(spark, sf_dir).groupBy("relative_path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("complexity"), 6).alias("mean"), F.max("complexity").alias("most"), F.count_if("documented").alias("n_documented"))
    return rows.orderBy(F.col("mean").desc(), "relative_path").limit(5)


@query(f"WITH {_SYMBOLS} SELECT split_part(relative_path, '/', 1) AS root, count(*) FILTER (WHERE relative_path LIKE 'tests/%') AS n_test, count(*) FILTER (WHERE relative_path NOT LIKE 'tests/%') AS n_source FROM s GROUP BY 1")
def source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = is_test_path(F.col("relative_path"))
    return symbols(spark, sf_dir).groupBy(F.substring_index("relative_path", "/", 1).alias("root")).agg(F.count_if(test).alias("n_test"), F.count_if(~test).alias("n_source"))


@query("""
WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' WHEN o_orderkey % 10 = 0 THEN 'added' ELSE 'removed' END AS change_type FROM orders)
SELECT change_type, k, n_total, greatest(n_total - 50, 0) AS n_omitted FROM (SELECT change_type, k, row_number() OVER (PARTITION BY change_type ORDER BY k) AS place, count(*) OVER (PARTITION BY change_type) AS n_total FROM d) WHERE place <= 50""")
def handoff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 7 == 0, "changed").when(k % 10 == 0, "added").otherwise("removed").alias("change_type"))
    return H.capped(rows, "change_type", ["k"]).select("change_type", "k", "n_total", "n_omitted")


@query("""
SELECT 'b' || k AS brand, md5(string_agg('# File: p' || p_partkey || chr(10) || p_name, chr(10) || chr(10) ORDER BY 'p' || p_partkey)) AS digest FROM (SELECT *, regexp_extract(p_brand, '(\\d+)', 1) AS k FROM part WHERE p_partkey % 10 <> 0) GROUP BY k""")
def bundled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), F.regexp_extract("p_brand", r"(\d+)", 1)).alias("brand"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("relative_path"), F.col("p_name").alias("text"))
    return sinks.bundle(p, "brand", ignore=["p*0"]).select("brand", F.md5("content").alias("digest"))


@query("""
SELECT 'd/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.pem' ELSE '.txt' END AS p, strlen(text)::BIGINT AS size_bytes, sha256(text) AS content_hash,
  CASE WHEN doc_id % 5 = 0 THEN 'sensitive' WHEN doc_id % 7 = 0 THEN 'configured' WHEN strlen(text) > 1000000 THEN 'too-large' END AS exclusion_reason
FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT '[sensitive-file-' || substr(sha256('d/' || doc_id || '.pem'), 1, 12) || ']', strlen(text), sha256(text), 'sensitive' FROM documents WHERE doc_id % 5 = 0""")
def inspected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, ".pem").otherwise(".txt")
    files = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), kind).alias("relative_path"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").cast("binary").alias("content"), F.col("doc_id"))
    seen = readers.inspect_candidates(files.where("doc_id % 7 <> 0 OR doc_id % 5 = 0").drop("doc_id"))
    more = readers.inspect_candidates(files.where("doc_id % 7 = 0 AND doc_id % 5 <> 0").drop("doc_id"), ["*.txt"])
    return seen.unionByName(more).withColumnRenamed("relative_path", "p")


@query("""
WITH o AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN text || 'x' ELSE text END AS text, lang FROM documents WHERE doc_id % 10 <> 5)
SELECT * FROM (SELECT COALESCE(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN md5(o.text) = md5(n.text) THEN 'unchanged' ELSE 'changed' END AS change_type,
 md5(o.text) AS old_hash, md5(n.text) AS new_hash FROM o FULL JOIN n ON o.doc_id = n.doc_id) WHERE change_type <> 'unchanged'""")
def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return snapshot_diff(d.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("hash")), d.where("doc_id % 10 <> 5").select("doc_id", F.md5(text).alias("hash")), ["doc_id"], ["hash"])
