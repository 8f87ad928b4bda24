"""Small operators over keys and records: bounded edges, labels, subsets, orders, codes, times, flat metadata, other measures."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import html as H
from siltworks.functions import text as T
from siltworks.functions import values as V
from siltworks.operators import code as C
from siltworks.operators import graph as G
from siltworks.operators import joining as J
from siltworks.plans.code_queries import part_sources
from siltworks.plans.registry import query
from siltworks.session import scratch, ship_package, table


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("relationship_id"), F.when(k % 2 == 0, "imports").otherwise("inherits").alias("relationship_type"), (F.col("o_custkey") % 90).alias("source_id"),
        F.when(k % 4 != 0, F.col("o_custkey") % 70).alias("target_id"), F.when(k % 4 == 0, F.concat(F.lit("x"), (k % 10).cast("string"))).alias("unresolved_target"),
        F.col("o_orderpriority").alias("relative_path"), (k % 100).cast("int").alias("line"), (k % 7).cast("int").alias("column"),
    )


_RELATIONS = """
rel AS (SELECT o_orderkey AS relationship_id, CASE WHEN o_orderkey % 2 = 0 THEN 'imports' ELSE 'inherits' END AS relationship_type, o_custkey % 90 AS source_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 70 END AS target_id,
 CASE WHEN o_orderkey % 4 = 0 THEN 'x' || o_orderkey % 10 END AS unresolved_target, o_orderpriority AS relative_path, (o_orderkey % 100)::INT AS line, (o_orderkey % 7)::INT AS col FROM orders),
ordered AS (SELECT *, row_number() OVER (ORDER BY relationship_type, source_id, COALESCE(target_id::VARCHAR, unresolved_target, ''), relative_path, line, col, relationship_id) AS place FROM rel)"""


@query(f"WITH {_RELATIONS} SELECT relationship_id, place FROM ordered WHERE place <= 500")
def relationship_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 relationships in their order."""
    order = G.relationship_order()
    rows = _relations(spark, sf_dir).orderBy(*order).limit(500)
    return rows.select("relationship_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"""
WITH {_RELATIONS}, near AS (SELECT *, row_number() OVER (ORDER BY place) AS rank, count(*) OVER () AS n FROM ordered WHERE source_id <= 20 AND (target_id IS NULL OR target_id <= 20))
SELECT relationship_id, n > 150 AS truncated FROM near WHERE rank <= 150""")
def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.range(0, 21).select(F.col("id").alias("node"))
    return G.neighbourhood_edges(_relations(spark, sf_dir), nodes, G.relationship_order(), 150, "source_id", "target_id").select("relationship_id", "truncated")


@query("SELECT o_orderkey, COALESCE(p_name, 'unknown:' || o_orderkey) AS node_label FROM orders LEFT JOIN part ON o_orderkey = p_partkey")
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_labels(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "part"), "o_orderkey", "p_partkey", "p_name")


@query("""
SELECT 'suppliers' AS part, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS is_subset
UNION ALL SELECT 'customers', NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def subset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, suppliers = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k"), table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "k")
    customers, orders = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return J.is_subset(items, suppliers, "k").withColumn("part", F.lit("suppliers")).unionByName(J.is_subset(customers, orders, "k").withColumn("part", F.lit("customers")))


@query("SELECT count(*) FILTER (WHERE doc_id % 3 > 0) AS n FROM documents")
def parse_gap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source file: one in three as a string literal, the others as broken syntax or a broken encoding."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x = 'b"), F.hex(F.col("t").cast("binary")), F.lit("'")).cast("binary"))
    content = content.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("def ("), F.col("t")).cast("binary")).otherwise(F.concat(F.lit("# "), F.md5("t")).cast("binary"))
    broken = F.when(F.col("doc_id") % 3 == 2, F.concat(content, F.unhex(F.lit("0AFF")))).otherwise(content)
    files = d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("relative_path"), broken.alias("content"))
    return C.parse_gaps(C.scan_sources(files))


@query("SELECT o_orderkey, substr(o_orderkey::VARCHAR, 1, 2) AS sector FROM orders")
def sector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.sector_code(F.col("o_orderkey")).alias("sector"))


@query("""
SELECT o_orderkey, strftime(to_timestamp(o_orderkey * 86400) AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS local, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM orders""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("o_orderkey") * 86400
    return table(spark, sf_dir, "orders").select("o_orderkey", V.local_time(seconds, "America/New_York").alias("local"), V.utc_stamp(F.col("o_orderdate")).alias("stamp"))


@query("""
SELECT doc_id, 's' || source AS url, CASE WHEN doc_id % 3 = 0 THEN 'own' ELSE 'text/html' END AS content_type, strlen(text)::VARCHAR AS text_bytes, CASE WHEN doc_id % 3 = 0 THEN lang END AS lang FROM documents""")
def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("content_type"), F.lit("own"), F.lit("lang"), F.col("lang"), F.lit("text_bytes"), F.lit("no")))
    made = V.flat_metadata({"url": F.concat(F.lit("s"), "source"), "content_type": F.lit("text/html")}, extra, {"text_bytes": F.octet_length("text")})
    d = table(spark, sf_dir, "documents").select("doc_id", made.alias("m"))
    return d.select("doc_id", *[F.col("m")[k].alias(k) for k in ("url", "content_type", "text_bytes", "lang")])


@query("""
SELECT 'f' || p_partkey AS name, (p_size % 20 + 2 + [0, 1, 0, 2, 2, 2, 1][p_partkey % 7 + 1])::INT AS score FROM part""")
def script_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(content: bytes) -> list:
        try:
            return ast.parse(content).body
        except (SyntaxError, ValueError):  # a file that cannot be parsed has no functions
            return []

    def score(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = [(x.name, C.script_complexity(x)) for content in batch["content"] for x in body(bytes(content)) if isinstance(x, ast.FunctionDef)]
            yield pd.DataFrame({"name": [r[0] for r in rows], "score": [r[1] for r in rows]})

    ship_package(spark)
    return scratch(part_sources(spark, sf_dir), "sources").select("content").mapInPandas(score, "name string, score int")


@query()
def url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: BLAKE2s is not in DuckDB; a test compares it with Python."""
    return table(spark, sf_dir, "pages").select("page_id", T.url_slug(F.col("url")).alias("slug"))


@query(r"""
SELECT page_id, md5(regexp_replace(html, '<strong> ([^<]*</strong>)', '<strong>\1', 'g')) AS digest FROM pages""")
def strong_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    spaced = H.each_page(H.strong_spacing)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(spaced("html")).alias("digest"))
