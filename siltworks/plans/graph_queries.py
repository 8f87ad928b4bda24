"""Graphs from keys: places contain customers, orders link customers to suppliers, parts depend on parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import cycles
from siltworks.operators import graph as G
from siltworks.plans.registry import query
from siltworks.session import scratch, table


#: Parts of one run of keys, beyond which no edge goes; the closure's size grows with its square.
RUN = 40


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependency graph with some cycles over all parts: each points to a later part of its run (to none at the end of it), and sometimes back."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") + F.col("p_partkey") % 5 + 1).alias("n"))
    p = p.withColumn("n", F.when(F.expr(f"k DIV {RUN} = n DIV {RUN}"), F.col("n")))
    forward = p.select(F.col("k").alias("src"), F.col("n").alias("dst"))
    back = p.where("k % 3 = 0").select(F.col("n").alias("src"), F.col("k").alias("dst"))
    loops = p.where("k % 50 = 7").select(F.col("k").alias("src"), F.col("k").alias("dst"))
    return forward.unionByName(back).unionByName(loops)


_EDGES = f"""
e AS (SELECT * FROM (SELECT p_partkey AS src, p_partkey + p_partkey % 5 + 1 AS dst FROM part UNION ALL
  SELECT p_partkey + p_partkey % 5 + 1, p_partkey FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 50 = 7) WHERE src // {RUN} = dst // {RUN})"""
_CLOSURE = f"WITH RECURSIVE {_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query("""
WITH m AS (SELECT DISTINCT r_name || '.' || n_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT split_part(module, '.', 1) AS node_id, 'package' AS node_type FROM m UNION ALL SELECT module, 'module' FROM m""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return G.package_nodes(n.select(F.concat_ws(".", "r_name", "n_name").alias("module")), "module")


@query("SELECT c_nationkey AS source_id, c_custkey AS target_id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)")
def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.containment(table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey", "c_custkey")


@query("""
SELECT node, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT l_partkey AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_suppkey, 0, 1 FROM lineitem) GROUP BY node""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""
WITH e AS (SELECT o_orderkey AS id, o_custkey AS src, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 50 END AS dst FROM orders)
SELECT id FROM e WHERE src <= 60 AND (dst IS NULL OR dst <= 60)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") % 50).alias("dst"))
    nodes = spark.range(0, 61).select(F.col("id").alias("node"))
    return G.induced_subgraph(e, nodes, "src", "dst").select("id")


@query("""
SELECT c_mktsegment AS src_pkg, s_nationkey AS dst_pkg, count(*) AS n_edges, min(l_orderkey * 10 + l_linenumber) AS representative
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def package_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    rows = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.select(F.col("c_mktsegment").alias("src_pkg"), F.col("s_nationkey").cast("string").alias("dst_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    rolled = G.rollup(edges, "src_pkg", "dst_key", "id")
    return rolled.select("src_pkg", F.col("dst_key").cast("int").alias("dst_pkg"), "n_edges", "representative")


@query(f"{_CLOSURE} SELECT src, dst FROM r")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reachable(_part_edges(spark, sf_dir))


@query(f"""
{_CLOSURE}, c AS (SELECT a.src AS node, min(least(a.src, a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT node, component FROM c""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.strong_components(_part_edges(spark, sf_dir))


@query(f"""
{_CLOSURE}, c AS (SELECT a.src AS node, min(least(a.src, a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
SELECT x.component, list_sort(x.m)::VARCHAR AS members, y.n AS n_edges FROM (SELECT component, list(node) AS m FROM c GROUP BY component) x
JOIN (SELECT c1.component, count(*) AS n FROM e JOIN c c1 ON e.src = c1.node JOIN c c2 ON e.dst = c2.node WHERE c1.component = c2.component GROUP BY 1) y ON x.component = y.component""")
def cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cycles.cycle_groups(_part_edges(spark, sf_dir))
    return groups.withColumn("members", F.concat(F.lit("["), F.array_join(F.col("members").cast("array<string>"), ", "), F.lit("]")))


_HALVES = "count(*) || ':' || sum(('0x' || substr(md5({0}), 1, 15))::BIGINT) || ':' || sum(('0x' || substr(md5({0}), 16, 15))::BIGINT)"


def _identity_sql(edges: str, out: str) -> str:
    """Closure, components and identities of the edges of one table, as SQL."""
    return f"""
r_{out} AS (SELECT src, dst FROM {edges} UNION SELECT r_{out}.src, x.dst FROM r_{out} JOIN {edges} x ON r_{out}.dst = x.src),
c_{out} AS (SELECT a.src AS node, min(least(a.src, a.dst)) AS component FROM r_{out} a JOIN r_{out} b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
m_{out} AS (SELECT component, count(*) AS n_members, 'depends|' || {_HALVES.format("node::VARCHAR")} AS m FROM c_{out} GROUP BY component),
i_{out} AS (SELECT c1.component, count(*) AS n_edges, {_HALVES.format("x.src || '>' || x.dst")} AS e FROM {edges} x JOIN c_{out} c1 ON x.src = c1.node JOIN c_{out} c2 ON x.dst = c2.node WHERE c1.component = c2.component GROUP BY 1),
{out} AS (SELECT component, sha256(m) AS cycle_key, sha256(m || '|' || e) AS cycle_id, n_members, n_edges FROM m_{out} JOIN i_{out} USING (component))"""


@query(f"WITH RECURSIVE {_EDGES}, {_identity_sql('e', 'found')} SELECT * FROM found")
def cycle_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.cycle_identities(_part_edges(spark, sf_dir).where("dst IS NOT NULL"), "depends")


@query(f"""
WITH RECURSIVE {_EDGES}, l AS (SELECT * FROM e WHERE src % 21 <> 3), n AS (SELECT * FROM e WHERE src % 15 <> 4), {_identity_sql("l", "old")}, {_identity_sql("n", "new")}
SELECT cycle_key, CASE WHEN old.cycle_id IS NULL THEN 'added' ELSE 'not-observed-in-target' END AS change_type, old.cycle_id AS baseline_cycle_id, new.cycle_id AS target_cycle_id
FROM old FULL JOIN new USING (cycle_key) WHERE old.cycle_id IS NULL OR new.cycle_id IS NULL""")
def cycle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles that only one of two states of the graph has; the later one may be incomplete."""
    edges = scratch(_part_edges(spark, sf_dir).where("dst IS NOT NULL"), "edges")
    old, new = (cycles.cycle_identities(edges.where(f"src % {a} <> {b}"), "depends") for a, b in ((21, 3), (15, 4)))
    return cycles.cycle_changes(old, new, after_uncertain=True)


_PARENTS = "p AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION ALL SELECT 1001 + i, 1001 + (i + 1) % 3 FROM range(3) t(i) UNION ALL SELECT 1010, 1001)"


@query(f"""
WITH RECURSIVE {_PARENTS}, up AS (SELECT child, parent, 1 AS d FROM p UNION ALL SELECT up.child, p.parent, d + 1 FROM up JOIN p ON up.parent = p.child WHERE d < 60)
SELECT child AS node, CASE WHEN max(d) >= 60 THEN NULL ELSE max(d) END AS depth FROM up GROUP BY child""")
def inheritance_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.expr("p_partkey DIV 2").alias("parent"))
    ring = spark.createDataFrame([(1001, 1002), (1002, 1003), (1003, 1001), (1010, 1001)], "child long, parent long")
    return cycles.longest_depth(own.unionByName(ring))


@query("""
WITH e AS (SELECT l_partkey AS a, -l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
l1 AS (SELECT b AS node, 1 AS distance, row_number() OVER (ORDER BY b) + 1 AS rank FROM (SELECT DISTINCT b FROM u WHERE a = 5)),
l2 AS (SELECT b AS node, 2 AS distance, (SELECT count(*) FROM l1) + 1 + row_number() OVER (ORDER BY via, b) AS rank FROM (SELECT u.b, min(l1.rank) AS via FROM u JOIN l1 ON u.a = l1.node WHERE u.b <> 5 AND u.b NOT IN (SELECT node FROM l1) GROUP BY u.b)),
al AS (SELECT 5 AS node, 0 AS distance, 1 AS rank UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)
SELECT node::BIGINT AS node, distance, rank::INT AS rank, (SELECT count(*) FROM al) > 40 AS truncated FROM al WHERE rank <= 40""")
def bounded_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
    return G.neighbourhood(e, 5, 2, 40)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey) % 1000 AS dst FROM orders), r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, depth + 1 FROM r JOIN e ON r.node = e.src WHERE depth < 2)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def breadth_first_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1000).alias("dst"))
    return G.crawl(e, 1, 100_000, 2)


@query("""
SELECT DISTINCT 1 AS level, p_brand AS path, p_brand AS name FROM part UNION ALL SELECT DISTINCT 2, p_brand || '/' || p_type, p_type FROM part""")
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tree_paths(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT DISTINCT n_regionkey AS parent, n_nationkey AS child, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS place FROM nation")
def radial_tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ranked_children(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child")), "parent", "child")
