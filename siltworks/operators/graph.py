"""Property-graph operators: containment, degrees, closures, bounded neighbourhoods, crawls and rollups.

Iterations are DataFrame loops; each round ends in a table in the shared checkpoint folder, so lineage stays short and a lost
executor costs one reread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.text import package_prefixes
from siltworks.operators.seeking import relationship_keys
from siltworks.session import drop_scratch, scratch


def package_nodes(modules: DataFrame, module: str) -> DataFrame:
    """Every package on the way to a module, and the modules: (node_id, node_type)."""
    prefixes = F.explode(F.slice(package_prefixes(F.col(module)), 1, F.size(F.split(module, r"\.")) - 1))
    packages = modules.where(F.contains(F.col(module), F.lit("."))).select(prefixes.alias("node_id")).distinct()
    return packages.withColumn("node_type", F.lit("package")).unionByName(modules.select(F.col(module).alias("node_id")).distinct().withColumn("node_type", F.lit("module")))


def containment(parents: DataFrame, children: DataFrame, parent_key: str, child_parent: str, child_key: str) -> DataFrame:
    """(source_id, target_id) for each child whose parent is known."""
    known = parents.select(F.col(parent_key).alias("source_id")).distinct()
    return children.select(F.col(child_parent).alias("source_id"), F.col(child_key).alias("target_id")).join(known, "source_id", "left_semi")


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, fan_out, fan_in); parallel edges count each."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.select("e.*").groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges with both ends among nodes; an edge without a target needs its source only."""
    ids = nodes.select(F.col("node").alias("sg_node"))
    kept = edges.join(ids, F.col(src) == F.col("sg_node"), "left_semi")
    return kept.where(F.col(dst).isNull()).unionByName(kept.where(F.col(dst).isNotNull()).join(ids, F.col(dst) == F.col("sg_node"), "left_semi"))


def rollup(edges: DataFrame, src_group: str, dst_group: str, edge_id: str) -> DataFrame:
    """Dependencies between groups: how many edges and the least edge id; edges within a group go."""
    across = edges.where(F.col(src_group) != F.col(dst_group))
    return across.groupBy(src_group, dst_group).agg(F.count(F.lit(1)).alias("n_edges"), F.min(edge_id).alias("representative"))


def reachable(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 40) -> DataFrame:
    """Transitive closure (src, dst) by squaring: paths double each round, so rounds are the logarithm of the longest path. Use it
    on condensed or small graphs: its size is the answer's size."""
    now = scratch(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "closure")
    n = now.count()
    for _ in range(most_rounds):
        step = now.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
        longer = now.join(step, now["dst"] == step["mid"]).select("src", F.col("far").alias("dst"))
        after = scratch(now.unionByName(longer).distinct(), "closure")
        drop_scratch(now)
        now, m = after, after.count()
        if m == n:
            return now
        n = m
    raise RuntimeError("closure did not settle")


def neighbourhood(edges: DataFrame, focus: object, depth: int, most_nodes: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, distance, rank, truncated): breadth first and undirected from focus, neighbours in id order behind the nodes they are found from,
    at most most_nodes. Levels are bounded by most_nodes, so the frontier that each join carries is small."""
    if not 1 <= depth <= 3 or not 1 <= most_nodes <= 100:
        raise ValueError("limits out of range")
    kind = dict(edges.dtypes)[src]
    found = edges.sparkSession.createDataFrame([(focus, 0, 1)], f"node {kind}, distance int, rank int")
    front, have, cut, known, at = found, 1, False, [focus], [focus]
    for level in range(1, depth + 1):
        # At most most_nodes ids each way, as filters that a scan can take.
        met = [edges.where(F.col(a).isin(at) & ~F.col(b).isin(known)).select(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ((src, dst), (dst, src))]
        near = met[0].unionByName(met[1]).join(F.broadcast(front.select(F.col("node").alias("a"), "rank")), "a")
        ranked = near.groupBy("b").agg(F.min("rank").alias("via"))
        room = most_nodes - have
        rows = ranked.orderBy("via", "b").limit(room + 1).collect()  # at most most_nodes + 1 rows
        cut = cut or len(rows) > room
        rows = rows[:room]
        if not rows:
            break
        front = edges.sparkSession.createDataFrame([(r["b"], level, have + i + 1) for i, r in enumerate(rows)], f"node {kind}, distance int, rank int")
        at = [r["b"] for r in rows]
        found, have, known = found.unionByName(front), have + len(rows), known + at
    return found.withColumn("truncated", F.lit(cut))


def relationship_order() -> list[Column]:
    """Type, source, target (or what it is not resolved to), path, line, column, id."""
    return [key.order() for key in relationship_keys()]


def neighbourhood_edges(edges: DataFrame, nodes: DataFrame, order: list[Column], most_edges: int = 200, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges of any status between nodes of a neighbourhood, or from one to nothing, the first most_edges in order, with truncated if there are more."""
    if not 1 <= most_edges <= 200:
        raise ValueError("limits out of range")
    first = induced_subgraph(edges, nodes, src, dst).orderBy(*order).limit(most_edges + 1).withColumn("ne_place", F.row_number().over(Window.orderBy(*order)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over at most most_edges + 1 rows
    return first.withColumn("truncated", F.max("ne_place").over(every) > most_edges).where(F.col("ne_place") <= most_edges).drop("ne_place")


def node_labels(ids: DataFrame, nodes: DataFrame, key: str, node: str, label: str) -> DataFrame:
    """ids with the label of each node; unknown:<id> where it is not known."""
    known = nodes.select(F.col(node).alias("nl_node"), F.col(label).alias("node_label"))
    joined = ids.join(known, F.col(key) == F.col("nl_node"), "left").drop("nl_node")
    return joined.withColumn("node_label", F.coalesce("node_label", F.concat(F.lit("unknown:"), F.col(key).cast("string"))))


def crawl(links: DataFrame, start: object, most_pages: int, most_depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth) in the order of a breadth-first crawl over a link table, up to most_pages pages and most_depth steps."""
    kind = dict(links.dtypes)[src]
    found = links.sparkSession.createDataFrame([(start, 0)], f"node {kind}, depth int")
    front, have = found, 1
    for level in range(1, most_depth + 1):
        room = most_pages - have
        if room <= 0:
            break
        steps = links.select(F.col(src).alias("node"), F.col(dst).alias("next")).join(front.select("node"), "node").select(F.col("next").alias("node")).where("node IS NOT NULL").distinct()
        front = scratch(steps.join(found.select("node"), "node", "left_anti").orderBy("node").limit(room).withColumn("depth", F.lit(level)), "crawl")
        n = front.count()
        if not n:
            break
        found, have = found.unionByName(front), have + n
    return found


def sitemap(links: DataFrame, page: str, target: str) -> DataFrame:
    return links.groupBy(page).agg(F.array_sort(F.collect_set(target)).alias("links"))


def tree_paths(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Distinct nodes of a category tree at each level with their full path."""
    out = None
    for i in range(1, len(levels) + 1):
        one = rows.select(F.lit(i).alias("level"), F.concat_ws("/", *levels[:i]).alias("path"), F.col(levels[i - 1]).alias("name")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def ranked_children(edges: DataFrame, parent: str, child: str) -> DataFrame:
    return edges.select(parent, child).distinct().withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(child)))
