"""Cycles and depths of directed graphs of any size.

Edges are cut into blocks of bounded size by ranges of their ends. A task solves its block by itself: it contracts the block's cycles, or settles
all depths that the block alone decides. What several blocks share is put together by joins, and the rest is cut into blocks anew, until
nothing is left. So a chain of any length inside a block costs one round, no task holds more than a block, and nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.links import components
from siltworks.session import drop_scratch, scratch, ship_package

#: Edges of one block at first, and at most (blocks grow where they are too small to hold the cycles).
BLOCK_EDGES, MOST_BLOCK_EDGES = 200_000, 2_000_000
#: A round of contraction that leaves more than this share of the edges is followed by larger blocks or, with the largest, by a round of colouring.
SLOW_SHARE = 0.8


def _blocks(edges: DataFrame, *by: str, block_edges: int = 0) -> DataFrame:
    """edges with the number of the block of each; edges equal in by are in one block."""
    tasks = max(1, -(-edges.count() // (block_edges or BLOCK_EDGES)))
    return scratch(edges.repartitionByRange(tasks, *by).withColumn("block", F.spark_partition_id()), "blocks")


def local_components(pairs: Iterable[tuple]) -> list[list]:
    """Strong components of a graph held in memory, those that a component reaches before it (Tarjan's pass, without recursion)."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order: dict = {}
    low: dict = {}
    path: list = []
    on_path: set = set()
    out: list[list] = []
    for start in after:
        if start in order:
            continue
        work = [(start, iter(after[start]))]
        order[start] = low[start] = len(order)
        path.append(start)
        on_path.add(start)
        while work:
            node, rest = work[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    path.append(b)
                    on_path.add(b)
                    work.append((b, iter(after[b])))
                    break
                if b in on_path:
                    low[node] = min(low[node], order[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    at = len(path) - 1
                    while path[at] != node:
                        at -= 1
                    out.append(path[at:])
                    on_path.difference_update(path[at:])
                    del path[at:]
    return out


def contracted_block(pairs: list[tuple], shared: set) -> tuple[list[tuple], list[tuple]]:
    """(node, least node of its cycle) for nodes on cycles of the block, and the edges between what is left that lie on a way from a shared node
    to a shared one; no other edge can be on a cycle through several blocks."""
    groups = local_components(pairs)
    home = {x: min(g) for g in groups for x in g}
    merged = [(x, home[x]) for g in groups if len(g) > 1 for x in g]
    edges = {(home[a], home[b]) for a, b in pairs if home[a] != home[b]}
    marked = {home[x] for x in shared}
    place = {home[g[0]]: i for i, g in enumerate(groups)}
    entered, leaving = set(marked), set(marked)
    for a, b in sorted(edges, key=lambda e: -place[e[0]]):  # sources before what they reach
        if a in entered:
            entered.add(b)
    for a, b in sorted(edges, key=lambda e: place[e[0]]):
        if b in leaving:
            leaving.add(a)
    return merged, [(a, b) for a, b in edges if a in entered and b in leaving]


def _contracted(left: DataFrame, by: tuple[str, str], kind: str, block_edges: int) -> tuple[DataFrame, DataFrame]:
    """One round over blocks of left (src, dst): (node, root) of nodes that fall together, and the edges that may still lie on cycles."""
    blocks = _blocks(left, *by, block_edges=block_edges)
    ends = blocks.select("block", F.explode(F.array("src", "dst")).alias("node")).distinct()
    several = ends.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("node")
    marked = blocks.join(several.select(F.col("node").alias("src"), F.lit(True).alias("s")), "src", "left")
    marked = marked.join(several.select(F.col("node").alias("dst"), F.lit(True).alias("d")), "dst", "left")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True))
        shared = set(frame["src"][frame["s"].notna()].tolist()) | set(frame["dst"][frame["d"].notna()].tolist())
        merged, kept = contracted_block(pairs, shared)
        rows = [(x, root, True) for x, root in merged] + [(a, b, False) for a, b in kept]
        return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=object) for i, name in enumerate(("a", "b", "merged"))})

    ship_package(left.sparkSession)
    solved = scratch(marked.groupBy("block").applyInPandas(solve, f"a {kind}, b {kind}, merged boolean"), "solved")
    roots = solved.where("merged").select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A node that fell together with others in several blocks joins them all.
    met = roots.groupBy("node").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.collect_set("root").alias("all")).where("x < y")
    joins = scratch(met.select(F.col("x").alias("a"), F.explode("all").alias("b")).where("a <> b"), "joins")
    merged = roots.distinct()
    if not joins.isEmpty():
        one = components(joins).select(F.col("node").alias("root"), "component")
        merged = merged.join(one, "root", "left").select("node", F.coalesce("component", "root").alias("root")).distinct()
    merged = scratch(merged, "merged")
    rest = solved.where("NOT merged").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    for end in ("src", "dst"):
        rest = rest.join(merged.select(F.col("node").alias(end), F.col("root").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    rest = scratch(rest.where("src <> dst").select("src", "dst").distinct(), "rest")
    drop_scratch(blocks, solved)
    return merged, rest


def _spread_least(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, c): the least label that reaches each node."""
    now = scratch(labels, "colour")
    while True:
        given = edges.join(now.select(F.col("node").alias("src"), F.col("c").alias("given")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("given").alias("given"))
        after = scratch(now.join(given, "node", "left").select("node", F.least("c", F.coalesce("given", "c")).alias("c"), (F.col("given") < F.col("c")).alias("moved")), "colour")
        drop_scratch(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("node", "c")


def _coloured(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round that needs no blocks, as _contracted: the label of least hash that reaches a node colours it; nodes that reach the root of their
    colour fall together with it, and edges between colours lie on no cycle."""
    nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colour = _spread_least(nodes.withColumn("c", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("root"))), left)
    inside = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst")
    inside = scratch(inside.where("cs = cd").select("src", "dst", F.col("cs").alias("c")), "inside")
    reached = front = scratch(colour.where("node = c.root").select("node", "c"), "back")
    while not front.isEmpty():
        new = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
        front = scratch(new.join(reached.select("node"), "node", "left_anti"), "front")
        reached = reached.unionByName(front)
    groups = reached.groupBy("c").agg(F.min("node").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    merged = scratch(reached.join(groups, "c").select("node", "root"), "merged")
    gone = reached.select(F.col("node").alias("g"))
    rest = inside.join(gone, F.col("src") == F.col("g"), "left_anti").join(gone, F.col("dst") == F.col("g"), "left_anti")
    return merged, scratch(rest.select("src", "dst"), "rest")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes on a cycle; component is the least node of it. Edges are (src, dst); those with a null end are none.

    Rounds of contraction go on until no edge is left that can lie on a cycle. Where the largest blocks stop paying, a round of colouring by hash
    takes whole components out, so it always ends; such a round takes as many steps as the longest way has edges.
    """
    kind = dict(edges.dtypes)["src"]
    every = scratch(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    left, size = every.where("src <> dst"), every.count()
    found: DataFrame | None = None
    by, slow, block_edges = ("src", "dst"), False, BLOCK_EDGES
    while size:
        if slow and block_edges < MOST_BLOCK_EDGES:
            block_edges, slow = min(4 * block_edges, MOST_BLOCK_EDGES), False
        merged, rest = _coloured(left) if slow else _contracted(left, by, kind, block_edges)
        if found is None:
            found = merged
        else:
            moved = found.join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            found = scratch(moved.unionByName(merged.join(found.select("node"), "node", "left_anti")), "found")
        left, before, size = rest, size, rest.count()
        slow = not slow and size > SLOW_SHARE * before
        by = by[::-1]
    loops = every.where("src = dst").select(F.col("src").alias("node"))
    if found is None:
        return loops.withColumn("component", F.col("node"))
    alone = loops.join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component").unionByName(alone)


def cycle_groups(edges: DataFrame) -> DataFrame:
    """(component, members in order, n_edges): groups of nodes on common cycles with the edges among them."""
    edges = scratch(edges.select("src", "dst"), "edges")
    comps = scratch(strong_components(edges), "scc")
    ends = edges.join(comps.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(comps.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst")
    counted = ends.where("cs = cd").groupBy(F.col("cs").alias("component")).agg(F.count(F.lit(1)).alias("n_edges"))
    return comps.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members")).join(counted, "component")


def _set_digest(value: Column) -> list[Column]:
    """Count and two sums of digests of some values, as aggregates: the same for equal multisets, in whatever order and however they are combined."""
    digest = F.md5(value.cast("string"))
    half = lambda start: F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return [F.count(F.lit(1)).cast("string"), half(1), half(16)]


def cycle_identities(edges: DataFrame, relationship_type: str) -> DataFrame:
    """(component, cycle_key, cycle_id, n_members, n_edges) of groups of nodes on common cycles. The key stands for the type and the members, the id for the edges
    among them as well; neither knows an order, so they are summed up before the shuffle and no row holds a component."""
    edges = scratch(edges.select("src", "dst"), "edges")
    comps = scratch(strong_components(edges), "scc")
    members = comps.groupBy("component").agg(F.concat_ws(":", *_set_digest(F.col("node"))).alias("m"), F.count(F.lit(1)).alias("n_members"))
    ends = edges.join(comps.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(comps.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst")
    edge = F.concat(F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"))
    inner = ends.where("cs = cd").groupBy(F.col("cs").alias("component")).agg(F.concat_ws(":", *_set_digest(edge)).alias("e"), F.count(F.lit(1)).alias("n_edges"))
    named = F.concat(F.lit(f"{relationship_type}|"), F.col("m"))
    return members.join(inner, "component").select(
        "component", F.sha2(named, 256).alias("cycle_key"), F.sha2(F.concat(named, F.lit("|"), F.col("e")), 256).alias("cycle_id"), "n_members", "n_edges"
    )


def cycle_changes(before: DataFrame, after: DataFrame, before_uncertain: bool = False, after_uncertain: bool = False) -> DataFrame:
    """(cycle_key, change_type, baseline_cycle_id, target_cycle_id) over the union of two sets of cycle_identities; a cycle that both have is no change. Where a
    side may be incomplete, what it lacks was not observed rather than added or removed."""
    one = before.select("cycle_key", F.col("cycle_id").alias("baseline_cycle_id"))
    joined = one.join(after.select("cycle_key", F.col("cycle_id").alias("target_cycle_id")), "cycle_key", "full").where("baseline_cycle_id IS NULL OR target_cycle_id IS NULL")
    came, went = "not-observed-in-baseline" if before_uncertain else "added", "not-observed-in-target" if after_uncertain else "removed"
    return joined.select("cycle_key", F.when(F.col("baseline_cycle_id").isNull(), came).otherwise(went).alias("change_type"), "baseline_cycle_id", "target_cycle_id")


def settled_block(pairs: Iterable[tuple], known: dict) -> dict:
    """Depth of each child whose parents are all known or settle within the block."""
    waiting: dict = {}
    below: dict = {}
    depth: dict = {}
    todo: list = []
    for child, parent in pairs:
        depth.setdefault(child, 0)
        waiting.setdefault(child, 0)
        if parent in known:
            depth[child] = max(depth[child], known[parent] + 1)
        else:
            waiting[child] += 1
            below.setdefault(parent, []).append(child)
    todo = [c for c, n in waiting.items() if not n]
    settled = {}
    while todo:
        node = todo.pop()
        settled[node] = depth[node]
        for child in below.get(node, ()):
            depth[child] = max(depth[child], depth[node] + 1)
            waiting[child] -= 1
            if not waiting[child]:
                todo.append(child)
    return settled


def longest_depth(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, depth): longest way up to a root for nodes with a parent; null where a cycle can be reached.

    A node's links to its parents are in one block. Blocks that have learnt the depth of a parent from elsewhere are solved again, until no node
    settles any more: as many rounds as a way changes blocks.
    """
    links = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL").distinct()
    links = scratch(links, "links")  # counted, sampled and cut
    blocks = _blocks(links, "child")
    homes = blocks.select(F.col("child").alias("parent"), F.col("block").alias("home")).distinct()
    placed = scratch(blocks.join(homes, "parent", "left"), "placed")
    outside = scratch(placed.where("home <> block").select(F.col("block").alias("asks"), F.col("parent").alias("known")).distinct(), "outside")
    kind = dict(links.dtypes)["child"]

    def settle(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        frame, learnt = frames
        known = dict(zip(learnt["known"].tolist(), learnt["depth"].tolist(), strict=True))
        known |= dict.fromkeys(frame["parent"][frame["home"].isna()].tolist(), 0)
        rows = settled_block(zip(frame["child"].tolist(), frame["parent"].tolist(), strict=True), known)
        return pd.DataFrame({"node": pd.Series(list(rows), dtype=object), "depth": pd.Series(list(rows.values()), dtype=object)})

    ship_package(edges.sparkSession)
    settled, learnt, active = None, outside.where("false").withColumn("depth", F.lit(0)), placed
    while True:
        solved = active.groupBy("block").cogroup(learnt.groupBy("asks")).applyInPandas(lambda x, y: settle((x, y)), f"node {kind}, depth int")
        new = scratch(solved if settled is None else solved.join(settled.select("node"), "node", "left_anti"), "settled")
        settled = new if settled is None else settled.unionByName(new)
        woken = scratch(outside.join(new.select(F.col("node").alias("known")), "known").select("asks").distinct(), "woken")
        if woken.isEmpty():
            break
        active = placed.join(woken, F.col("block") == F.col("asks"), "left_semi")
        learnt = outside.join(woken, "asks", "left_semi").join(settled.select(F.col("node").alias("known"), "depth"), "known")
    stuck = links.select(F.col("child").alias("node")).distinct().join(settled.select("node"), "node", "left_anti")
    return settled.unionByName(stuck.withColumn("depth", F.lit(None).cast("int")))
