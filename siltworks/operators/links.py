"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import drop_scratch, scratch


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(links: DataFrame) -> DataFrame:
    """For each a, the least of a and its neighbours; map-side combined, so a hub is no single group."""
    return links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def components(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of links (a, b): the least node that it reaches. Rows with nulls or a = b only name nodes.

    Large-star and small-star steps in turn until the links stand still, which takes about the logarithm of the longest path in rounds; each
    round ends in a table in the shared folder. It raises if the links still move after most_rounds, never gives a part of the answer.
    """
    nodes = _both(links).where("a IS NOT NULL").select(F.col("a").alias("node")).distinct()
    now = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = _both(now)
        large = both.join(_least(both), "a").where("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = _least(large)
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        after = scratch(small, "links")
        drop_scratch(now)
        now = after
        sums = [F.sum(F.xxhash64(*[F.lit(seed), *ends]).cast("decimal(38,0)")) for seed, ends in ((1, ("a", "b")), (2, ("b", "a")))]
        seen = tuple(now.agg(F.count(F.lit(1)), *sums).first())  # 128 bits over all links
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
