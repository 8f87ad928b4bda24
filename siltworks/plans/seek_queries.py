"""Pages by cursor, the running limit, and round trips through sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import scans, seeking
from siltworks.plans.registry import query
from siltworks.plans.small_queries import _RELATIONS, _relations
from siltworks.session import table

PAGE = 200


def seek_to(rows: DataFrame, keys: Sequence[seeking.Key], number: int, size: int = PAGE) -> DataFrame:
    """Page number (from 1), got to by the cursors of the pages before it."""
    now = seeking.page(rows, keys, size)
    for _ in range(number - 1):
        last = now.collect()[-1:]  # at most a page
        if not last:
            break
        now = seeking.page(rows, keys, size, seeking.cursor_of(last[0], keys))
    return now


@query(f"WITH {_RELATIONS} SELECT relationship_id, relationship_type, source_id, target_id, line FROM ordered WHERE place > {2 * PAGE} AND place <= {3 * PAGE}")
def relationship_seek_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the relationships in their seven-key order."""
    return seek_to(_relations(spark, sf_dir), seeking.relationship_keys(), 3).select("relationship_id", "relationship_type", "source_id", "target_id", "line")


@query(f"SELECT o_orderkey AS snapshot_id, o_orderdate AS completed_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT {PAGE} OFFSET {2 * PAGE}")
def snapshot_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of finished snapshots, the last completed first."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("completed_at"))
    return seek_to(done, seeking.snapshot_keys(), 3).select("snapshot_id", "completed_at")


@query(f"SELECT event_id, event_type FROM events WHERE user_id % 2 = 0 ORDER BY event_id DESC LIMIT {PAGE} OFFSET {PAGE}")
def history_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a history, the latest event first."""
    history = table(spark, sf_dir, "events").where("user_id % 2 = 0").select("event_id", "event_type")
    return seek_to(history, seeking.history_keys(), 2).select("event_id", "event_type")


#: Limits of the running limit below; both bind at every size of the tables.
MOST_FILES, MOST_CHARS = 150, 300_000


@query()
def running_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a reader takes, in order of source and id, that passes over what no longer fits. No SQL: each row depends on all that was taken
    before it; tests hold it against a loop over the whole table."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.length("text").alias("size"))
    taken = scans.first_fit(docs, ["source", "doc_id"], "size", MOST_FILES, MOST_CHARS)
    return taken.select("doc_id", "fits")
