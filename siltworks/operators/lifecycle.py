"""Findings over time: reconciliation with what a snapshot observes, reviews with version checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.values import canonical_json, stable_digest


def may_resolve(truncated: bool, parse_gaps: int, generation: int, latest_generation: int) -> bool:
    """Absence is only trusted in a complete snapshot of the latest generation."""
    return not truncated and parse_gaps == 0 and generation == latest_generation


def reconcile(state: DataFrame, observed: DataFrame, snapshot: str, resolve_missing: bool = True) -> DataFrame:
    """state (finding_id, first_seen, last_seen, evidence_state, resolved_snapshot) against observed (finding_id): the new state with
    event_type (null where nothing happened)."""
    seen = observed.select("finding_id").distinct().withColumn("seen", F.lit(True))
    rows = state.withColumn("had", F.lit(True)).join(seen, "finding_id", "full_outer")
    had, now = F.col("had").isNotNull(), F.col("seen").isNotNull()
    again = F.col("evidence_state").eqNullSafe("active") & F.col("last_seen").eqNullSafe(snapshot)
    gone = F.lit(resolve_missing) & had & ~now & (F.col("evidence_state") == "active")
    event = (
        F.when(now & ~had, "finding-first-seen")
        .when(now & again, F.lit(None))
        .when(now & (F.col("evidence_state") == "resolved"), "finding-reactivated")
        .when(now, "finding-evidence-updated")
        .when(gone, "finding-resolved")
    )
    return rows.select(
        "finding_id",
        F.coalesce("first_seen", F.lit(snapshot)).alias("first_seen"),
        F.when(now, F.lit(snapshot)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(now, "active").when(gone, "resolved").otherwise(F.col("evidence_state")).alias("evidence_state"),
        F.when(now, F.lit(None)).when(gone, F.lit(snapshot)).otherwise(F.col("resolved_snapshot")).alias("resolved_snapshot"),
        event.alias("event_type"),
    )


def events_of(reconciled: DataFrame, snapshot: str) -> DataFrame:
    """Rows for the append-only event table."""
    return reconciled.where(F.col("event_type").isNotNull()).select("finding_id", "event_type", F.lit(snapshot).alias("snapshot_id"))


def apply_reviews(reviews: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (finding_id, expected_version, review_status) against reviews (finding_id, version, review_status). An update whose version is not
    the current one is a conflict and changes nothing."""
    rows = reviews.join(updates.select("finding_id", "expected_version", F.col("review_status").alias("wanted")), "finding_id", "left")
    asked = F.col("expected_version").isNotNull()
    fits = asked & (F.col("expected_version") == F.col("version"))
    return rows.select(
        "finding_id",
        F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(fits, F.col("wanted")).otherwise(F.col("review_status")).alias("review_status"),
        F.when(fits, "applied").when(asked, "conflict").otherwise("untouched").alias("outcome"),
    )


def merge_findings(rows: DataFrame) -> DataFrame:
    """Occurrences of one finding_id as one row: nodes united, the first by (path, line, nodes) for the rest, path and line only if all agree."""
    first = F.struct(F.coalesce("relative_path", F.lit("")), F.coalesce("line", F.lit(0)), "nodes")
    return rows.groupBy("finding_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("nodes")))).alias("nodes"),
        F.min_by("title", first).alias("title"),
        F.when((F.count_distinct("relative_path") == 1) & (F.count("relative_path") == F.count(F.lit(1))), F.min("relative_path")).alias("relative_path"),
        F.when((F.count_distinct("line") == 1) & (F.count("line") == F.count(F.lit(1))), F.min("line")).alias("line"),
    )


def finding_id(repository: Column, rule: Column, version: Column, subject_type: Column, subject_keys: Column) -> Column:
    """Identity of a finding, the digest of its canonical JSON; the snapshot is no part of it."""
    fields = {"repository_id": repository, "rule_id": rule, "rule_version": version, "subject_type": subject_type, "subject_keys": F.array_sort(subject_keys)}
    return stable_digest("repository-review-finding", canonical_json(fields))
