"""Differences between two snapshots, with absence kept apart from removal where a side is incomplete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.values import canonical_json, metric_delta, stable_digest

# Fixed value: version of what delta ids stand for.
COMPARISON_FORMAT_VERSION = "2"

SECTIONS = ("files", "symbols", "relationships", "cycles", "metrics", "findings")
CHANGES = ("added", "removed", "changed", "not-observed-in-baseline", "not-observed-in-target")


def last_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row in load order of each logical key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def change_type(has_old: Column, has_new: Column, equal: Column, baseline_uncertain: bool, target_uncertain: bool) -> Column:
    return (
        F.when(~has_old, "not-observed-in-baseline" if baseline_uncertain else "added")
        .when(~has_new, "not-observed-in-target" if target_uncertain else "removed")
        .when(equal, "unchanged")
        .otherwise("changed")
    )


def snapshot_diff(
    old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str], baseline_uncertain: bool = False, target_uncertain: bool = False, unchanged: bool = False
) -> DataFrame:
    """key, change_type and both sides' fields (old_x, new_x). A present row of nulls is not an absent one."""
    left = old.select(*[F.col(k).alias(f"o_{k}") for k in key], F.struct(*fields).alias("o"), F.lit(True).alias("has_o"))
    right = new.select(*[F.col(k).alias(f"n_{k}") for k in key], F.struct(*fields).alias("n"), F.lit(True).alias("has_n"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    joined = left.join(right, same, "full_outer")
    kind = change_type(F.col("has_o").isNotNull(), F.col("has_n").isNotNull(), F.col("o").eqNullSafe(F.col("n")), baseline_uncertain, target_uncertain)
    out = joined.select(
        *[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in key],
        kind.alias("change_type"),
        *[F.col(f"o.{f}").alias(f"old_{f}") for f in fields],
        *[F.col(f"n.{f}").alias(f"new_{f}") for f in fields],
    )
    return out if unchanged else out.where("change_type <> 'unchanged'")


def delta_id(section: Column, logical_key: Column, change_type: Column, baseline: Column, target: Column) -> Column:
    """Identity of a difference: the digest of its canonical JSON. baseline and target are structs (fields in order of name), booleans or strings, null where a
    side has nothing."""
    fields = {"format_version": F.lit(COMPARISON_FORMAT_VERSION), "section": section, "logical_key": logical_key, "change_type": change_type, "baseline": baseline, "target": target}
    return stable_digest("comparison-delta", canonical_json(fields))


def section_deltas(diff: DataFrame, section: str, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows of snapshot_diff as differences of a section: section, logical_key (keys joined by |), change_type, delta_id and both sides' fields."""
    logical = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    gone, new = F.col("change_type").isin("removed", "not-observed-in-target"), F.col("change_type").isin("added", "not-observed-in-baseline")
    side = lambda name: F.struct(*[F.col(f"{name}_{f}").alias(f) for f in sorted(fields)])
    identity = delta_id(F.lit(section), logical, F.col("change_type"), F.when(~new, side("old")), F.when(~gone, side("new")))
    return diff.select(F.lit(section).alias("section"), logical.alias("logical_key"), "change_type", identity.alias("delta_id"), *[f"{s}_{f}" for f in fields for s in ("old", "new")])


def occurrence_diff(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str], **uncertain: bool) -> DataFrame:
    """Multisets aligned by occurrence: the n-th row of a key on one side meets the n-th on the other."""
    numbered = [s.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order))) for s in (old, new)]
    return snapshot_diff(*numbered, [*key, "occurrence"], fields, **uncertain)


def metric_diff(old: DataFrame, new: DataFrame, key: Sequence[str], value: str, **uncertain: bool) -> DataFrame:
    rows = snapshot_diff(old, new, key, [value], **uncertain)
    delta = metric_delta(F.col(f"old_{value}"), F.col(f"new_{value}"))
    return rows.withColumn("d", delta).select(*key, "change_type", f"old_{value}", f"new_{value}", "d.absolute", "d.direction", "d.percent")


def counts_matrix(deltas: DataFrame, section: str = "section", kind: str = "change_type") -> DataFrame:
    """One row per section with a count for every kind of change, zero where there is none."""
    spread = deltas.groupBy(section).agg(*[F.count_if(F.col(kind) == c).alias(c.replace("-", "_")) for c in CHANGES])
    domain = deltas.sparkSession.createDataFrame([(s,) for s in SECTIONS], f"{section} string")
    return domain.join(spread, section, "left").select(section, *[F.coalesce(c.replace("-", "_"), F.lit(0)).alias(c.replace("-", "_")) for c in CHANGES])


def compatibility(baseline_version: Column, target_version: Column, needed: int, b_truncated: Column, t_truncated: Column, b_gaps: Column, t_gaps: Column) -> tuple[Column, Column]:
    """(status, reasons): unavailable below the needed version, partial with the reasons, else supported."""
    reasons = F.array_compact(
        F.array(
            F.when(baseline_version != target_version, F.lit("version-mismatch")),
            F.when(b_truncated, F.lit("baseline-truncated")),
            F.when(t_truncated, F.lit("target-truncated")),
            F.when(b_gaps > 0, F.lit("baseline-parse-gaps")),
            F.when(t_gaps > 0, F.lit("target-parse-gaps")),
        )
    )
    status = F.when((baseline_version < needed) | (target_version < needed), "unavailable").when(F.size(reasons) > 0, "partial").otherwise("supported")
    return status, reasons


def evidence_status(truncated: Column, parse_gaps: Column, version: Column, needed: int) -> Column:
    """Limitations of one snapshot, in fixed order."""
    return F.array_compact(
        F.array(
            F.when(version < needed, F.lit("schema-too-old")),
            F.when(truncated, F.lit("truncated")),
            F.when(parse_gaps > 0, F.lit("parse-gaps")),
        )
    )
