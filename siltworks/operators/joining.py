"""Join shapes of the evidence store, in forms that need no correlated subquery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that is last in order. max_by over the whole row is combined before the shuffle, so no key is
    sorted in one task."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return last.select("row.*")


def with_latest(left: DataFrame, rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with the latest row of its key, nulls where it has none."""
    last = latest_per_key(rows, key, order).select(key, *columns)
    return left.join(last, key, "left")


def current_version(versions: DataFrame, heads: DataFrame, key: str, version: str, head: str) -> DataFrame:
    """Rows whose version is the one that heads names for their key."""
    named = heads.select(F.col(key), F.col(head).alias("cv_head"))
    return versions.join(named, key).where(F.col(version) == F.col("cv_head")).drop("cv_head")


def having_any(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return missing_from(a, b, key).withColumn("side", F.lit("left")).unionByName(missing_from(b, a, key).withColumn("side", F.lit("right")))


def generations(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each row's place within its key, from 1."""
    return rows.withColumn("generation", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def resolve_names(references: DataFrame, targets: DataFrame, name: str, target: str) -> DataFrame:
    """references with resolution_status (resolved-static for one target, ambiguous for several, unresolved-dynamic for none) and the target
    where it is the only one."""
    known = targets.groupBy(F.col(name).alias("rn_name")).agg(F.count_distinct(target).alias("rn_n"), F.min(target).alias("rn_target"))
    joined = references.join(known, F.col(name) == F.col("rn_name"), "left")
    status = F.when(F.col("rn_n") == 1, "resolved-static").when(F.col("rn_n") > 1, "ambiguous").otherwise("unresolved-dynamic")
    return joined.withColumn("resolution_status", status).withColumn("target_id", F.when(F.col("rn_n") == 1, F.col("rn_target"))).drop("rn_name", "rn_n", "rn_target")


def resolve_in_tiers(references: DataFrame, candidates: Sequence[DataFrame], key: str, target: str) -> DataFrame:
    """The candidates of the first tier that has any for a reference: their number and, if one, the target. Each candidate table is
    (key, target); tiers are in order of trust."""
    tagged = None
    for tier, rows in enumerate(candidates):
        one = rows.select(key, target, F.lit(tier).alias("tier"))
        tagged = one if tagged is None else tagged.unionByName(one)
    # Dealt by key once: all that follows is within a key.
    best = tagged.repartition(key).groupBy(key, "tier").agg(F.count_distinct(target).alias("n_targets"), F.min(target).alias("target_id"))
    first = best.groupBy(key).agg(F.min_by(F.struct("tier", "n_targets", "target_id"), "tier").alias("b")).select(key, "b.*")
    return _told(references.join(first, key, "left"), references.columns)


def _told(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns with the tier that was met, its status and confidence, and the target if it is the only one."""
    status = F.when(F.col("n_targets") == 1, "resolved-static").when(F.col("n_targets") > 1, "ambiguous").otherwise("unresolved-dynamic")
    confidence = F.when(F.col("tier") == 0, "high").when(F.col("tier") == 1, "medium").otherwise("low")
    return joined.select(
        *columns, "tier", status.alias("resolution_status"), confidence.alias("confidence"), F.when(F.col("n_targets") == 1, F.col("target_id")).alias("target_id")
    )


def resolve_in_key_tiers(references: DataFrame, candidates: Sequence[tuple[DataFrame, Sequence[str]]], key: str, target: str) -> DataFrame:
    """resolve_in_tiers for tiers that are equal keys: candidates are (rows with target and the keys, keys), references hold all keys and are unique by key. Targets are
    counted for each value of the keys before they meet the references, so no reference is paired with all of its candidates."""
    joined, columns = references, references.columns
    for tier, (rows, keys) in enumerate(candidates):
        names = [f"rt_{tier}_{k}" for k in keys]
        known = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.struct(F.lit(tier).alias("tier"), F.count_distinct(target).alias("n_targets"), F.min(target).alias("target_id")).alias(f"rt_{tier}"))
        on = F.col(key).isNotNull()
        for k, n in zip(keys, names, strict=True):
            on = on & (F.col(k) == F.col(n))
        joined = joined.join(known, on, "left").drop(*names)
    first = F.coalesce(*[F.col(f"rt_{i}") for i in range(len(candidates))])
    return _told(joined.select(*columns, first.alias("rt")).select(*columns, "rt.*"), columns)


def first_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with columns of the first row of right (in order) with an equal normalised key."""
    firsts = right.withColumn("fm_key", right_key).groupBy("fm_key").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("fm"))
    joined = left.withColumn("fm_left", left_key).join(firsts, F.col("fm_left") == F.col("fm_key"), "left")
    return joined.select(*left.columns, *[F.col(f"fm.{c}").alias(c) for c in columns])


def pair_files(files: DataFrame, name: str, content: str, before: str = "_before", after: str = "_after") -> DataFrame:
    """(key, before, after) for names that differ in the mark alone."""
    olds = files.where(F.contains(F.col(name), F.lit(before))).select(F.replace(F.col(name), F.lit(before), F.lit("")).alias("key"), F.col(content).alias("before"))
    news = files.where(F.contains(F.col(name), F.lit(after))).select(F.replace(F.col(name), F.lit(after), F.lit("")).alias("key"), F.col(content).alias("after"))
    return olds.join(news, "key")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows replace old ones of equal key; the others stay."""
    return missing_from(old, new, key).unionByName(new)


def union_by_priority(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows, one per key; a later frame wins."""
    tagged = None
    for i, frame in enumerate(frames):
        one = frame.withColumn("up_i", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    names = [c for c in tagged.columns if c != "up_i"]
    return tagged.groupBy(key).agg(F.max_by(F.struct(*names), "up_i").alias("row")).select("row.*")


def is_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """(is_subset): whether every key of part is one of whole, as one row."""
    missing = part.select(key).join(whole.select(key), key, "left_anti")
    return missing.agg((F.count(F.lit(1)) == 0).alias("is_subset"))


def copies_of_same_size(files: DataFrame, folder: str, name: str, size: str) -> DataFrame:
    """(folder, name, original) of files whose name before the last suffix ends in a copy mark, a blank and one digit in brackets, where a file of the same folder
    has the name without it and the same size. Files without a suffix are no copies."""
    mark = r"^(.*) \([0-9]\)(\.[^.]*)$"
    marked = files.where(F.col(name).rlike(mark)).select(folder, F.col(name).alias("copy"), size, F.concat(F.regexp_extract(name, mark, 1), F.regexp_extract(name, mark, 2)).alias(name))
    return marked.join(files.select(folder, name, size), [folder, name, size]).select(folder, F.col("copy").alias(name), F.col(name).alias("original")).distinct()
