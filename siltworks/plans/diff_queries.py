"""Snapshot differences, findings over time and reviews. Even and odd shares of the order tables stand for two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import diffing as D
from siltworks.operators import handoff as Hand
from siltworks.operators import lifecycle as L
from siltworks.plans.registry import query
from siltworks.session import scratch, table

_OLD = "o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 0)"
_NEW = "n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 9 <> 0)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k, s, v = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    old = o.where(k % 10 != 0).select(k.alias("k"), s.alias("s"), v.alias("v"))
    new = o.where(k % 9 != 0).select(k.alias("k"), F.when(k % 7 == 0, "X").otherwise(s).alias("s"), F.when(k % 11 == 0, v * 2).otherwise(v).alias("v"))
    return old, new


_KIND = "CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.s = n.s THEN 'unchanged' ELSE 'changed' END"


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM (SELECT COALESCE(o.k, n.k) AS k, {_KIND} AS change_type, o.s AS old_s, n.s AS new_s FROM o FULL JOIN n ON o.k = n.k) WHERE change_type <> 'unchanged'")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.snapshot_diff(*_sides(spark, sf_dir), ["k"], ["s"])


_DELTAS = f"""
x AS (SELECT COALESCE(o.k, n.k) AS k, {_KIND} AS change_type, o.k IS NOT NULL AS has_o, n.k IS NOT NULL AS has_n, o.s AS os, n.s AS ns, o.v AS ov, n.v AS nv FROM o FULL JOIN n ON o.k = n.k),
d AS (SELECT k::VARCHAR AS logical_key, change_type, sha256('comparison-delta' || chr(0) || '{{"baseline":' || CASE WHEN has_o THEN '{{"s":"' || os || '"}}' ELSE 'null' END || ',"change_type":"' || change_type || '","format_version":"2","logical_key":"' || k
  || '","section":"files","target":' || CASE WHEN has_n THEN '{{"s":"' || ns || '"}}' ELSE 'null' END || '}}' || chr(10)) AS delta_id FROM x WHERE change_type <> 'unchanged')"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.section_deltas(D.snapshot_diff(*_sides(spark, sf_dir), ["k"], ["s"]), "files", ["k"], ["s"])


@query(f"WITH {_OLD}, {_NEW}, {_DELTAS} SELECT 'files' AS section, logical_key, change_type, delta_id FROM d")
def comparison_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two states of all orders, with their ids."""
    return _deltas(spark, sf_dir).select("section", "logical_key", "change_type", "delta_id")


@query(f"""
WITH {_OLD}, {_NEW}, {_DELTAS}, c AS (SELECT * FROM d ORDER BY logical_key, delta_id LIMIT 60)
SELECT logical_key, delta_id, 60::BIGINT AS n_total, 10::BIGINT AS n_omitted FROM c ORDER BY logical_key, delta_id LIMIT 50""")
def selected_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of sixty differences, of which an export takes fifty."""
    deltas = scratch(_deltas(spark, sf_dir), "deltas")
    ids = [r["delta_id"] for r in deltas.orderBy("logical_key", "delta_id").limit(60).collect()]
    return Hand.selected(deltas, ids, ["files"]).select("logical_key", "delta_id", "n_total", "n_omitted")


@query(f"""
WITH {_OLD}, {_NEW} SELECT * FROM (SELECT COALESCE(o.k, n.k) AS k, replace({_KIND}, 'removed', 'not-observed-in-target') AS change_type, o.s AS old_s, n.s AS new_s FROM o FULL JOIN n ON o.k = n.k) WHERE change_type <> 'unchanged'""")
def truncated_target_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.snapshot_diff(*_sides(spark, sf_dir), ["k"], ["s"], target_uncertain=True)


@query(f"""
WITH {_OLD}, {_NEW} SELECT * FROM (SELECT COALESCE(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change_type, o.v AS old_v, n.v AS new_v, n.v - o.v AS absolute,
  CASE WHEN n.v > o.v THEN 'increase' WHEN n.v < o.v THEN 'decrease' ELSE 'not-comparable' END AS direction, CASE WHEN o.v <> 0 THEN (n.v - o.v) / o.v * 100 END AS percent
FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v)""")
def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.metric_diff(*_sides(spark, sf_dir), ["k"], "v")


_PAIRS = "SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber)::INT AS occurrence FROM lineitem WHERE l_linestatus = '{}'"


@query(f"""
WITH o AS ({_PAIRS.format('F')}), n AS ({_PAIRS.format('O')})
SELECT * FROM (SELECT COALESCE(o.src, n.src) AS src, COALESCE(o.dst, n.dst) AS dst, COALESCE(o.occurrence, n.occurrence) AS occurrence,
  CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'removed' WHEN o.q = n.q THEN 'unchanged' ELSE 'changed' END AS change_type, o.q AS old_q, n.q AS new_q
  FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst AND o.occurrence = n.occurrence) WHERE change_type <> 'unchanged'""")
def occurrence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_linestatus")
    return D.occurrence_diff(items.where("l_linestatus = 'F'"), items.where("l_linestatus = 'O'"), ["src", "dst"], ["q", "l_orderkey", "l_linenumber"], ["q"])


@query(f"""
WITH {_OLD}, {_NEW}, d AS (SELECT 'files' AS section, {_KIND} AS c FROM o FULL JOIN n ON o.k = n.k UNION ALL
  SELECT 'metrics', CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v = n.v THEN 'unchanged' ELSE 'changed' END FROM o FULL JOIN n ON o.k = n.k)
SELECT s.section, count(*) FILTER (WHERE c = 'added') AS added, count(*) FILTER (WHERE c = 'removed') AS removed, count(*) FILTER (WHERE c = 'changed') AS changed,
  0::BIGINT AS not_observed_in_baseline, 0::BIGINT AS not_observed_in_target
FROM (VALUES ('files'), ('symbols'), ('relationships'), ('cycles'), ('metrics'), ('findings')) s(section) LEFT JOIN d ON s.section = d.section GROUP BY s.section""")
def comparison_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _sides(spark, sf_dir)
    deltas = D.snapshot_diff(old, new, ["k"], ["s"]).select(F.lit("files").alias("section"), "change_type")
    return D.counts_matrix(deltas.unionByName(D.snapshot_diff(old, new, ["k"], ["v"]).select(F.lit("metrics").alias("section"), "change_type")))


@query("""
SELECT o_orderkey, CASE WHEN b < 3 OR t < 3 THEN 'unavailable' WHEN b <> t OR tr OR g > 0 THEN 'partial' ELSE 'supported' END AS status,
  concat_ws(',', CASE WHEN b <> t THEN 'version-mismatch' END, CASE WHEN tr THEN 'target-truncated' END, CASE WHEN g > 0 THEN 'baseline-parse-gaps' END) AS reasons
FROM (SELECT o_orderkey, o_orderkey % 4 + 2 AS b, o_custkey % 4 + 2 AS t, o_orderstatus = 'P' AS tr, o_orderkey % 3 AS g FROM orders)""")
def section_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status, reasons = D.compatibility(k % 4 + 2, c % 4 + 2, 3, F.lit(False), F.col("o_orderstatus") == "P", k % 3, F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query("""
WITH s AS (SELECT o_orderkey AS finding_id, 's1' AS first_seen, CASE WHEN o_orderkey % 6 = 0 THEN 's3' ELSE 's2' END AS last_seen, CASE WHEN o_orderstatus = 'P' THEN 'resolved' ELSE 'active' END AS evidence_state,
  CASE WHEN o_orderstatus = 'P' THEN 's2' END AS resolved_snapshot FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS finding_id FROM orders WHERE o_orderkey % 3 = 0)
SELECT COALESCE(s.finding_id, b.finding_id) AS finding_id, COALESCE(first_seen, 's3') AS first_seen, CASE WHEN b.finding_id IS NOT NULL THEN 's3' ELSE last_seen END AS last_seen,
  CASE WHEN b.finding_id IS NOT NULL THEN 'active' ELSE 'resolved' END AS evidence_state, CASE WHEN b.finding_id IS NOT NULL THEN NULL WHEN evidence_state = 'active' THEN 's3' ELSE resolved_snapshot END AS resolved_snapshot,
  CASE WHEN s.finding_id IS NULL THEN 'finding-first-seen' WHEN b.finding_id IS NOT NULL AND evidence_state = 'active' AND last_seen = 's3' THEN NULL
       WHEN b.finding_id IS NOT NULL AND evidence_state = 'resolved' THEN 'finding-reactivated' WHEN b.finding_id IS NOT NULL THEN 'finding-evidence-updated' WHEN evidence_state = 'active' THEN 'finding-resolved' END AS event_type
FROM s FULL JOIN b ON s.finding_id = b.finding_id""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "finding_id")
    gone = F.col("o_orderstatus") == "P"
    state = o.where("finding_id % 5 <> 0").select(
        "finding_id", F.lit("s1").alias("first_seen"), F.when(F.col("finding_id") % 6 == 0, "s3").otherwise("s2").alias("last_seen"), F.when(gone, "resolved").otherwise("active").alias("evidence_state"), F.when(gone, "s2").alias("resolved_snapshot")
    )
    return L.reconcile(state, o.where("finding_id % 3 = 0"), "s3", L.may_resolve(False, 0, 3, 3))


@query("""
SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 4 = 0 THEN v + 1 ELSE v END AS version, CASE WHEN o_orderkey % 4 = 0 THEN 'confirmed' ELSE 'new' END AS review_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'conflict' ELSE 'untouched' END AS outcome FROM (SELECT o_orderkey, (o_custkey % 3)::INT AS v FROM orders)""")
def review_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    reviews = o.select(F.col("o_orderkey").alias("finding_id"), (F.col("o_custkey") % 3).cast("int").alias("version"), F.lit("new").alias("review_status"))
    wanted = reviews.where("finding_id % 4 < 2").select("finding_id", (F.col("version") + (F.col("finding_id") % 4)).alias("expected_version"), F.lit("confirmed").alias("review_status"))
    return L.apply_reviews(reviews, wanted)


@query("""
SELECT l_partkey AS finding_id, list_sort(list(DISTINCT l_suppkey))::VARCHAR AS nodes, min_by(l_orderkey || '', (l_shipmode, l_linenumber, l_suppkey)) AS title,
  CASE WHEN count(DISTINCT l_shipmode) = 1 THEN min(l_shipmode) END AS relative_path, CASE WHEN count(DISTINCT l_linenumber) = 1 THEN min(l_linenumber) END AS line
FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_linenumber, l_suppkey ORDER BY l_orderkey) = 1) GROUP BY l_partkey""")
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linenumber", "l_suppkey").agg(F.min("l_orderkey").alias("l_orderkey"))
    rows = items.select(
        F.col("l_partkey").alias("finding_id"), F.array("l_suppkey").alias("nodes"), F.col("l_orderkey").cast("string").alias("title"), F.col("l_returnflag").alias("relative_path"), F.col("l_linenumber").alias("line")
    )
    merged = L.merge_findings(rows)
    return merged.withColumn("nodes", F.concat(F.lit("["), F.array_join(F.col("nodes").cast("array<string>"), ", "), F.lit("]")))
