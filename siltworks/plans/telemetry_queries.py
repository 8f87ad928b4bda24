"""Metrics over events: counters, gauges, histograms, spans, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import telemetry as M
from siltworks.plans.registry import query
from siltworks.session import table

_B = ", ".join(str(b) for b in M.BUCKETS)


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 5 <> 0)::DOUBLE * 2 AS total, count(*) FILTER (WHERE event_id % 5 = 0) AS n_rejected FROM events GROUP BY event_type")
def counter_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("inc", F.when(F.col("event_id") % 5 == 0, -1.0).otherwise(2.0))
    return M.counters(e, ["event_type"], "inc")


@query("SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def gauge_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gauges(table(spark, sf_dir, "events"), ["user_id"], "value", ["ts", "event_id"])


@query("SELECT event_type, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END)::BIGINT AS value FROM events GROUP BY event_type")
def gauge_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gauge_deltas(table(spark, sf_dir, "events"), ["event_type"], F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))


@query(f"""
SELECT event_type, le, count(*) FILTER (WHERE value / 10 <= le) AS bucket_count, count(value) AS count FROM events, (SELECT unnest([{_B}])::DOUBLE AS le) GROUP BY event_type, le""")
def histogram_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(table(spark, sf_dir, "events").withColumn("v", F.col("value") / 10), ["event_type"], "v")


@query(f"""
WITH h AS (SELECT event_type, le, count(*) FILTER (WHERE value / 10 <= le) AS c, count(value) AS count FROM events, (SELECT unnest([{_B}])::DOUBLE AS le) GROUP BY event_type, le)
SELECT event_type, le, (sum(c) OVER (PARTITION BY event_type ORDER BY le))::BIGINT AS bucket_count, count FROM h""")
def histogram_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(table(spark, sf_dir, "events").withColumn("v", F.col("value") / 10), ["event_type"], "v", compat_double_cumulative=True)


@query("SELECT event_type, user_id % 2 = 0 AS ok, count(*) AS n, round(sum(value), 4) AS seconds, max(value) AS longest FROM events GROUP BY ALL")
def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spans_summary(table(spark, sf_dir, "events").withColumn("ok", F.col("user_id") % 2 == 0), ["event_type", "ok"], "value")


@query("""
WITH c AS (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 11 = 0 THEN 'degraded' ELSE 'ok' END AS s FROM events)
SELECT user_id, count(*) FILTER (WHERE s = 'ok') AS n_ok, count(*) FILTER (WHERE s = 'degraded') AS n_degraded, count(*) FILTER (WHERE s = 'error') AS n_error,
  CASE max(CASE s WHEN 'error' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'degraded' ELSE 'ok' END AS worst FROM c GROUP BY user_id""")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 97 == 0, "error").when(F.col("event_id") % 11 == 0, "degraded").otherwise("ok")
    return M.health(table(spark, sf_dir, "events").withColumn("s", status), ["user_id"], "s")


@query("""
SELECT 0 AS part, '# HELP events_total Events seen.' AS line UNION ALL SELECT 1, '# TYPE events_total counter'
UNION ALL SELECT 2, 'events_total{event_type="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type""")
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return M.prometheus_lines("events_total", "Events seen.", "counter", counts, ["event_type"], "n")


@query("""
WITH e AS (SELECT *, event_id % 3 <> 0 AS bad FROM events), s AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM e),
r AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, since ORDER BY ts, event_id) AS row FROM s)
SELECT event_id, CASE WHEN row >= 1 THEN 'degraded' WHEN since > 0 THEN 'healthy' ELSE 'running' END AS state FROM r""")
def crawl_health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.crawl_health(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_id") % 3 != 0).select("event_id", "state")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.last_events(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n_callbacks FROM events GROUP BY event_type")
def hook_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_callbacks"))


@query("""
SELECT event_type, (epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: windowed analytics over events."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "mean")


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM g GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions apart by half an hour."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")
