"""Records, overviews and small rules over the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import html as H
from siltworks.operators import diffing as D
from siltworks.operators import lifecycle as L
from siltworks.operators import posts as P
from siltworks.plans.registry import query
from siltworks.session import table


@query("SELECT p_name AS title, '' AS before, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS after FROM part WHERE p_partkey % 3 <> 0")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    post = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("content"))
    return P.training_rows(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_list(post).alias("posts")), "posts", "title", "content")


@query("SELECT o_orderkey, o_orderkey || '~' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END || '~' || o_orderpriority AS line FROM orders")
def detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("s", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    return o.select("o_orderkey", P.detail_line(["o_orderkey", "s", "o_orderpriority"]).alias("line"))


@query("""
SELECT p_partkey, 'warm' AS category FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'hot') UNION ALL SELECT p_partkey, 'metal' FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'ring')
UNION ALL SELECT p_partkey, 'Uncategorized' FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'hot') OR contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'ring'))""")
def categorised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"warm": ["Red", "hot"], "metal": ["bolt", "ring"]}
    return P.categorised(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", rules).select("p_partkey", "category")


@query("SELECT o_orderkey, CASE WHEN split_part(o_orderpriority, '-', 2) IN ('URGENT', 'HIGH') THEN 'first' WHEN split_part(o_orderpriority, '-', 2) = 'LOW' THEN 'last' ELSE 'other' END AS class FROM orders")
def second_part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", P.second_part_class(F.col("o_orderpriority"), {"last": ["LOW"], "first": ["URGENT", "HIGH"]}).alias("class"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 < 2")
def preset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit(".js"), F.lit(".tsx"), F.lit(".py"), F.lit(".md")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").where(P.in_preset(F.concat(F.lit("f"), suffix), "js")).select("p_partkey")


@query("SELECT c_custkey, c_name AS title, c_mktsegment AS body, '' AS note FROM customer")
def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Title: "), F.col("c_name"), F.lit("\nBody:\n"), F.col("c_mktsegment"), F.lit("\n"))
    parts = P.labelled_sections(text, ["Title", "Body", "Note"])
    clean = {k: F.regexp_replace(v, r"\s+$", "") for k, v in parts.items()}
    return table(spark, sf_dir, "customer").select("c_custkey", clean["Title"].alias("title"), clean["Body"].alias("body"), clean["Note"].alias("note"))


@query("SELECT event_type, median(value) AS median, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY event_type")
def repeated_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.medians(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.5::DOUBLE AS starts_after FROM events")
def rate_limited_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fixed_interval_schedule(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 0.5).select("event_id", "starts_after")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overview({"orders": table(spark, sf_dir, "orders"), "parts": table(spark, sf_dir, "part"), "events": table(spark, sf_dir, "events")})


@query("SELECT o_orderstatus AS relationship_type, o_orderpriority AS resolution_status, count(*) AS n FROM orders GROUP BY ALL")
def relationship_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("o_orderstatus").alias("relationship_type"), F.col("o_orderpriority").alias("resolution_status")]
    return table(spark, sf_dir, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 5 < 2 THEN 'schema-too-old' END, CASE WHEN o_orderstatus = 'P' THEN 'truncated' END, CASE WHEN o_orderkey % 3 > 0 THEN 'parse-gaps' END) AS limitations FROM orders""")
def evidence_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.evidence_status(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 3, F.col("o_custkey") % 5, 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("limitations"))


@query("""
SELECT o_orderkey, sha256('repository-review-finding' || chr(0) || '{"repository_id":"repo","rule_id":"rule","rule_version":"1","subject_keys":["' || least(o_orderstatus, o_orderpriority) || '","'
  || greatest(o_orderstatus, o_orderpriority) || '"],"subject_type":"order"}' || chr(10)) AS finding_id FROM orders""")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = L.finding_id(F.lit("repo"), F.lit("rule"), F.lit("1"), F.lit("order"), F.array("o_orderstatus", "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("finding_id"))


@query("""
WITH s AS (SELECT o_orderkey AS finding_id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS finding_id FROM orders WHERE o_orderkey % 3 = 0)
SELECT COALESCE(s.finding_id, b.finding_id) AS finding_id, CASE WHEN s.finding_id IS NULL THEN 'finding-first-seen' WHEN b.finding_id IS NOT NULL THEN 'finding-evidence-updated' ELSE 'finding-resolved' END AS event_type, 's9' AS snapshot_id
FROM s FULL JOIN b ON s.finding_id = b.finding_id""")
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "finding_id")
    state = o.where("finding_id % 2 = 0").select("finding_id", F.lit("s1").alias("first_seen"), F.lit("s1").alias("last_seen"), F.lit("active").alias("evidence_state"), F.lit(None).cast("string").alias("resolved_snapshot"))
    return L.events_of(L.reconcile(state, o.where("finding_id % 3 = 0"), "s9"), "s9")


@query("""
WITH s AS (SELECT o_orderkey AS finding_id, 's1' AS last_seen FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS finding_id FROM orders WHERE o_orderkey % 3 = 0)
SELECT COALESCE(s.finding_id, b.finding_id) AS finding_id, 'active' AS evidence_state, CASE WHEN b.finding_id IS NOT NULL THEN 's9' ELSE last_seen END AS last_seen FROM s FULL JOIN b ON s.finding_id = b.finding_id""")
def truncated_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truncated snapshot resolves nothing."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "finding_id")
    state = o.where("finding_id % 2 = 0").select("finding_id", F.lit("s1").alias("first_seen"), F.lit("s1").alias("last_seen"), F.lit("active").alias("evidence_state"), F.lit(None).cast("string").alias("resolved_snapshot"))
    return L.reconcile(state, o.where("finding_id % 3 = 0"), "s9", L.may_resolve(True, 0, 1, 1)).select("finding_id", "evidence_state", "last_seen")


@query("""
SELECT page_id, len(list_filter(string_split(html, '<p>'), lambda x: length(x) = 0))::INT AS n_empty, length(html) > 2000 AS long FROM pages""")
def page_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.size(F.filter(F.split("html", "<p>", -1), lambda x: F.length(x) == 0))
    return table(spark, sf_dir, "pages").select("page_id", empty.alias("n_empty"), (F.length("html") > 2000).alias("long"))


@query()
def bad_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: sections are cut by a lookahead."""
    return table(spark, sf_dir, "pages").select("page_id", H.bad_sections(F.col("html"), "p").alias("bad"))
