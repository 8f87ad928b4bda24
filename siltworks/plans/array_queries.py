"""Arrays, vectors, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import values as V
from siltworks.operators import similarity as S
from siltworks.plans.registry import query
from siltworks.session import table


@query("SELECT event_id, lv::VARCHAR AS \"window\" FROM (SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS lv FROM events) WHERE len(lv) = 3")
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.rolling_windows(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id", 3)
    return rows.select("event_id", F.concat(F.lit("["), F.array_join(F.col("window").cast("array<string>"), ", "), F.lit("]")).alias("window"))


@query("""
SELECT conv_id, batch, list(turn ORDER BY turn, rn)::VARCHAR AS items FROM (SELECT conv_id, turn, rn, (rn - 1) // 2 AS batch FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations)) GROUP BY conv_id, batch""")
def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.batched(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "turn", 2)
    return rows.select("conv_id", "batch", F.concat(F.lit("["), F.array_join(F.col("items").cast("array<string>"), ", "), F.lit("]")).alias("items"))


@query("""
WITH n AS (SELECT sqrt(sum(p_retailprice * p_retailprice)) AS a, sqrt(sum(p_size * p_size)) AS b FROM part) SELECT p_partkey, round(p_retailprice / a, 9) AS price, round(p_size / b, 9) AS size FROM part, n""")
def column_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return V.normalise_columns(p, ["price", "size"]).select("p_partkey", F.round("price", 9).alias("price"), F.round("size", 9).alias("size"))


@query("""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 9).alias("similarity"))


@query("""
WITH u AS (SELECT vec_id, i, embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)),
s AS (SELECT i, sum(x) AS t FROM u GROUP BY i) SELECT vec_id, round((sum(x * t) - 1) / ((SELECT count(*) FROM embeddings) - 1), 6) AS average FROM u JOIN s USING (i) GROUP BY vec_id""")
def average_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.average_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("average", F.round("average", 6))


_TFIDF = r"""
w AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS word FROM benchmark), tf AS (SELECT item_id, word, count(*) AS tf FROM w GROUP BY ALL),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY word), r AS (SELECT item_id, word, tf * idf AS w FROM tf JOIN idf USING (word)),
n AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM r GROUP BY item_id), v AS (SELECT item_id, word, w / norm AS weight FROM r JOIN n USING (item_id))"""


@query(f"WITH {_TFIDF} SELECT item_id, word, round(weight, 9) AS weight FROM v")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tf_idf(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 9))


@query(f"""
WITH {_TFIDF}, s AS (SELECT word, sum(weight) AS t FROM v GROUP BY word)
SELECT b.item_id, round((COALESCE(sum(weight * t), 0) - 1) / ((SELECT count(*) FROM benchmark) - 1), 6) AS average FROM benchmark b LEFT JOIN v ON b.item_id = v.item_id LEFT JOIN s ON v.word = s.word GROUP BY b.item_id""")
def average_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return S.average_similarity(S.tf_idf(b, "item_id", "text"), "item_id", b).withColumn("average", F.round("average", 6))


@query("""
WITH z AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_brand = (SELECT min(p_brand) FROM part)) AS zeros FROM part)
SELECT p_partkey, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN -1 ELSE n - zeros - 1 END / (n - 1) AS average FROM part, z""")
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_similarity(table(spark, sf_dir, "part"), "p_partkey", "p_brand")


@query("""
WITH z AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_brand = (SELECT min(p_brand) FROM part)) AS zb, count(*) FILTER (WHERE p_type = (SELECT min(p_type) FROM part)) AS zt FROM part)
SELECT p_partkey, (0.5 * (CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN -1 ELSE n - zb - 1 END / (n - 1)) + 0.5 * (CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN -1 ELSE n - zt - 1 END / (n - 1)))
  * CASE WHEN p_brand = 'Brand#11' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM part, z""")
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = S.label_similarity(p, "p_partkey", "p_brand")
    b = S.label_similarity(p, "p_partkey", "p_type").join(p.select("p_partkey", F.col("p_brand").alias("sector")), "p_partkey")
    return S.blend(a, b, "p_partkey", spark.createDataFrame([("Brand#11", 1.5)], "sector string, weight double"))


@query("""
SELECT c_custkey, (sign(c_acctbal) * floor(abs(c_acctbal)))::BIGINT AS degrees, floor((abs(c_acctbal) - floor(abs(c_acctbal))) * 60)::BIGINT AS minutes, sqrt((c_custkey - 1)::DOUBLE * (c_custkey - 1) + 4) AS distance FROM customer""")
def sexagesimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("s", V.to_sexagesimal(F.col("c_acctbal")))
    far = V.distance(F.lit(1.0), F.lit(0.0), F.col("c_custkey").cast("double"), F.lit(2.0))
    return c.select("c_custkey", "s.degrees", "s.minutes", far.alias("distance"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 2 * 100000 THEN 'high' WHEN o_totalprice > 1.5 * 100000 THEN 'medium' ELSE 'low' END AS severity FROM orders")
def threshold_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", V.threshold_severity(F.col("o_totalprice"), F.lit(100000)).alias("severity"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_custkey % 5 = 0 THEN 'error' WHEN o_custkey % 3 = 0 THEN 'warning' ELSE 'ok' END AS severity,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus = 'F' OR o_custkey % 5 = 0 WHEN o_orderkey % 3 = 1 THEN o_orderstatus = 'F' OR o_custkey % 5 = 0 OR o_custkey % 3 = 0 ELSE false END AS fails FROM orders""")
def severity_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sev = V.report_severity(F.when(F.col("o_orderstatus") == "F", " Failed ").otherwise("passed"), F.lit(False), F.when(c % 5 == 0, 2), c % 3 == 0)
    on = F.when(k % 3 == 0, "error").when(k % 3 == 1, "warning").otherwise("never")
    return table(spark, sf_dir, "orders").select("o_orderkey", sev.alias("severity"), V.should_fail(sev, on).alias("fails"))


@query("""
SELECT p_partkey, list_sort(list_distinct([p_brand, p_type, p_brand]))::VARCHAR AS labels FROM part WHERE p_type NOT LIKE '% %'
UNION ALL SELECT p_partkey, list_sort(list_distinct([p_brand, p_type, p_brand]))::VARCHAR FROM part WHERE p_type LIKE '% %'""")
def pipe_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = V.pipe_list(F.concat_ws("|", "p_brand", F.concat(F.lit(" "), F.col("p_type")), "p_brand"))
    quoted = F.transform(lists, lambda x: F.when(x.rlike(r"[\s,'\"\[\]{}()\\:=]"), F.concat(F.lit("'"), x, F.lit("'"))).otherwise(x))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("labels"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, octet_length(encode(props))::INT AS n_bytes FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.octet_length("props").alias("n_bytes"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts END AS parsed, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, CASE WHEN event_id % 3 = 0 THEN 120.0 ELSE NULL END AS wait FROM events""")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("not a time")
    wait = V.retry_after_seconds(F.when(F.col("event_id") % 3 == 0, "120").otherwise("later"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(text).alias("parsed"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), wait.alias("wait"))
