"""Source mixing in two levels, and rows that share a doc_id or have none."""

import os

import duckdb
from pyspark.sql import functions as F
from siltworks.llm import mixing

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    return sorted((x["doc_id"] if x["doc_id"] == x["doc_id"] else None, x["size"], x["source_size"], round(x["target"], 6), x["taken"]) for x in frame.to_dict("records"))


def test_rows_of_shards_like_sql(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "DOCS_PER_SHARD", 8)
    monkeypatch.setattr(mixing, "SHARDS_PER_ROW", 4)
    monkeypatch.setattr(mixing, "BLOCKS_PER_GROUP", 16)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    ours, theirs = rows(mixing.mix(docs).toPandas()), rows(con.execute(mixing.oracle_sql()).df())
    assert ours == theirs and len(ours) == docs.count()
    for source in {x[2:4] for x in ours}:
        taken = sum(x[4] for x in ours if x[2:4] == source)
        assert abs(taken - source[1]) <= max(80, 0.02 * source[1])


def test_rows_without_ids_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_SHARD", 100)
    held = {}
    keep = mixing.scratch
    monkeypatch.setattr(mixing, "scratch", lambda df, tag: held.setdefault(tag, keep(df, tag)))
    docs = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("words of "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    assert mixing.mix(docs).count() == 2000
    counts = held["sizes"].groupBy((F.col("mx_hash") % 20).alias("shard")).count().collect()
    assert len(counts) == 20 and max(r["count"] for r in counts) < 200
