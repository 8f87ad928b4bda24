"""Crawl streams over restarts against their batch twins. They need a state store that is fixed when a session starts a stream."""

import random
import time

import pytest
from siltworks.operators import crawling, telemetry
from siltworks.streaming import crawls

SCHEMA = "crawl string, place long, kind string, url string, detail string"


@pytest.fixture
def stores(spark):
    for key, value in crawls.STATE_STORE.items():
        spark.conf.set(key, value)
    yield
    for key in crawls.STATE_STORE:
        spark.conf.unset(key)


def batches(seed, n=3):
    r = random.Random(seed)
    kinds = ["page", "skip", "error", "finished", "failed", "start", "other"]
    rows = [("start" if not i else r.choices(kinds, [6, 6, 3, 1, 1, 1, 1])[0], i) for i in range(60)]
    every = [(c, i, kind, f"http://{c}/{i}" if kind != "start" else None, f"e{i}" if kind == "error" else None) for c in ("a", "b") for kind, i in rows[: 60 if c == "a" else 25]]
    cut = [[x for x in every if k * 20 <= x[1] < (k + 1) * 20] for k in range(n)]
    for part in cut:
        r.shuffle(part)
    return every, cut


def run(spark, folder, tmp_path, make, name):
    """The rows that one start of the stream over all new files writes."""
    got = []
    stream = make(spark.readStream.schema(SCHEMA).parquet(folder))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return got


def test_health_over_restarts(spark, stores, tmp_path):
    every, parts = batches(1)
    folder, state = f"{tmp_path}/in", {}
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for r in run(spark, folder, tmp_path, crawls.crawl_health, "health"):
            state[r.crawl] = tuple(r)[1:]
    want = {}
    for r in crawling.crawl_health(spark.createDataFrame(every, SCHEMA)).orderBy("place").collect():
        want[r.crawl] = (r.place, r.state, r.last_error, r.last_error_url, r.pages, r.skips, r.last_page)
    assert state == want


def test_state_goes_after_a_finish(spark, stores, tmp_path):
    folder, got = f"{tmp_path}/in", []
    spark.createDataFrame([("a", 1, "page", "u", None), ("a", 2, "finished", None, None)], SCHEMA).coalesce(1).write.parquet(folder)
    stream = crawls.crawl_health(spark.readStream.schema(SCHEMA).parquet(folder), keep_ms=500)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(lambda df, _: got.extend(df.collect())).trigger(processingTime="200 milliseconds").start()
    try:
        for wanted, row in ((1, ("a", 3, "skip", "v", "robots")), (2, None)):
            for _ in range(300):
                if len(got) >= wanted:
                    break
                time.sleep(0.1)
            if row:
                time.sleep(3)  # the timer rings
                spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    finally:
        query.stop()
    assert [(r.place, r.state, r.pages, r.skips) for r in got] == [(2, "healthy", 1, 0), (3, "idle", 0, 1)]


def test_last_events_over_restarts(spark, stores, tmp_path):
    every, parts = batches(2)
    folder, state = f"{tmp_path}/in", {}
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        fresh = {}
        for r in run(spark, folder, tmp_path, lambda df: crawls.last_events(df, 13), "tail"):
            fresh.setdefault(r.crawl, []).append(tuple(r))
        state |= fresh
    batch = telemetry.last_events(spark.createDataFrame(every, SCHEMA), ["crawl"], ["place"], 13).collect()
    assert sorted(x for rows in state.values() for x in rows) == sorted(map(tuple, batch))
    assert all(len(rows) == 13 for rows in state.values())


def test_one_error_degrades_and_a_page_heals():
    fold = crawls.fold_health
    idle = ("idle", None, None, 0, 0, None)
    assert fold(idle, iter([("error", "u", "boom")])) == ("degraded", "boom", "u", 0, 0, None)
    assert fold(idle, iter([("start", None, None), ("error", "u", "boom"), ("finished", None, None)]))[0] == "degraded"
    assert fold(idle, iter([("error", "u", "boom"), ("page", "v", None)])) == ("healthy", None, None, 1, 0, "v")
    assert fold(idle, iter([("skip", "u", "robots")])) == ("idle", None, None, 0, 1, None)
