"""Paged listings, directories of named files, running limits, cursors and background jobs."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from siltworks import jobs, session
from siltworks.operators import graph, review, scans, seeking
from siltworks.plans import seek_queries, small_queries
from siltworks.sources import directory, paged, readers

from tests import paged_fetcher

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
OPTIONS = {"fetcher": "tests.paged_fetcher:fetch", "schema": "id string, kind string, n int", "retry_base": "0"}


@pytest.fixture
def log(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    return f"{tmp_path}/log"


def resources(log, *names):
    return json.dumps([f"{n}@{log}" for n in names])


def test_listings_side_by_side(spark, log):
    rows = spark.read.format("siltworks_paged").options(**OPTIONS, resources=resources(log, "a", "busy"), retries="1").load().collect()
    assert sorted((r.id, r.n) for r in rows) == sorted((f"{x}{i}", i) for x in ("a", "busy") for i in range(20))
    seen = [x for x in paged_fetcher.asked(log) if not x.startswith("refused")]
    assert sorted(seen) == sorted(f"{x}:{i}:[]" for x in ("a", "busy") for i in range(5))
    with pytest.raises(Exception, match="try again"):
        spark.read.format("siltworks_paged").options(**OPTIONS, resources=resources(log, "down"), retries="1").load().collect()


def test_equalities_reach_the_fetcher(spark, log):
    for k, v in paged.PUSHDOWN.items():
        spark.conf.set(k, v)
    try:
        frame = spark.read.format("siltworks_paged").options(**OPTIONS, resources=resources(log, "a"), filterable='["kind"]').load()
        got = sorted(r.n for r in frame.where("kind = 'odd' AND n > 5").collect())
    finally:
        for k in paged.PUSHDOWN:
            spark.conf.unset(k)
    assert got == [7, 9, 11, 13, 15, 17, 19]
    assert paged_fetcher.asked(log) == [f"a:{i}:[('kind', 'odd')]" for i in range(5)]


def test_stream_goes_on_after_the_last_page(spark, log, tmp_path):
    got = []

    def run(most):
        stream = spark.readStream.format("siltworks_paged").options(**OPTIONS, resources=resources(log, "s")).load()
        query = stream.writeStream.foreachBatch(lambda df, _: got.append([r.n for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/ck").start()
        try:
            for _ in range(300):
                if sum(map(len, got)) >= most or query.exception():
                    break
                time.sleep(0.1)
            assert not query.exception()
        finally:
            query.stop()

    run(8)
    before = sum(map(len, got))
    run(20)
    assert before >= 8 and sorted(n for batch in got for n in batch) == list(range(20))
    assert [b for b in got if b][0] == [0, 1, 2, 3]
    # The page in flight when the stream stopped may be asked for again; pages of finished batches are not.
    pages = [x.split(":")[1] for x in paged_fetcher.asked(log)]
    assert len(pages) <= 6 and sorted(set(pages)) == list("01234")


def test_named_files_and_index(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([(f"page-{i}", f"text é {i}", f"http://x/{i}", i / 2) for i in range(30)] + [("none", None, None, None)], "name string, text string, url string, at double").repartition(4)
    directory.write_directory(rows, path, index="index.jsonl")
    names = sorted(os.listdir(path))
    assert names == sorted([f"page-{i}{s}" for i in range(30) for s in (".txt", ".json")] + ["none.txt", "none.json", "index.jsonl"])
    assert open(f"{path}/page-3.txt", encoding="utf-8").read() == "text é 3" and open(f"{path}/none.txt").read() == ""
    told = json.load(open(f"{path}/page-3.json"))
    assert told == {"url": "http://x/3", "at": 1.5, "text_bytes": 9, "text_path": f"{path}/page-3.txt"}
    index = [json.loads(x) for x in open(f"{path}/index.jsonl")]
    assert len(index) == 31 and told in index
    directory.write_directory(spark.createDataFrame([("page-3", "new")], "name string, text string"), path, index="index.jsonl")
    assert open(f"{path}/page-3.txt").read() == "new" and len(open(f"{path}/index.jsonl").readlines()) == 32
    directory.write_directory(spark.createDataFrame([("only", "x")], "name string, text string"), path, "overwrite")
    assert sorted(os.listdir(path)) == ["only.json", "only.txt"]


@pytest.mark.parametrize("bad", ["../up", "same", None])
def test_a_failing_job_leaves_nothing(spark, tmp_path, bad):
    path = f"{tmp_path}/out"
    directory.write_directory(spark.createDataFrame([("old", "x")], "name string, text string"), path)
    rows = spark.createDataFrame([(f"n{i}", "t") for i in range(20)] + [("same", "1"), (bad, "2")], "name string, text string").repartition(3)
    with pytest.raises(Exception):  # noqa: B017  Spark's, around ours
        directory.write_directory(rows, path, "overwrite")
    assert sorted(os.listdir(path)) == ["old.json", "old.txt"]


def test_html_pairs_come_back(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "<p>1</p>", "<p>2</p>"), ("b", "x\ny", "<b>")], "key string, before string, after string")
    directory.write_html_pairs(pairs, f"{tmp_path}/pairs")
    assert sorted(os.listdir(f"{tmp_path}/pairs")) == ["a_after.html", "a_before.html", "b_after.html", "b_before.html"]
    assert sorted(tuple(r) for r in readers.read_html_pairs(spark, f"{tmp_path}/pairs").select("key", "before", "after").collect()) == sorted((f"{r.key}.html", r.before, r.after) for r in pairs.collect())


def taken(sizes, most_rows, most_total):
    count = used = 0
    out = []
    for size, ok in sizes:
        fits = ok and count < most_rows and used + size <= most_total
        out.append(fits)
        if fits:
            count, used = count + 1, used + size
    return out


@pytest.mark.parametrize(("seed", "most_rows", "most_total"), [(1, 10**9, 1000), (2, 40, 100_000), (3, 10**9, 0), (4, 0, 5), (5, 10**9, 10**12)])
def test_first_fit_like_loop(spark, seed, most_rows, most_total):
    r = random.Random(seed)
    sizes = [(r.choice([0, 1, 3, r.randrange(60), r.randrange(900), 10**6]), r.random() < 0.9) for _ in range(700)]
    frame = spark.createDataFrame([(i, s, ok) for i, (s, ok) in enumerate(sizes)], "i int, s long, ok boolean").repartition(5)
    got = {x.i: x.fits for x in scans.first_fit(frame, ["i"], "s", most_rows, most_total, F.col("ok"), rows_per_range=90).collect()}
    assert [got[i] for i in range(700)] == taken(sizes, most_rows, most_total)


def test_first_fit_of_a_million_rows(spark):
    sizes = F.when(F.col("id") % 7 == 0, F.col("id") % 100_003).otherwise(F.col("id") % 97)
    rows = spark.range(1_000_000).select("id", sizes.alias("s"))
    got = {x.id for x in scans.first_fit(rows, ["id"], "s", 10**9, 40_000_000).where("fits").select("id").collect()}
    want = taken([((i % 100_003 if i % 7 == 0 else i % 97), True) for i in range(1_000_000)], 10**9, 40_000_000)
    assert got == {i for i, x in enumerate(want) if x}
    session.drop_scratch()


def test_running_limits_query_like_loop(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("source", "doc_id", "text").collect()
    docs.sort(key=lambda d: (d.source or "", d.doc_id))
    want = taken([(len(d.text or ""), True) for d in docs], seek_queries.MOST_FILES, seek_queries.MOST_CHARS)
    got = {r.doc_id: r.fits for r in seek_queries.running_limits(spark, FOLDER).collect()}
    assert got == {d.doc_id: w for d, w in zip(docs, want, strict=True)} and {True, False} == set(want)


def test_pages_by_cursor_are_the_order(spark):
    rows = small_queries._relations(spark, FOLDER).cache()
    keys, cursor, got = seeking.relationship_keys(), None, []
    while part := seeking.page(rows, keys, 200, cursor).collect():
        got += [r.relationship_id for r in part]
        cursor = seeking.cursor_of(part[-1], keys)
    assert got == [r.relationship_id for r in rows.orderBy(*graph.relationship_order()).collect()]
    plan = seeking.page(spark.read.parquet(f"{FOLDER}/events.parquet"), seeking.history_keys(), 5, seeking.cursor_of({"seek_id": 50}, seeking.history_keys()))
    assert "LessThanOrEqual(event_id,50)" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("down", [False, True])
def test_cursors_with_nulls_and_types(spark, down):
    import datetime
    from decimal import Decimal

    r = random.Random(8)
    values = [(i, r.choice([None, Decimal("1.50"), Decimal("-2.00")]), r.choice([None, datetime.date(2020, 1, 2), datetime.date(2021, 1, 2)]), r.choice([None, "é", "a"])) for i in range(60)]
    frame = spark.createDataFrame(values, "id int, d decimal(9,2), t date, s string")
    keys = [seeking.Key("d", F.col("d"), down), seeking.Key("t", F.col("t"), not down), seeking.Key("s", F.col("s"), down), seeking.Key("id", F.col("id"))]
    cursor, got = None, []
    while part := seeking.page(frame, keys, 7, cursor).collect():
        got += [x.id for x in part]
        cursor = seeking.cursor_of(part[-1], keys)
    assert got == [x.id for x in frame.orderBy(*[k.order() for k in keys]).collect()]
    for bad in ("", "zzz", seeking.cursor_of({"seek_id": 1}, seeking.history_keys())):
        with pytest.raises(ValueError, match="cursor"):
            seeking.page(frame, keys, 7, bad)


def sources_of(spark, n):
    files = [(f"pkg{i % 5}/m{i}.py", f"import pkg{(i + 1) % 5}.m{(i * 7) % n}\n\nclass C{i}:\n    def f(self):\n        return {i}\n") for i in range(n)]
    return spark.createDataFrame([(p, t.encode()) for p, t in files], "relative_path string, content binary")


def test_job_runs_and_reports(spark):
    runner = jobs.Jobs(spark)
    one = runner.start(lambda report: (report("counting", 1, 2), session.scratch(spark.range(10)).count())[1])
    bad = runner.start(lambda report: 1 / 0)
    assert runner.wait(one, 120).result == 10 and runner.wait(bad, 120).state == "failed"
    assert {r.job_id: (r.state, r.message.split(":")[0]) for r in runner.table().collect()} == {one: ("completed", ""), bad: ("failed", "ZeroDivisionError")}
    assert any(s[3] == s[4] and not s[6] for s in runner.stages(one))
    kept = [p for p, owner in session._owners.items() if owner == one]
    assert len(kept) == 1
    runner.discard(one)
    assert not os.path.exists(kept[0].removeprefix("file://")) and one not in runner.jobs
    assert runner.cancel("nothing") is None and runner.cancel(bad).state == "failed"
    runner.shutdown()


def test_cancelled_analysis_leaves_no_scratch(spark):
    runner = jobs.Jobs(spark)
    files = sources_of(spark, 60)
    job = runner.start(lambda report: (report("analysing"), review.analyse(files).count()))
    owned = []
    for _ in range(400):
        owned = [p for p, owner in list(session._owners.items()) if owner == job]
        if owned:
            break
        time.sleep(0.05)
    assert owned and runner.jobs[job].state == "started"
    assert runner.cancel(job).phase == "cancelling"
    ended = runner.wait(job, 120)
    assert ended.state == "cancelled" and ended.result is None
    assert job not in session._owners.values() and not any(os.path.exists(p.removeprefix("file://")) for p in owned)
    runner.shutdown()


def test_stream_progress_as_rows(spark, tmp_path):
    told = jobs.StreamProgress(5)
    spark.streams.addListener(told)
    try:
        spark.range(20).write.parquet(f"{tmp_path}/in")
        query = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").groupBy().count().writeStream.outputMode("complete").format("noop").queryName("counted").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if told.ended:
                break
            time.sleep(0.1)
        rows = told.table(spark).collect()
    finally:
        spark.streams.removeListener(told)
    assert sum(r.input_rows for r in rows) == 20 and {r["query"] for r in rows} == {"counted"} and list(told.ended.values()) == [None]
