import pytest
from pyspark.sql import functions as F
from siltworks.operators import code, cycles, diffing, findings, graph, handoff, lifecycle, logs, paging, telemetry
from siltworks.sources import paged, readers, sinks

LOG = """META tool="pytest" ecosystem="python" command="run tests" status=failed summary="Sample failure" timestamp=2025-01-01T00:00:00
TESTS passed=2 failed=1 skipped=0 duration=12.5
TESTCASE name=test_success status=passed duration=0.5
TESTCASE name=test_failure status=failed duration=0.7 message="assert false"
ERROR message="AssertionError: expected true" file=tests/test_sample.py line=42
WARNING message="Deprecated API" file=src/module.py line=10
ARTIFACT path=artifacts/report.xml
INFO language=python version=3.11
"""


def parsed(spark, raw, adapter="python"):
    rows = spark.createDataFrame([(1, adapter, raw)], "doc_id int, adapter string, raw string")
    return logs.parse_logs(rows)


def test_sample_log(spark):
    r = parsed(spark, LOG).withColumn("severity", logs.severity()).first()
    assert (r["tests"]["passed"], r["tests"]["failed"], r["tests"]["skipped"]) == (1, 1, 0)
    assert [e["line"] for e in r["errors"]] == [42] and [w["line"] for w in r["warnings"]] == [10]
    assert r["artifacts"] == ["artifacts/report.xml"] and r["metadata"] == {"language": "python", "version": "3.11"}
    assert r["severity"] == "error" and r["reject_reason"] is None


def test_log_edges(spark):
    r = parsed(spark, "").first()
    assert (r["tool"], r["status"], r["summary"], r["tests"]) == ("pytest", "failed", "No summary provided.", None)
    r = parsed(spark, "TESTCASE name=a status=passed\nTESTS passed=5 failed=0\n# c\nERROR\tmessage=x\nNOPE y").first()
    assert r["tests"]["cases"] == [] and r["tests"]["passed"] == 5 and r["errors"] == []
    r = parsed(spark, "ERROR line=abc").first()
    assert r["reject_reason"] == "unreadable number" and r["errors"][0]["message"] == "line=abc"
    r = parsed(spark, "META timestamp=zzz zone=eu").first()
    assert r["metadata"]["timestamp_parse_error"] == "zzz" and r["metadata"]["zone"] == "eu"
    assert parsed(spark, "TESTS passed=-1 failed=0").first()["reject_reason"] == "negative count"
    text = logs.report(parsed(spark, LOG), "markdown").first()["report"]
    assert text.startswith("# pytest Report\n\n- **Ecosystem:** python") and "- test_success — passed (0.50s)" in text
    with pytest.raises(ValueError):
        logs.report(parsed(spark, LOG), "xml")


def plain_components(pairs):
    """Nodes that reach each other, by a search from each node."""
    after = {}
    for a, b in pairs:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    reach = {}
    for a in after:
        far, todo = set(), [a]
        while todo:
            new = after.get(todo.pop(), set()) - far
            far |= new
            todo += new
        reach[a] = far
    return {(a, min(b for b in far if a in reach.get(b, ()))) for a, far in reach.items() if a in far}


def chained(n):
    return [e for k in range(0, 2 * n, 2) for e in ((k, k + 1), (k + 1, k), (k + 1, k + 2))]


@pytest.mark.parametrize("block_edges", [7, 200, 200_000])
def test_chained_components(spark, monkeypatch, block_edges):
    """300 cycles in a row, in rising and in shuffled order of ids."""
    monkeypatch.setattr(cycles, "BLOCK_EDGES", block_edges)
    pairs = chained(300)
    if block_edges == 7:
        pairs = chained(40)
    got = cycles.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert sorted(map(tuple, got)) == [(k, k - k % 2) for k in range(pairs[-1][1])]
    if block_edges == 200:
        mixed = [((a * 7919) % 100_003, (b * 7919) % 100_003) for a, b in pairs]
        assert {tuple(r) for r in cycles.strong_components(spark.createDataFrame(mixed, "src long, dst long")).collect()} == plain_components(mixed)


@pytest.mark.parametrize("slow", [0.0, 0.8])
def test_components_of_random_graphs(spark, monkeypatch, slow):
    import random

    monkeypatch.setattr(cycles, "SLOW_SHARE", slow)
    monkeypatch.setattr(cycles, "BLOCK_EDGES", 25)
    monkeypatch.setattr(cycles, "MOST_BLOCK_EDGES", 30)
    r = random.Random(7)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(100 + i, 100 + (i + 1) % 12) for i in range(12)] + [(5, None), (None, 5), (7, 7), (200, 200), (200, 201)]
    pairs += pairs[:9]
    got = {tuple(x) for x in cycles.strong_components(spark.createDataFrame(pairs, "src long, dst long").repartition(3)).collect()}
    assert got == plain_components(pairs)


@pytest.mark.parametrize("block_edges", [100, 200_000])
def test_deep_chain(spark, monkeypatch, block_edges):
    monkeypatch.setattr(cycles, "BLOCK_EDGES", block_edges)
    links = [(k + 1, k) for k in range(1500)] + [(k + 1, k - 5) for k in range(6, 1500, 7)] + [(9000, 9001), (9001, 9000), (9002, 9000), (9002, 3), (9003, None), (None, 4)]
    got = {r["node"]: r["depth"] for r in cycles.longest_depth(spark.createDataFrame(links, "child long, parent long").repartition(4)).collect()}
    assert got == {k: k for k in range(1, 1501)} | {9000: None, 9001: None, 9002: None}


def test_depths_of_random_graphs(spark, monkeypatch):
    import random

    monkeypatch.setattr(cycles, "BLOCK_EDGES", 20)
    r = random.Random(9)
    links = [(a, b) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(110)) if a != b and (a > b or r.random() < 0.03)]
    parents = {}
    for c, p in links:
        parents.setdefault(c, set()).add(p)
    depth = {}
    for _ in range(100):
        for c, ps in parents.items():
            if all(p not in parents or p in depth for p in ps):
                depth[c] = 1 + max(depth.get(p, 0) for p in ps)
    got = {x["node"]: x["depth"] for x in cycles.longest_depth(spark.createDataFrame(links, "child long, parent long")).collect()}
    assert got == {c: depth.get(c) for c in parents}


@pytest.mark.parametrize("block_edges", [2, 200_000])
def test_graph_fixtures(spark, monkeypatch, block_edges):
    monkeypatch.setattr(cycles, "BLOCK_EDGES", block_edges)
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("self", "self"), ("d", "e")], "src string, dst string")
    groups = {tuple(r["members"]) for r in cycles.cycle_groups(e).collect()}
    assert groups == {("a", "b"), ("c", "d"), ("self",)}
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "child string, parent string")
    depth = {r["node"]: r["depth"] for r in cycles.longest_depth(up).collect()}
    assert depth == {"a": None, "b": None, "c": None, "d": 1}
    n = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "e")], "src string, dst string")
    near = graph.neighbourhood(n, "a", 1, 10).collect()
    assert {r["node"]: r["distance"] for r in near} == {"a": 0, "b": 1, "c": 1} and not near[0]["truncated"]
    assert graph.neighbourhood(n, "a", 1, 2).first()["truncated"]
    with pytest.raises(ValueError):
        graph.neighbourhood(n, "a", 4, 2)


def test_histogram_modes(spark):
    s = spark.createDataFrame([("x", 0.25)], "op string, v double")
    right = [r["bucket_count"] for r in telemetry.histogram(s, ["op"], "v").orderBy("le").collect()]
    compat = [r["bucket_count"] for r in telemetry.histogram(s, ["op"], "v", compat_double_cumulative=True).orderBy("le").collect()]
    assert right == [0, 0, 0, 1, 1, 1, 1, 1, 1] and compat == [0, 0, 0, 1, 2, 3, 4, 5, 6]


def test_lifecycle_sequence(spark):
    state = spark.createDataFrame([], "finding_id string, first_seen string, last_seen string, evidence_state string, resolved_snapshot string")

    def step(state, ids, snapshot, resolve=True):
        seen = spark.createDataFrame([(i,) for i in ids], "finding_id string")
        rows = lifecycle.reconcile(state, seen, snapshot, resolve)
        out = spark.createDataFrame(rows.collect(), rows.schema)
        return out.drop("event_type"), {r["finding_id"]: r["event_type"] for r in out.collect()}

    state, e = step(state, ["a", "b"], "s1")
    assert e == {"a": "finding-first-seen", "b": "finding-first-seen"}
    state, e = step(state, ["a", "b"], "s1")
    assert e == {"a": None, "b": None}
    state, e = step(state, ["a"], "s2", resolve=False)
    assert e == {"a": "finding-evidence-updated", "b": None}
    state, e = step(state, ["a"], "s3")
    assert e["b"] == "finding-resolved"
    state, e = step(state, ["b"], "s4")
    assert e == {"a": "finding-resolved", "b": "finding-reactivated"}
    assert not lifecycle.may_resolve(True, 0, 1, 1) and not lifecycle.may_resolve(False, 0, 1, 2) and lifecycle.may_resolve(False, 0, 2, 2)


def test_absence_is_not_removal(spark):
    old = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 3)], "k string, v int")
    f = lambda **u: {r["k"]: r["change_type"] for r in diffing.snapshot_diff(old, new, ["k"], ["v"], unchanged=True, **u).collect()}
    assert f() == {"a": "removed", "b": "unchanged", "c": "added"}
    assert f(target_uncertain=True)["a"] == "not-observed-in-target" and f(baseline_uncertain=True)["c"] == "not-observed-in-baseline"


def test_code_facts():
    source = b'''import os
from . import x
class A(Base):
    """Doc."""
    def m(self, a, *b):
        if a and b:
            for i in b:
                pass
        elif a:
            return [i for i in b if i]
def _f(): pass
'''
    rows = code.facts_of("src/pkg/mod.py", source)
    by = {r["qualified_name"]: r for r in rows if r.get("qualified_name")}
    assert by["pkg.mod.A.m"]["complexity"] == 6 and by["pkg.mod.A.m"]["nesting"] == 2 and by["pkg.mod.A.m"]["parameters"] == 3
    assert by["pkg.mod.A"]["bases"] == ["Base"] and by["pkg.mod.A"]["documented"] and by["pkg.mod._f"]["visibility"] == "private"
    assert code.facts_of("a.py", b"def (")[0]["error"] == "parse-error" and code.facts_of("a.py", b"\xff")[0]["error"] == "decode-error"


@pytest.mark.parametrize(
    ("body", "complexity", "nesting"),
    [
        ("assert a", 1, 0),
        ("x = [i for i in a]", 1, 0),
        ("x = [i for i in a if i if not i]", 3, 0),
        ("match a:\n        case 1: pass\n        case _: pass", 2, 1),
        ("match a:\n        case 1 if b: pass\n        case _ if b or c: pass", 4, 1),
        ("x = lambda y: y and a or b", 3, 0),
        ("if a: pass\n    elif b: pass\n    elif c: pass\n    else: pass", 4, 3),
        ("for i in a:\n        while b: pass\n    else:\n        pass", 3, 2),
        ("try: pass\n    except A: pass\n    except B:\n        if a: pass\n    finally: pass", 4, 2),
        ("with a as b, c as d:\n        x = 1 if a else 2", 2, 1),
        ("def inner(z=1 and 2):\n        if z: pass\n    class K:\n        x = a or b", 1, 0),
    ],
)
def test_measures_of_each_construct(body, complexity, nesting):
    rows = code.facts_of("m.py", f"@deco(a or b)\ndef f(self, x=a and b, *r, k=1, **o):\n    {body}\n".encode())
    row = next(r for r in rows if r.get("qualified_name") == "m.f")
    assert (row["complexity"], row["nesting"], row["parameters"]) == (complexity, nesting, 5)


def test_sources_of_any_depth_and_encoding():
    sums = "x = " + " + ".join(["1"] * 1200)
    chain = "def f(x):\n    if x == 0: return 0\n" + "".join(f"    elif x == {i}: return {i}\n" for i in range(1, 1200))
    for source in (sums, chain, "def g():\n    return " + " + ".join(["1"] * 1200)):
        rows = code.facts_of("m.py", source.encode())
        assert rows[0]["kind"] in ("module", "diagnostic")
    assert [r["complexity"] for r in code.facts_of("m.py", chain.encode()) if r["kind"] == "function"] in ([1201], [])
    latin = code.facts_of("m.py", "# -*- coding: latin-1 -*-\ndef caf\xe9(): pass\n".encode("latin-1"))
    assert [r["display_name"] for r in latin if r["kind"] == "function"] == ["caf\xe9"]
    assert code.facts_of("m.py", b"\xef\xbb\xbfx = 1\n")[0]["kind"] == "module"
    assert code.facts_of("m.py", b"# coding: nonsense\n")[0]["error"] == "decode-error"
    assert code.facts_of("m.py", ("(" * 5000).encode())[0]["kind"] == "diagnostic"
    bound = {r["bound"]: r["imported"] for r in code.facts_of("m.py", b"import a.b, c as d\nfrom e import f as g, h\n") if r["kind"] == "import"}
    assert bound == {"a": "a.b", "d": "c", "g": "e.f", "h": "e.h"}


def test_finding_ids_are_canonical_digests(spark):
    import hashlib
    import json

    keys = ["b\x1fa", 'q"\\', "\u00e9", "a"]
    payload = {"repository_id": "r", "rule_id": "x", "rule_version": "1", "subject_type": "module", "subject_keys": sorted(keys)}
    made = lifecycle.finding_id(F.lit("r"), F.lit("x"), F.lit("1"), F.lit("module"), F.array(*[F.lit(k) for k in keys[1:]]))
    payload["subject_keys"] = sorted(keys[1:])
    text = json.dumps(payload, ensure_ascii=False, separators=(",", ":"), sort_keys=True) + "\n"
    want = hashlib.sha256(b"repository-review-finding\0" + text.encode()).hexdigest()
    assert spark.range(1).select(made.alias("i")).first()["i"] == want


def test_key_values_keep_the_last(spark):
    from siltworks.functions.text import key_values

    rows = spark.createDataFrame([('A=1 b="x y" a=2 c="" A=3',), ("none",), (None,)], "t string").select(key_values(F.col("t")).alias("m")).collect()
    assert rows[0]["m"] == {"b": "x y", "c": '""', "a": "3"} and rows[1]["m"] == {} and rows[2]["m"] is None


def test_rules_edges(spark):
    rows = spark.createDataFrame([("a", 1000), ("b", 1001), ("c", 1501), ("d", 2001)], "s string, v int")
    got = {r["subject"]: r["severity"] for r in findings.threshold_findings(rows, "r", "f", "s", "v", F.lit(1000)).collect()}
    assert got == {"b": "low", "c": "medium", "d": "high"}


def test_paging_limits(spark):
    d = spark.range(10)
    with pytest.raises(ValueError):
        paging.page(d, [F.col("id")], 1, 500)
    with pytest.raises(ValueError):
        paging.ordering("x", "asc", {"id": F.col("id")}, "id")
    assert [r["id"] for r in paging.page(d, [F.col("id")], 2, 3).collect()] == [3, 4, 5]


def test_handoff():
    out = handoff.render({"a": 1}, {"s": ["x" * 100] * 3}, ["n"], 2000, 200)
    assert out["truncated"] and handoff.verify(out)
    small = handoff.render({"a": 1}, {"s": ["x" * 100] * 3}, [], 120, 2000)
    assert '"omitted":["s"]' in small["json"]
    with pytest.raises(ValueError):
        handoff.render({"a": "x" * 500}, {}, [], 100, 2000)


def test_selection_of_differences(spark):
    rows = [("files", "b", "d1", None, None), ("files", "a", "d2", None, None), ("cycles", "c", "d3", "c1", None), ("cycles", "e", "d4", None, "c2")]
    deltas = spark.createDataFrame(rows, "section string, logical_key string, delta_id string, baseline_cycle_id string, target_cycle_id string")
    got = handoff.selected(deltas, ["d1", "d2"], ["files", "cycles"], ["c2"], 1).orderBy("section").collect()
    assert [(r.section, r.delta_id, r.n_total, r.n_omitted) for r in got] == [("cycles", "d4", 1, 0), ("files", "d2", 2, 1)]
    for ids, enabled, cycle_ids in ((["d9"], ["files"], []), (["d3"], ["files"], []), ([], ["cycles"], ["c9"]), ([], ["files"], ["c1"]), ([], ["nothing"], []), ([str(i) for i in range(501)], ["files"], [])):
        with pytest.raises(ValueError):
            handoff.selected(deltas, ids, enabled, cycle_ids)
    assert handoff.rendered_digest("m", "j") == __import__("hashlib").sha256(b"2\0m\0j").hexdigest()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text(LOG)
    (tmp_path / "logs/b.log").write_text("  \n")
    (tmp_path / "logs/c.bin").write_text("x")
    assert readers.read_logs(spark, f"{tmp_path}/logs", "python").count() == 1
    assert readers.select_source(["x"], "a.log", "y")[0] == "command"
    with pytest.raises(ValueError):
        readers.select_source(None, "a.exe", None)
    repo = tmp_path / "repo"
    for name, body in {"src/a.py": "import os\n", "node_modules/x.py": "", "b.bin": "\0", "key.pem": "k", "src/big.py": "#" * 50}.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(body)
    seen = readers.inspect_candidates(readers.read_repository(spark, str(repo)), ["*big*"])
    got = {r["relative_path"]: r["exclusion_reason"] for r in seen.collect()}
    assert got["src/a.py"] is None and got["b.bin"] == "binary" and got["src/big.py"] == "configured" and "key.pem" not in got and len(got) == 4
    marks = {r["relative_path"]: r["exclusion_reason"] for r in readers.running_limits(spark.createDataFrame([("a", 5, None), ("b", 9, None), ("c", 5, None)], "relative_path string, size_bytes long, exclusion_reason string"), 5, 10).collect()}
    assert marks == {"a": None, "b": "limit-reached", "c": None}
    for s in ("s1", "s2", "s1"):
        sinks.write_snapshot({"files": spark.range(3)}, f"{tmp_path}/snap", s)
    assert sinks.read_manifests(spark, f"{tmp_path}/snap").count() == 2
    assert sinks.read_section(spark, f"{tmp_path}/snap", "files", "s2").count() == 3
    sinks.write_atomically(f"{tmp_path}/r/x.md", "hi")
    assert (tmp_path / "r/x.md").read_text() == "hi"
    spark.dataSource.register(paged.PagedSource)
    pages = spark.read.format("siltworks_paged").option("pages", '[[["1","a","x"]],[["2","b","y"]]]').load()
    assert sorted(r["id"] for r in pages.collect()) == ["1", "2"]
    sinks.write_csv(spark.range(3), f"{tmp_path}/csv")
    assert readers.read_csv(spark, f"{tmp_path}/csv").count() == 3
    sinks.write_jsonl(spark.range(2), f"{tmp_path}/j")
    assert readers.read_jsonl(spark, f"{tmp_path}/j").count() == 2


def test_streams(spark, tmp_path):
    import datetime as dt

    from siltworks.streaming import streams

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), i % 3, "a" if i % 2 else "b", float(i), "{}") for i in range(60)]
    spark.createDataFrame(rows, streams.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp_{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    events = streams.read_events(spark, f"{tmp_path}/events")
    counts = run(streams.windowed_counts(events), "update", "w_counts").groupBy("event_type").agg(F.sum("n").alias("n")).collect()
    assert {r["event_type"]: r["n"] for r in counts} == {"a": 30, "b": 30}
    assert run(streams.running_counters(events, ["user_id"], "value"), "update", "w_totals").count() == 3
    assert run(streams.deduplicated(events, ["event_id"]), "append", "w_dedup").count() == 60
    states = run(streams.health_states(events.withColumn("failed", F.col("event_id") > 30)), "update", "w_health").collect()
    assert {r["state"] for r in states} == {"degraded"}
    write = streams.latest_generation_sink(f"{tmp_path}/gen", "k", "g")
    write(spark.createDataFrame([("a", 2)], "k string, g int"), 0)
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, g int"), 1)
    latest = lambda: {r["k"]: r["g"] for r in streams.read_latest(spark, f"{tmp_path}/gen", "k", "g").collect()}
    assert latest() == {"a": 2, "b": 1}
    write(spark.createDataFrame([("a", 9), ("z", 9)], "k string, g int"), 1)  # a rerun of a finished batch changes nothing
    assert latest() == {"a": 2, "b": 1}
    spark.createDataFrame([("a", 7)], "k string, g int").write.parquet(f"{tmp_path}/gen/batch=2")  # a job that died before its pointer
    assert latest() == {"a": 2, "b": 1}
    write(spark.createDataFrame([("a", 3)], "k string, g int"), 2)
    assert latest() == {"a": 3, "b": 1}
    assert streams.read_latest(spark, f"{tmp_path}/none", "k", "g") is None
    (tmp_path / "broken/_pointer_table").mkdir(parents=True)
    (tmp_path / "broken/_pointer_table/x.parquet").write_text("no")
    with pytest.raises(Exception, match="(?i)parquet|read"):
        streams.read_latest(spark, f"{tmp_path}/broken", "k", "g").collect()


def test_failures_in_a_row_across_chunks(spark, tmp_path):
    import datetime as dt

    from siltworks.streaming import streams

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), 1, not (i in (3, 20) or i < 2)) for i in range(30)]
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, failed boolean").coalesce(1).write.parquet(f"{tmp_path}/e")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        events = spark.readStream.schema("event_id long, ts timestamp, user_id long, failed boolean").parquet(f"{tmp_path}/e")
        q = streams.health_states(events).writeStream.outputMode("update").format("memory").queryName("w_rows").option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in spark.table("w_rows").collect()] == [(1, "degraded", 9)]


def test_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from siltworks import session

    conf = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.checkpoint_root(far)
    before = session.scratch_paths()
    kept, gone = session.scratch(spark.range(3)), session.scratch(spark.range(4))
    session.drop_scratch_since(before, kept)
    assert kept.count() == 3 and gone._siltworks_path not in session.scratch_paths() and kept._siltworks_path in session.scratch_paths()


REVIEWED = {
    "src/app/__init__.py": '__all__ = ["Shared", "x"]\n',
    "src/app/models.py": "class Shared:\n    class Inner: pass\nclass Base(Shared):\n    def m(self): pass\n",
    "src/app/views.py": "from app import models\nfrom app.models import Base as B, Gone\nimport app.models\nfrom . import models as mm\nimport other.pkg\n"
    "class V1(B): pass\nclass V2(models.Base): pass\nclass V3(app.models.Base): pass\nclass V4(Shared): pass\nclass V5(External): pass\nclass V6(V1): pass\nclass V7(mm.Shared.Inner, B): pass\nclass V8(Generic[T]): pass\n",
    "src/app/a.py": "from app import b\nclass X(Y): pass\nclass Y(X): pass\nclass Z(X): pass\n",
    "src/app/b.py": "import app.a\n",
    "lib/app/b.py": "",
    "tests/test_models.py": "from app import models\ndef test_it(): pass\n",
    "src/app/broken.py": "def (",
}


def test_review_resolves_imports_and_bases(spark):
    from siltworks.operators import review
    from siltworks.session import scratch

    files = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in REVIEWED.items()], "relative_path string, content binary")
    facts = scratch(code.scan_sources(files))
    edges = scratch(review.relationships(facts))
    name = lambda x: x and x.split("::")[-1].split(":")[0]
    inherits = {(name(r["source_id"]).split(".")[-1], r["evidence"]): (name(r["target_id"]), r["resolution_status"], r["confidence"]) for r in edges.where("relationship_type = 'inherits'").collect()}
    sure, none = ("resolved-static", "high"), (None, "unresolved-dynamic", "low")
    assert inherits == {
        ("Base", "Shared"): ("app.models.Shared", *sure), ("V1", "B"): ("app.models.Base", *sure), ("V2", "models.Base"): ("app.models.Base", *sure), ("V3", "app.models.Base"): ("app.models.Base", *sure),
        ("V4", "Shared"): ("app.models.Shared", "probable-static", "medium"), ("V5", "External"): none, ("V6", "V1"): ("app.views.V1", *sure), ("V7", "mm.Shared.Inner"): ("app.models.Shared.Inner", *sure),
        ("V7", "B"): ("app.models.Base", *sure), ("V8", "Generic[T]"): none, ("X", "Y"): ("app.a.Y", *sure), ("Y", "X"): ("app.a.X", *sure), ("Z", "X"): ("app.a.X", *sure),
    }
    imports = {(r["source_id"], r["evidence"]): (r["target_id"], r["resolution_status"]) for r in edges.where("relationship_type = 'imports'").collect()}
    assert imports["src/app/views.py", "app.models"] == ("src/app/models.py", "resolved-static") and imports["src/app/a.py", "app.b"] == (None, "ambiguous")
    assert imports["src/app/views.py", "app.models.Gone"] == ("src/app/models.py", "resolved-static") and imports["src/app/views.py", "other.pkg"] == (None, "unresolved-dynamic")
    nodes = review.graph_nodes(review.modules_of(facts), review.symbols_of(facts)).collect()
    assert {r["node_id"] for r in nodes if r["node_type"] == "package"} == {"package:app", "package:tests"} and sum(r["node_type"] == "symbol" for r in nodes) == 16
    held = {(name(r["source_id"]), name(r["target_id"])) for r in edges.where("relationship_type = 'contains'").collect()}
    assert ("app.models.Shared", "app.models.Shared.Inner") in held and ("src/app/models.py", "app.models.Base") in held and ("package", "src/app/views.py") in held
    rings = scratch(review.cycle_members(edges, "inherits"))
    rows = {r["qualified_name"]: r for r in review.symbol_metrics(facts, edges, rings).collect()}
    assert [rows[f"app.{k}"]["resolved_inheritance_depth"] for k in ("models.Base", "views.V1", "views.V6", "a.X", "a.Z", "models.Shared", "views.V5")] == [1, 2, 3, None, None, None, None]
    assert rows["app.models.Base"]["direct_child_count"] == 4 and rows["app.views.V7"]["direct_parent_count"] == 2 and rows["app.a.X"]["inheritance_cycle_membership"] == 1 and rows["app.a.Z"]["inheritance_cycle_membership"] == 0
    assert rows["app.models.Base"]["nearby_test_evidence"] == 1 and rows["app.views.V1"]["nearby_test_evidence"] == 0 and rows["app.models.Base.m"]["parameter_count"] == 1
    modules = {r["relative_path"]: r for r in review.module_metrics(facts, edges, review.cycle_members(edges, "imports")).collect()}
    assert modules["src/app/models.py"]["resolved_fan_in"] == 6 and modules["src/app/models.py"]["public_symbol_count"] == 2 and modules["src/app/models.py"]["total_symbol_count"] == 4
    found = {(r["rule_id"], r["subject"].split("::")[-1]) for r in review.analyse(files).collect()}
    assert ("undocumented-public-symbol", "app.views.V1") in found and any(r == "inheritance-cycle" for r, _ in found)
