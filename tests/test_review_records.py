"""Full findings, cycle identities and dictionary phrases against plain Python."""

import random
import re

from pyspark.sql import functions as F
from siltworks.functions.text import is_test_path
from siltworks.operators import cycles, findings, keywords, review


def test_excluded_and_test_paths_in_any_case(spark):
    rows = spark.createDataFrame(
        [("src/Vendor/b.py", "public"), ("GENERATED/b.py", "public"), ("src/vendors/b.py", "public"), ("src/_h/a.py", "public"), ("src/a.py", "private"), ("src/a.py", "dunder")], "p string, v string"
    )
    assert [r[0] for r in rows.select(findings.not_excluded(F.col("v"), F.col("p"))).collect()] == [False, False, True, True, False, True]
    paths = [("Tests/x.py", True), ("a/TEST/x.py", True), ("a/Test_x.py", True), ("a/x_TEST.py", True), ("tests.py", False), ("latests/x.py", False), ("a/test_x.txt", False)]
    got = spark.createDataFrame(paths, "p string, w boolean").select(is_test_path(F.col("p")), "w").collect()
    assert all(a == b for a, b in got)


def test_numbers_in_explanations(spark):
    values = [0, 7, 999_999, 1_000_000, 1_234_567, 12_345_678, 100_000_000]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select(findings.general(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{v:g}" for v in values]


def test_findings_of_odd_sources(spark):
    files = {
        "src/app/a.py": "import app.b\nclass X(Y): pass\nclass Y(X): pass\ndef dup():\n    return 1\ndef __dup(): pass\n",
        "src/app/b.py": "import app.a\ndef dup():\n    '''d'''\ndef _hidden(): pass\nclass _P:\n    def run(self): pass\n",
        "src/Vendor/v.py": "def dup(): pass\n",
        "src/app/__init__.py": "",
        "src/app/bad.py": "def (",
    }
    frame = spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "relative_path string, content binary")
    found = {(r.rule_id, r.subject): r for r in review.analyse(frame, repository_id="repo").collect()}
    cycle = found["dependency-cycle", "app.a,app.b"]
    assert cycle.subject_keys == ["app.a", "app.b"] and cycle.affected_node_ids == ["src/app/a.py", "src/app/b.py"] and cycle.metric_evidence[0].value == 2 and cycle.relative_path is None
    assert ("inheritance-cycle", "app.a.X,app.a.Y") in found
    twice = found["exact-duplicate-symbol-name", "app.a.dup,app.b.dup"]
    assert twice.value == 2 and twice.line == 4 and twice.relative_path == "src/app/a.py" and len(twice.affected_node_ids) == 2
    assert not any("Vendor" in s or "__dup" in s or "_hidden" in s for _, s in found)
    assert len({r.finding_id for r in found.values()}) == len(found) and all(r.explanation and r.suggested_action and r.title for r in found.values())
    again = {r.finding_id for r in review.analyse(frame, repository_id="repo").collect()}
    assert again == {r.finding_id for r in found.values()}
    assert again.isdisjoint(r.finding_id for r in review.analyse(frame, repository_id="other").collect())


def test_places_of_one_subject_are_one_finding(spark):
    rows = spark.createDataFrame(
        [("oversized-module", "oversized", "low", "high", "app", "b.py", 1, 1500.0, 1000.0, "n2", None), ("oversized-module", "oversized", "high", "high", "app", "a.py", 1, 2500.0, 1000.0, "n1", None)], findings.COLUMNS
    )
    (one,) = findings.record(rows, "r").collect()
    assert one.relative_path is None and one.line is None and one.severity == "high" and one.affected_node_ids == ["n1", "n2"]
    assert [e.value for e in one.metric_evidence] == [1500.0, 2500.0] and [e.value for e in one.threshold_evidence] == [1000.0]
    assert one.explanation == "File line count is 2500; the experimental threshold is greater than 1000."


def test_cycle_identities_know_members_and_edges_only(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (7, 7), (8, 9), (9, 8), (9, 8)]

    def of(pairs):
        return {r.component: r for r in cycles.cycle_identities(spark.createDataFrame(pairs, "src long, dst long"), "t").collect()}

    first, second = of(edges), of(random.Random(1).sample(edges, len(edges)))
    assert {k: tuple(v) for k, v in first.items()} == {k: tuple(v) for k, v in second.items()}
    assert {k: (v.n_members, v.n_edges) for k, v in first.items()} == {1: (3, 3), 7: (1, 1), 8: (2, 3)}
    more = of([*edges, (1, 3)])
    assert more[1].cycle_key == first[1].cycle_key and more[1].cycle_id != first[1].cycle_id
    old, new = (cycles.cycle_identities(spark.createDataFrame(p, "src long, dst long"), "t") for p in (edges, [*edges[:3], (1, 3), (5, 5)]))
    changes = sorted((r.change_type, r.baseline_cycle_id is None, r.target_cycle_id is None) for r in cycles.cycle_changes(old, new, before_uncertain=True).collect())
    assert changes == [("not-observed-in-baseline", True, False), ("removed", False, True), ("removed", False, True)]


def test_phrases_like_regular_expressions(spark):
    r = random.Random(3)
    words = ["new", "York", "straße", "a_b", "x1", "the", "Über", "é"]
    texts = [(i, "".join(r.choice(words) + r.choice([" ", " ", ", ", "-", "\n", "  "]) for _ in range(r.randrange(12)))) for i in range(150)] + [(200, None), (201, ""), (202, "...")]
    phrases = ["new york", "New  York", "the", "THE", "x1", "a_b", "straße the", "über, é", "new york the", "the new", "york-x1", "!!", "ab", None, "(the new)"]
    ranked = [(p, i) for i, p in enumerate(phrases)]
    frame = spark.createDataFrame(texts, "id int, t string").repartition(3)
    dictionary = spark.createDataFrame(ranked, "phrase string, rank int")
    kept = {}
    for p, rank in ranked:
        bare = re.sub(r"^\W+|\W+$", "", (p or "").lower())
        if bare and bare not in kept:
            kept[bare] = (p, rank)
    want = {(i, p, rank) for i, t in texts for bare, (p, rank) in kept.items() if t and re.search(rf"\b{re.escape(bare)}\b", t, re.I)}
    assert {tuple(x) for x in keywords.found_phrases(frame, "id", "t", dictionary, None).collect()} == want
    top = {}
    for i, p, rank in sorted(want, key=lambda x: x[2]):
        top.setdefault(i, []).append((i, p, rank))
    assert {tuple(x) for x in keywords.found_phrases(frame, "id", "t", dictionary, 3).collect()} == {x for rows in top.values() for x in rows[:3]}
    assert keywords.found_phrases(frame, "id", "t", dictionary.where("phrase = '!!'")).collect() == []
    assert len(want) > 100
