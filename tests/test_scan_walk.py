"""A scan goes through blocks of statements only, and edges are made from facts without measures."""

import ast
import gc

from siltworks.operators import code, review

SOURCE = b"""import b
try:
    class A(b.B): pass
except* ValueError:
    def caught(): return [x if x else y for x in z if x]
else:
    from b import B
match v:
    case 1 if v:
        async def cased(): import c
with w:
    while 1:
        class C(A):
            def inner(self): pass
"""


def test_facts_are_found_without_a_walk_through_expressions(monkeypatch):
    def walked(node):
        raise AssertionError(node)

    with monkeypatch.context() as m:
        m.setattr(ast, "iter_child_nodes", walked)
        facts = code.facts_of("a.py", SOURCE, code.EDGE_FACTS)
    found = [(f["kind"], f["qualified_name"]) if f["kind"] != "import" else ("import", f["imported"]) for f in facts]
    assert found == [
        ("module", "a"), ("import", "b"), ("class", "a.C"), ("method", "a.C.inner"), ("function", "a.cased"), ("import", "c"), ("class", "a.A"), ("import", "b.B"), ("function", "a.caught"),
    ]


def test_edges_need_no_measures(spark):
    files = spark.createDataFrame([("src/a.py", SOURCE), ("src/b.py", b"class B: pass\n")], "relative_path string, content binary")
    every, some = (review.relationships(code.scan_sources(files, c)).collect() for c in (code.REVIEW_FACTS, code.EDGE_FACTS))
    assert sorted(map(str, some)) == sorted(map(str, every)) and len(some) > 8
    assert not {"complexity", "nesting"} & set(code.EDGE_FACTS) and gc.isenabled()
