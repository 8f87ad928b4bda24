"""Metrics of classes: from the files that can have to do with a base, as from all of them."""

import os

import pytest
from pyspark.sql import functions as F
from siltworks.operators import code, cycles, review
from siltworks.plans import registry  # noqa: F401  first, as it imports the others
from siltworks.plans import finding_queries  # isort: skip
from siltworks.session import scratch

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
FILES = {
    "src/app/models.py": "class Base: pass\ndef made():\n    class Inner(Base): pass\nclass Twice(Base, Base): pass\nclass Deep(Twice): pass\n",
    "src/app/views.py": "from app.models import made, Base as B\nimport app.tools, app.models\nfrom app import models, Deep\nfrom app.tools import helper\nimport app.gone as gone\n"
    "class V1(made.Inner): pass\nclass V2(B): pass\nclass V3(app.models.Deep): pass\nclass V4(models.Twice): pass\nclass V5(helper.X): pass\nclass V6(app.tools.Y): pass\nclass V7(gone.Z): pass\nclass V8(Deep): pass\nclass V9(V8): pass\n",
    "src/app/tools.py": "def helper(): pass\nimport app.models\n",
    "src/app/offers/__init__.py": "__all__ = ['Offered']\n",
    "src/app/offers/one.py": "class Offered: pass\n",
    "src/app/offers/two.py": "class User(Offered): pass\n",
    "src/app/wide/__init__.py": "__ａll__ = ['Wide']\n",
    "src/app/wide/one.py": "class Wide: pass\nclass A(Wide): pass\n",
    "src/app/wide/two.py": "class User(Wide): pass\n",
    "src/ring.py": "class X(Y): pass\nclass Y(X): pass\nclass Z(X): pass\nclass Self(Self): pass\n",
    "src/bad.py": "import app.models\ndef (",
    "src/none.py": "def alone(): pass\n",
    "lib/app/models.py": "def only_functions(): pass\n",
}
COLUMNS = ["symbol_id", "direct_parent_count", "direct_child_count", "resolved_inheritance_depth", "inheritance_cycle_membership"]


def test_metrics_of_classes_are_those_of_all_symbols(spark):
    files = spark.createDataFrame([(k, v.encode()) for k, v in FILES.items()] + [("src/coded.py", "class Coded: pass\nclass More(Coded): pass\n".encode("utf-7"))], "relative_path string, content binary")
    facts = scratch(code.scan_sources(files))
    edges = scratch(review.relationships(facts))
    want = review.symbol_metrics(facts, edges, review.cycle_members(edges, "inherits")).where("kind = 'class'").select(COLUMNS).collect()
    some = scratch(code.scan_sources(files, code.BASE_FACTS, code.tells_of_bases))
    inherits = scratch(review.inheritance_of(some))
    assert sorted(map(str, inherits.collect())) == sorted(map(str, edges.where("relationship_type = 'inherits'").collect()))
    got = review.class_metrics(some, inherits).select(COLUMNS).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 24
    found = {r.symbol_id.split("::")[1].split(":")[0]: tuple(r)[1:] for r in got}
    assert found["ring.X"] == (1, 2, None, 1) and found["ring.Z"] == (1, 0, None, 0) and found["ring.Self"] == (1, 1, None, 1) and found["app.models.Twice"][0] == 2
    assert found["app.views.V1"][0] == 1 and found["app.offers.two.User"][0] == 1 and found["app.wide.two.User"][0] == 1 and found["app.views.V5"] == (0, 0, None, 0)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_class_metrics_parse_what_can_tell_of_classes(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(cycles, "cycle_groups", lambda edges, real=cycles.cycle_groups: searched.append(edges.count()) or real(edges))
    seen = {}
    monkeypatch.setattr(code, "scan_sources", lambda *x, real=code.scan_sources: seen.setdefault("facts", real(*x)))
    rows = finding_queries.review_class_metrics(spark, FOLDER).count()
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").where("p_partkey % 10 = 4").count()
    assert rows == parts * finding_queries.CHAIN and searched == [0]
    assert seen["facts"].where("kind = 'module'").count() == parts and not {"complexity", "documented"} & set(seen["facts"].columns)
    assert seen["facts"].where(F.col("kind") != "module").count() == rows
