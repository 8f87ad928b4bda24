"""Scans of generated sources: each file once, only what is wanted, on all cores."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siltworks.operators import code
from siltworks.plans import registry  # noqa: F401  first, as it imports the others
from siltworks.plans import code_queries, finding_queries  # isort: skip

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_sources_are_spread_before_they_are_scanned(spark):
    tasks = spark.sparkContext.defaultParallelism
    made = finding_queries.finding_sources(spark, FOLDER)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > tasks
    assert code_queries.part_sources(spark, FOLDER).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_a_scan_hands_on_what_is_wanted_in_few_batches(spark):
    files = finding_queries.finding_sources(spark, FOLDER).coalesce(1)
    every, some = code.scan_sources(files), code.scan_sources(files, code.REVIEW_FACTS)
    assert set(some.columns) == set(code.REVIEW_FACTS)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select(*some.columns).collect()))

    def counted(batches):
        yield pa.RecordBatch.from_pydict({"n": [sum(1 for _ in batches)]})

    assert every.mapInArrow(counted, "n long").first()["n"] <= 2


def test_import_edges_scan_each_file_once(spark):
    scanned = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([("src/a.py", b"import b\nfrom b import x\n"), ("src/b.py", b"import a\n")], "relative_path string, content binary").mapInArrow(note, "relative_path string, content binary")
    edges = code.import_edges(code.scan_sources(files))
    assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("a", "b"), ("b", "a")]
    assert scanned.value == 2
