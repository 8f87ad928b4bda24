"""The sample of positives is the first of all positives in their order."""

import hashlib

import pytest
from pyspark.sql import functions as F
from siltworks.llm import pulearn


@pytest.mark.parametrize("n", [0, 1, 7, 300, 1000, 5000])
@pytest.mark.parametrize("digits", [1, 4])
def test_first_rows(spark, monkeypatch, n, digits):
    monkeypatch.setattr(pulearn, "LEAD_DIGITS", digits)
    rows = spark.range(0, 1000, 1, 7).select(F.md5((F.col("id") % 900).cast("string")).alias("h"), (F.col("id") * 7 % 1000).alias("tie"))
    want = sorted((hashlib.md5(str(i % 900).encode()).hexdigest(), i * 7 % 1000) for i in range(1000))[:n]
    assert sorted(tuple(r) for r in pulearn.first_rows(rows, "h", ["tie"], n).collect()) == want


def test_no_rows(spark):
    assert pulearn.first_rows(spark.createDataFrame([], "h string"), "h", [], 5).collect() == []
