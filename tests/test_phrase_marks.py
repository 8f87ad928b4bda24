"""Runs that are no phrase are stopped before they are shuffled; what is found stays the same, however few the bits are."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from siltworks.operators import keywords


def _rows(spark):
    texts = spark.range(40).select(F.col("id"), F.concat(F.lit("İx Σας "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (i * F.col("id")).cast("string"))), " "), F.lit("  the End")).alias("t"))
    phrases = [("W6 w9 w12", 1), ("w7", 2), ("the end", 3), ("the  End", 3), ("σας w0", 4), ("w0 w0 w0 w0", 5), ("  w12 ", 2), ("i̇x", 6)]
    return texts, spark.createDataFrame(phrases, "phrase string, rank long")


@pytest.mark.parametrize("bits", [1 << 28, 64 * keywords.WORDS_PER_BUCKET])
def test_few_bits_lose_no_phrase(spark, monkeypatch, bits):
    monkeypatch.setattr(keywords, "MOST_BITS", bits)
    texts, phrases = _rows(spark)
    held = {tuple(r) for r in keywords.found_phrases(texts, "id", "t", phrases, None).collect()}
    low = {r.id: f" {r.l} " for r in texts.select("id", F.lower("t").alias("l")).collect()}
    want = {(i, p, k) for i, t in low.items() for p, k in phrases.collect() if f" {p.strip().lower()} " in t}
    assert held == want and len(want) > 60
    best = {tuple(r) for r in keywords.found_phrases(texts, "id", "t", phrases, 2).collect()}
    assert best == {x for i in low for x in sorted((r for r in want if r[0] == i), key=lambda r: (r[2], r[1]))[:2]}


def test_runs_meet_bits_before_the_join(spark):
    texts, phrases = _rows(spark)
    out = io.StringIO()
    with redirect_stdout(out):
        keywords.found_phrases(texts, "id", "t", phrases, None).explain("formatted")
    assert "pf_marks" in out.getvalue()
