"""Whitening against plain NumPy."""

import os
from fractions import Fraction

import numpy as np
import pytest
from siltworks.llm import whitening
from siltworks.llm.whitening import Moments

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(vectors, count=4):
    """{row: (n, deviation, |whitened|, explained)} by the textbook, over (row, list) pairs."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in kept], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    off = fit - sums / n
    values, comps = np.linalg.eigh(off.T @ off / n)
    values, comps = values[::-1], comps[:, ::-1][:, :count]
    whitened = np.abs((x - sums / n) @ comps / np.sqrt(values[:count]))
    deviation = [sum(d * d for d in row) for row in (x.astype(object) * n - sums).tolist()]
    return n, {i: (deviation[k], whitened[k]) for k, (i, _) in enumerate(kept)}, values[:count] / values.sum()


def run(spark, rows, schema="vec_id long, embedding array<float>, label int", parts=3, **how):
    frame = spark.createDataFrame(rows, schema).repartition(parts)
    return whitening.whiten(frame, **how).collect()


def test_table_like_numpy(spark):
    docs = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    n, want, explained = plain([(r.vec_id, r.embedding) for r in docs.collect()])
    got = whitening.whiten(docs.repartition(5)).collect()
    assert len(got) == 4 * len(want) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    for r in got:
        deviation, whitened = want[r.vec_id]
        assert r.deviation == deviation
        assert abs(abs(r.whitened) - whitened[r.component - 1]) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10


def test_one_vector_may_be_most_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).tolist() if i % 2 else [0.5] * 6, 0) for i in range(600)]
    schema = "vec_id long, embedding array<double>, label int"
    n, want, _ = plain([(i, v) for i, v, _ in rows])
    got = run(spark, rows, schema)
    assert n == 301 and {x.n for x in got} == {301}
    signs = {}
    for x in got:
        assert abs(abs(x.whitened) - want[x.vec_id][1][x.component - 1]) < 1e-9
        signs.setdefault(x.component, set()).add(np.sign(x.whitened) if x.vec_id == 0 else 0)
    assert got[0].identity_error < 1e-12


@pytest.mark.parametrize("sizes", [(1, 1), (5, 1, 70), (3, 0, 9, 2)])
def test_merging_is_the_whole(sizes):
    r = np.random.default_rng(2)
    parts = [(r.normal(size=(s, 5)) * 100 + 1e7).astype(np.int64) for s in sizes]
    state = Moments(0, [], np.zeros(0), np.zeros((0, 0)))
    for part in parts:
        state = state.merge(Moments.of(part) if len(part) else Moments(0, [], np.zeros(0), np.zeros((0, 0))))
    x = np.concatenate(parts)
    exact = [Fraction(int(s), len(x)) for s in x.sum(axis=0)]
    off = np.array([[float(Fraction(int(c)) - m) for c, m in zip(row, exact, strict=True)] for row in x])
    assert state.n == len(x) and state.sums == x.sum(axis=0).tolist()
    np.testing.assert_allclose(state.scatter, off.T @ off, rtol=1e-9, atol=1e-5)


def test_rows_that_go_and_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [-inf, 1.0], 0), (None, [1.0, 2.0], 1), (7, [2.0, -1.0], None), (7, [2.0, -1.0], None), (8, [-0.001, 0.5], 1)]
    got = run(spark, rows)
    assert sorted((x.vec_id or 0, x.component) for x in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]
    assert {x.n for x in got} == {3} and got[0].identity_error < 1e-12
    assert plain([(i, v) for i, v, _ in rows if i in (None, 7, 8)])[0] == 3


def test_no_variance_and_few_vectors(spark):
    same = run(spark, [(i, [1.0, 2.0, 3.0, 4.0, 5.0], 0) for i in range(9)])
    assert len(same) == 36 and all(x.whitened is None and x.explained == 0 and x.identity_error == 0 and x.deviation == 0 and x.n == 1 for x in same)
    line = run(spark, [(i, [float(i), 1.0, float(-i)], 0) for i in range(4)])
    assert {x.component for x in line if x.whitened is not None} == {1} and len(line) == 12


def test_lengths_extremes_and_nothing(spark):
    schema = "vec_id long, embedding array<double>, n long, component int"
    got = run(spark, [(1, [1.0], 5, 5), (2, [1.0, 0.0], 5, 5), (3, [0.0, 2.0], 5, 5), (4, [], 5, 5)], schema)
    assert {x.n for x in got} == {3} and len(got) == 8
    huge = run(spark, [(1, [1e308, 1.0], 0, 0), (2, [-1e308, 1.0], 0, 0), (3, [0.0, 2.0], 0, 0)], schema)
    assert len(huge) == 6 and any(x.deviation is None for x in huge)
    assert run(spark, [], schema) == [] and run(spark, [(1, [], 0, 0)], schema) == [] and run(spark, [(1, None, 0, 0)], schema) == []


def test_exact_sums_of_large_entries():
    big = np.array([[1 << 62, 3], [1 << 62, 4], [1 << 62, 5]], np.int64)
    assert whitening.exact_sums(big) == [3 << 62, 12]
    assert whitening.deviations(np.array([[1 << 40, 1]], object)) == [None]
    assert whitening.deviations(np.array([[3, 4]], np.int64)) == [25]
