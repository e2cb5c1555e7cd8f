"""Whitening against numpy on exact whole numbers; the solver on awkward matrices."""

import math

import numpy as np
import pytest
from fixtures import CLASHING
from pyspark.sql import functions as F

from ledgerlens.llm import whitening


def brute(vectors: dict, k: int = 8):
    """(id, component) -> (n, deviation, whitened up to the sign), explained; plain formulas of the contract."""
    ids = list(vectors)
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in vectors[i]] for i in ids])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ids, n, deviation, y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def table(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.select("*", *[F.lit("extra").alias(c) for c in (*CLASHING, "x", "n", "component", "whitened", "deviation")])


def check(found, vectors, k=8):
    ids, n, deviation, white, share = brute(vectors, k)
    rows = {(r.vec_id, r.component): r for r in found}
    assert len(rows) == len(found) == len(ids) * white.shape[1]
    got = np.array([[rows[i, c + 1].whitened for c in range(white.shape[1])] for i in ids])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * signs).max() < 1e-8
    assert [rows[i, 1].deviation for i in ids] == deviation and {r.n for r in found} == {n}
    assert np.allclose([rows[ids[0], c + 1].explained for c in range(white.shape[1])], share, rtol=1e-10)
    assert max(r.identity_error for r in found) < 1e-9 and len({r.identity_error for r in found}) == 1


def test_against_numpy_in_any_partitioning(spark):
    rng = np.random.default_rng(3)
    vectors = {i: (rng.normal(size=12) * np.arange(1, 13)).astype(np.float32).tolist() for i in range(300)}
    df = table(spark, list(vectors.items()))
    found = whitening.whiten(df.repartition(7), "vec_id", "embedding").collect()
    check(found, vectors)
    other = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df.coalesce(1), "vec_id", "embedding").collect()}
    assert all(abs(other[r.vec_id, r.component] - r.whitened) < 1e-12 for r in found)


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = {i: rng.normal(size=3).tolist() for i in range(20)}
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]),
           (104, []), (105, [1.0, 2.0]), (106, [1.0, 2.0, 3.0, 4.0])]
    check(whitening.whiten(table(spark, [*good.items(), *bad], "double"), "vec_id", "embedding").collect(), good)
    twice = [*good.items(), *good.items(), (None, [0.5, 0.5, 0.5])]
    found = whitening.whiten(table(spark, twice, "double"), "vec_id", "embedding").collect()
    assert len(found) == 41 * 3 and {r.n for r in found} == {41} and sum(r.vec_id is None for r in found) == 3
    of = {}
    for r in found:
        of.setdefault((r.vec_id, r.component), set()).add(r.whitened)
    assert all(len(v) == 1 for v in of.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_scale(spark, rows):
    found = whitening.whiten(table(spark, rows), "vec_id", "embedding")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_lower_rank_and_huge_entries(spark):
    flat = {i: [float(i), 2.0 * i, 5.0] for i in range(10)}
    found = whitening.whiten(table(spark, list(flat.items()), "double"), "vec_id", "embedding").collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12
    huge = [(i, [1e30 * (i % 2), float(i)]) for i in range(6)]
    found = whitening.whiten(table(spark, huge, "double"), "vec_id", "embedding").collect()
    assert all(math.isfinite(r.whitened) and r.deviation is None for r in found) and found


def spectra():
    rng = np.random.default_rng(5)
    yield np.eye(9)
    yield np.diag([5.0, 5, 5, 1, 1, 0, 0, 0, 3, 3])
    yield np.ones((12, 12))
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    yield (q * np.array([9.0] * 5 + [9 - 1e-11] * 4 + [1.0] * 21)) @ q.T
    yield (q * np.logspace(0, -12, 30)) @ q.T
    a = rng.normal(size=(80, 100))
    yield a @ a.T
    yield np.array([[2.0]])
    yield np.array([[2.0, 1.0], [1.0, 2.0]])


@pytest.mark.parametrize("i", range(8))
def test_solver(i):
    v = list(spectra())[i].astype(whitening.REAL)
    v = (v + v.T) / 2
    k = min(8, len(v))
    diagonal, off, reflections = whitening.tridiagonal(v)
    values = whitening.leading_eigenvalues(diagonal, off, k)
    u = whitening.leading_vectors(diagonal, off, values, reflections)
    scale = float(np.abs(v).max())
    assert np.abs(values - np.linalg.eigvalsh(v.astype(float))[::-1][:k]).max() < 1e-12 * scale * len(v)
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-15 and np.abs(v @ u - u * values).max() < 1e-15 * scale * len(v)


def test_counts_below():
    d, e = np.array([1.0, 2, 3], whitening.REAL), np.zeros(2, whitening.REAL)
    assert whitening.below(d, e, np.array([0.5, 1.5, 2.5, 3.5], whitening.REAL)).tolist() == [0, 1, 2, 3]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check(whitening.op11_whitening(spark, sf).collect(), vectors)
