"""Exact top-k against all inner products, over several bands and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import topk


@pytest.mark.parametrize("kind", ["unit", "lengths", "equal"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BAND", 90)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "STEP", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.exponential(size=(400, 1))
    if kind == "equal":
        x[50:300] = x[50]
    v = np.floor(256 * x).astype(np.int64)
    ids = rng.permutation(4000)[:400]
    rows = spark.createDataFrame([(int(i), [int(c) for c in r]) for i, r in zip(ids, v, strict=True)], "vec_id long, vector array<long>")
    got = {}
    for r in topk.top_k(rows, rows.filter(F.col("vec_id") % 13 == 0), 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = {}
    for q, vec in zip(ids, v, strict=True):
        if q % 13 == 0:
            best = sorted(((-int(vec @ other), int(i)) for i, other in zip(ids, v, strict=True) if i != q))[:5]
            want[int(q)] = {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_fewer_candidates_than_k(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [3])], "vec_id long, vector array<long>")
    got = sorted(map(tuple, topk.top_k(rows, rows.filter("vec_id = 0"), 5).collect()))
    assert got == [(0, 1, 1, 3)]


def test_repeated_ids_with_different_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BAND", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(c) for c in rng.normal(size=4)]) for i in [*range(0, 60), *range(0, 60, 4)]]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [(i, np.floor(256 * np.array(e)).astype(np.int64)) for i, e in rows]
    want = set()
    for q in range(0, 60, 10):
        best = sorted((-int(a @ b), j) for i, a in x if i == q for j, b in x if j != q)[:5]
        want |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert set(map(tuple, topk.top_k(v, v.filter(F.col("vec_id") % 10 == 0), 5).collect())) == want


def test_bands_too_short_for_a_block_are_not_sent(spark, monkeypatch):
    """Lengths that fall fast: of later bands, no pair is left."""
    monkeypatch.setattr(topk, "BAND", 40)
    sent = []
    monkeypatch.setattr(topk, "broadcast_if_small", lambda df, rows: sent.append(df.count()) or df)
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(400, 6)))
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * 20_000 * 0.98 ** np.arange(400)[:, None]).astype(int)
    rows = spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(x)], "vec_id long, vector array<long>")
    got = set(map(tuple, topk.top_k(rows, rows.filter("vec_id % 20 = 0"), 5).collect()))
    want = set()
    for q in range(0, 400, 20):
        best = sorted((-int(x[q] @ x[j]), j) for j in range(400) if j != q)[:5]
        want |= {(q, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert got == want
    assert len(sent) == 3 and sum(sent) < 6
