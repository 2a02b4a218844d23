"""The vector index against a scan of all vectors."""

import numpy as np
import pytest

from corpusloom.operators import retrieval as rt
from corpusloom.operators import vector_index as vi

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n, width, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    x = centres[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, width))
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


def brute(rows, queries, k):
    """{query_id: [(vec_id, distance)]} with the rule that a vector of no length lies at distance 0."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    length = np.linalg.norm(x, axis=1)
    out = {}
    for q, v in queries:
        v = np.array(v, float)
        with np.errstate(all="ignore"):
            d = 1 - x @ v / (length * np.linalg.norm(v))
        d = np.round(np.where(np.isfinite(d), d, 0.0), 6) + 0.0
        out[q] = sorted((dist, i) for i, dist in zip(ids.tolist(), d.tolist(), strict=True) if i != q)[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    return out


def same(got, want):
    assert set(got) == set(want)
    for q, pairs in want.items():
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in pairs], abs=2e-6), q
        inner = {i for d, i in pairs if d < pairs[-1][0] - 3e-6}
        assert inner <= {i for _, i in got[q]}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = clustered(6_000, 32, 40, 1)
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    vi.build(df, path)
    return rows, df, path


def test_exact_mode_is_a_scan(spark, index):
    rows, df, path = index
    queries = [r for r in rows if r[0] % 50 == 0]
    same(answers(vi.search(spark, path, df.filter("vec_id % 50 = 0"), 10, exact=True)), brute(rows, queries, 10))


def test_all_lists_probed_is_a_scan(spark, index):
    rows, df, path = index
    same(answers(vi.search(spark, path, df.filter("vec_id % 200 = 0"), 10, probes=1 << 20)), brute(rows, [r for r in rows if r[0] % 200 == 0], 10))


def test_recall_of_the_probes_that_the_build_found(spark, index, tmp_path):
    """Clustered vectors, and vectors without any structure, which need nearly all lists."""
    rng = np.random.default_rng(8)
    plain = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2_000, 16)).astype(np.float32))]
    loose = spark.createDataFrame(plain, SCHEMA)
    vi.build(loose, str(tmp_path))
    told = {}
    for name, df, path in (("clustered", index[1], index[2]), ("loose", loose, str(tmp_path))):
        queries = df.filter("vec_id % 20 = 0")
        share = vi.recall(vi.search(spark, path, queries, 10), vi.search(spark, path, queries, 10, exact=True)).agg({"recall": "avg"}).first()[0]
        told[name] = spark.read.parquet(f"{path}/told").first()["probes"], round(share, 3)
        assert share >= 0.9
    print("probes and recall:", told)
    assert told["clustered"][0] < 20


def test_every_row_is_in_one_list(spark, index, monkeypatch):
    rows, _, path = index
    found = [i for r in spark.read.parquet(f"{path}/lists").collect() for i in np.frombuffer(r["row"], np.int64).tolist()]
    assert len(found) == len(set(found)) == len(rows)


def test_odd_vectors_and_long_lists(spark, tmp_path, monkeypatch):
    """Nulls, no length, repeated rows and ids, mixed lengths, a list of a third of all rows in several parts and query blocks."""
    monkeypatch.setattr(vi, "PART_ROWS", 64)
    monkeypatch.setattr(vi, "QUERY_BLOCK", 16)
    rows = clustered(400, 8, 5, 2) + [(1000 + i, [1.0] * 8) for i in range(200)] + [(2000, [0.0] * 8), (2001, [0.0] * 8)]
    odd = [(3000, None), (3001, [float("nan")] + [1.0] * 7), (3002, [None] + [1.0] * 7)]
    vi.build(spark.createDataFrame(rows + odd, SCHEMA), str(tmp_path), lists=6)
    queries = [r for r in rows if r[0] % 10 == 0]
    got = answers(vi.search(spark, str(tmp_path), spark.createDataFrame(queries + odd, SCHEMA), 7, probes=1, exact=True))
    same(got, brute(rows, queries, 7))


def test_nothing_to_index_or_to_ask(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    vi.build(empty, str(tmp_path / "a"))
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], SCHEMA)
    assert vi.search(spark, str(tmp_path / "a"), one, 3, exact=True).count() == 0
    vi.build(one, str(tmp_path / "b"))
    assert vi.search(spark, str(tmp_path / "b"), empty, 3, exact=True).count() == 0
    assert answers(vi.search(spark, str(tmp_path / "b"), one, 3)) == {1: [(0.2, 2)], 2: [(0.2, 1)]}


def test_blocks_leave_out_null_vectors(spark):
    rows = clustered(300, 8, 3, 4) + [(900, [0.0] * 8)]
    df = spark.createDataFrame([*rows, (1000, None), (1001, [float("inf")] * 8)], SCHEMA)
    queries = [r for r in rows if r[0] % 50 == 0]
    same(answers(rt.nearest_of_each(df, df.filter("vec_id % 50 = 0"), 5)), brute(rows, queries, 5))


def test_many_blocks_go_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 100)
    monkeypatch.setattr(rt, "MOST_PAIRS", 4)
    rows = clustered(900, 8, 6, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    same(answers(rt.nearest_of_each(df, df.filter("vec_id % 50 = 0"), 5)), brute(rows, [r for r in rows if r[0] % 50 == 0], 5))
