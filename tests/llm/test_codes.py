"""Vector codes against plain search and Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import codes

from .conftest import TABLES  # noqa: F401


def plain(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error)} and the digest, from (vec_id, vector) with ids of their own."""
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort()
    width = -(-max(len(v) for _, v in rows) // parts) * parts
    step = width // parts
    vectors = [v + [0] * (width - len(v)) for _, v in rows]
    cut = [[v[p * step : (p + 1) * step] for v in vectors] for p in range(parts)]
    books = [[list(x) for x in part[:entries]] for part in cut]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            owners = [best(p, x)[1] for x in cut[p]]
            book = []
            for e, entry in enumerate(books[p]):
                own = [x for x, o in zip(cut[p], owners, strict=True) if o == e]
                book.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else entry)
            new.append(book)
        books = new
    out = {}
    for n, (i, _) in enumerate(rows):
        found = [best(p, cut[p][n]) for p in range(parts)]
        out[i] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def rows_of(n, width, seed, grid):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(i, [rng.randint(-grid, grid) / grid for _ in range(width)]) for i in ids]


@pytest.mark.parametrize(("n", "width", "grid"), [(200, 64, 2), (150, 32, 50), (30, 16, 3), (90, 20, 4), (1, 64, 2)])
def test_codes_are_those_of_plain_search(spark, make, n, width, grid):
    """Coarse grids make ties and equal entries; fewer rows than entries; a width that parts don't divide."""
    rows = rows_of(n, width, n, grid)
    folder = make(embeddings=[{"vec_id": i, "embedding": v, "label": i % 3 if i % 4 else None} for i, v in rows])
    got = codes.op13_vector_codes(spark, folder).collect()
    want, digest = plain(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {digest}
    for label in (0, 1, 2, None):
        own = {i for i, _ in rows if (i % 3 if i % 4 else None) == label}
        assert {r["label_error"] for r in got if r["vec_id"] in own} == ({sum(want[i][1] for i in own)} if own else set())


def test_parts_entries_and_rounds(spark):
    rows = rows_of(120, 24, 5, 6)
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, extra long").repartition(7)
    found, books = codes.compressed(df, parts=4, entries=9, rounds=3)
    want, digest = plain(rows, 4, 9, 3)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in found.collect()} == want and found.columns == ["vec_id", "extra", "code", "error"]
    assert hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() == digest


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(1, 6), st.integers(0, 2**32))
def test_trees_find_the_lowest_of_the_nearest(entries, width, grid, seed):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-grid, grid + 1, (entries, width)), rng.integers(-grid - 2, grid + 3, (80, width))
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    at, best = codes.nearest(codes.Tree(book), x)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_huge_components_are_held_to_the_largest(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    found, books = codes.compressed(df, parts=2, entries=2, rounds=1)
    assert {r["vec_id"]: r["error"] for r in found.collect()} == {1: 0, 2: 0}
    assert books[:, :, 0].tolist() == [[codes.LARGEST, 128], [-codes.LARGEST, 64]]
