"""The Jaccard join against all pairs, and what its signatures promise."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import overlap

from .conftest import docs_of

WORDS = [f"w{i}" for i in range(400)]


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < 3:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(texts, num=9, den=10):
    sets = [grams(t) for t in texts]
    head = list(range(len(texts)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                head[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def family(rng, size, copies, most):
    base = [rng.choice(WORDS) for _ in range(size)]
    return [" ".join(edited(base, rng.randint(0, most), rng)) for _ in range(copies)]


def found(spark, make, texts, num=9, den=10):
    docs = spark.read.parquet(f"{make(documents=docs_of(texts))}/documents.parquet")
    rows = overlap.jaccard_components(docs, ["doc_id"], num, den).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: (r["n"], r["component_id"]) for r in rows}


def mixture(seed):
    rng = random.Random(seed)
    texts = [t for size, copies, most in ((12, 8, 1), (40, 12, 3), (120, 25, 6), (400, 10, 20), (9, 6, 1)) for t in family(rng, size, copies, most)]
    # a chain: each version a little further from the first
    chain = [rng.choice(WORDS) for _ in range(90)]
    for _ in range(15):
        texts.append(" ".join(chain))
        chain = edited(chain, 2, rng)
    texts += ["", None, " \t", "One two", "one TWO", "one", "one two three"] + texts[:5]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_components_are_those_of_all_pairs(spark, make, seed):
    texts = mixture(seed)
    assert found(spark, make, texts) == brute(texts)


def test_another_similarity(spark, make):
    texts = mixture(7)
    assert found(spark, make, texts, 4, 5) == brute(texts, 4, 5)


def test_buckets_that_are_parted_again(spark, make, monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS_AN_ELEMENT", 0)
    calls = []
    resigned = overlap._resigned
    monkeypatch.setattr(overlap, "_resigned", lambda *a: calls.append(1) or resigned(*a))
    # unlinked texts whose first half is common share buckets: many pairs, few words
    rng = random.Random(1)
    texts = mixture(2) + [t for _ in range(3) for t in family(rng, 11, 120, 3)]
    assert found(spark, make, texts) == brute(texts)
    assert calls


def test_hot_sets_by_broadcast(spark, make, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_COPIES", 3)
    texts = mixture(5) + ["the same five words here"] * 40
    assert found(spark, make, texts) == brute(texts)


def test_large_group_of_near_copies_costs_a_few_comparisons_a_member(spark, make, monkeypatch):
    sizes = []
    compared = overlap._compared
    monkeypatch.setattr(overlap, "_compared", lambda pairs, *a: sizes.append(pairs.count()) or compared(pairs, *a))
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = [" ".join(base)] + [" ".join(edited(base, 1, rng)) for _ in range(600)]
    got = found(spark, make, texts)
    assert {c for _, c in got.values()} == {0}
    assert sum(sizes) <= 5 * len(texts)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 600), st.integers(0, 40), st.integers(0, 40), st.integers(0, 2**32), st.sampled_from([(9, 10), (4, 5), (1, 2)]), st.integers(0, 3))
def test_similar_sets_share_a_signature_and_pass_the_sketch(size, gone, more, seed, similarity, salt):
    num, den = similarity
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = np.unique(np.concatenate([a[min(gone, len(a)) :], rng.integers(0, 2**64, more, dtype=np.uint64)]))
    common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    differ = union - common
    one, two = overlap.sketch(a), overlap.sketch(b)
    words = min(len(one), len(two))
    folded = [np.bitwise_xor.reduce(s.reshape(-1, words), axis=0) for s in (one, two)]
    ones = lambda s: sum(bin(int(x) & overlap.WORD).count("1") for x in s)
    cells = ones(folded[0] ^ folded[1])
    assert ones(overlap.small_sketch(one) ^ overlap.small_sketch(two)) <= cells <= differ
    if len(b) and differ and den * common >= num * union:
        assert set(overlap.signatures(a, num, den, salt)) & set(overlap.signatures(b, num, den, salt))
        assert cells * (den + num) <= (len(a) + len(b)) * (den - num)


def test_signatures_of_unlike_sets_differ():
    rng = np.random.default_rng(0)
    seen = Counter(int(s) for _ in range(300) for s in overlap.signatures(np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)), 9, 10))
    assert sum(n > 1 for n in seen.values()) < 40  # parts without an element


def test_null_and_repeated_ids(spark):
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[40:80])
    docs = spark.createDataFrame([(None, a), (None, b), (5, a), (5, b), (3, b), (None, None), (9, "")], "doc_id long, text string")
    rows = overlap.jaccard_components(docs, ["doc_id"]).select("doc_id", "n", "component_id").collect()
    want = [(None, 38, 5), (None, 38, 3), (5, 38, 5), (5, 38, 3), (3, 38, 3), (None, 0, None), (9, 0, 9)]
    assert Counter(map(tuple, rows)) == Counter(want)


def test_only_a_to_z_are_folded(spark):
    docs = spark.createDataFrame([(1, "Ä b c d e f g h i j k l m n"), (2, "ä b c d e f g h i j k l m n"), (3, "Ä B c\x0bd\te f g h i j k l m\rn")], "doc_id long, text string")
    rows = overlap.jaccard_components(docs, ["doc_id"]).filter(F.col("n") == 12).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 2, 3: 1}
