"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import queries

from .conftest import ODD_ROWS
from .test_brute import brute_contamination, plain_pii, simhash
from .test_fim import plain as plain_fim
from .test_overlap import grams

NAMES = list(queries.QUERIES)
BENCH = [{"item_id": 1, "text": "one two three"}, {"item_id": None, "text": None}, {"item_id": 2, "text": ""}]
LABELS = [{"doc_id": 1, "quality": 1, "toxic": 0}, {"doc_id": 2, "quality": None, "toxic": None}, {"doc_id": None, "quality": 0, "toxic": 0}, {"doc_id": 1, "quality": 0, "toxic": 0}]
TURNS = [
    {"conv_id": 1, "turn": 0, "role": "user", "text": "hi </s>"},
    {"conv_id": 1, "turn": 0, "role": None, "text": None},
    {"conv_id": None, "turn": None, "role": "assistant", "text": "x"},
    {"conv_id": 1, "turn": 1, "role": "assistant", "text": "[INST] \\ ~"},
]
VECTORS = [
    {"vec_id": 0, "embedding": [0.5, -0.25], "label": 0},
    {"vec_id": 1, "embedding": [0.5, -0.25], "label": 0},
    {"vec_id": 1, "embedding": [0.5, -0.25], "label": 0},
    {"vec_id": 2, "embedding": [float("nan"), 1.0], "label": 0},
    {"vec_id": 3, "embedding": [None, 1.0], "label": 0},
    {"vec_id": 4, "embedding": None, "label": None},
    {"vec_id": None, "embedding": [0.1, 0.1], "label": 1},
    {"vec_id": 50, "embedding": [0.001, 0.0], "label": 1},
    {"vec_id": 51, "embedding": [], "label": 1},
]


def tables():
    return {"documents": ODD_ROWS, "benchmark": BENCH, "labels": LABELS, "conversations": TURNS, "embeddings": VECTORS}


def per_row(values):
    """(doc_id, values) of the odd rows, as a multiset."""
    return Counter((r["doc_id"], values(r["text"] or "")) for r in ODD_ROWS)


def check_values(op, rows):
    """The defined results of the odd rows, from the plain versions."""
    empty = hashlib.sha256(b"").hexdigest()
    got = lambda *columns: Counter((r["doc_id"], tuple(r[c] for c in columns)) for r in rows)
    texts = {}
    for r in ODD_ROWS:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    if op == "op2":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        bare = {r["score"] for r in rows if all(not t for t in texts[r["doc_id"]])}
        assert len(bare) == 1  # nulls and empty texts score alike
    elif op == "op3":
        assert all(r["lossless"] and len(r["ids"]) == r["n_ids"] for r in rows)
        assert all(r["n_ids"] == 0 for r in rows if all(not t for t in texts[r["doc_id"]]))
    elif op == "op4":
        assert got("n_assign", "n_access", "n_hex", "n_live", "base_sha256", "spans", "classes") == per_row(lambda t: (0, 0, 0, 0, empty, "", ""))
    elif op == "op7":
        assert got("fingerprint") == per_row(lambda t: (f"{simhash(t):016x}",))
    elif op == "op8":
        lettered = lambda t: any(c.isalpha() for c in t)
        assert Counter((r["doc_id"], r["lang_pred"] == "und" and r["score"] == 0.0) for r in rows) == per_row(lambda t: not lettered(t))
    elif op == "op9":
        items = [(i["item_id"], i["text"]) for i in BENCH]
        want = lambda t: brute_contamination([(0, t)], items)[0]
        assert got("n_words", "n_hit", "n_items", "items_sha256", "contaminated") == per_row(want)
    elif op == "op10":
        base = lambda t: hashlib.sha256(",".join(plain_pii(t)).encode()).hexdigest()
        assert got("base_sha256", "n_email") == per_row(lambda t: (base(t), 0))
    elif op == "op11":
        assert got("n_shingles") == per_row(lambda t: (len(grams(t)),))
        # only equal sets link: each goes by its smallest id, what has none by its own
        least = {}
        for r in ODD_ROWS:
            least.setdefault(frozenset(grams(r["text"])), []).append(r["doc_id"])
        want = Counter()
        for r in ODD_ROWS:
            own = frozenset(grams(r["text"]))
            want[r["doc_id"], min((i for i in least[own] if i is not None), default=None) if own else r["doc_id"]] += 1
        assert Counter((r["doc_id"], r["component_id"]) for r in rows) == want
    elif op == "op12":
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = Counter()
        for r in ODD_ROWS:
            n, form, p, m, output = plain_fim(r["doc_id"], r["text"])
            want[r["doc_id"], (n, form, None if p is None else len(p), None if m is None else len(m), sha(output), sha(r["text"] or ""))] += 1
        assert got("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256") == want


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, make, name):
    rows = queries.QUERIES[name](spark, make(clash=True, **tables())).collect()
    if name.startswith("op5"):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows)
        # 128 * 128 + 64 * 64 for equal vectors, the copy of a row among them; 0 * 128 for the last
        assert got == [*((0, n, v, s) for n, v, s in ((1, 1, 20480), (2, 1, 20480), (3, 50, 0), (4, 51, 0))), *((50, n, v, 0) for n, v in ((1, 0), (2, 1), (3, 1), (4, 51)))]
    elif name.startswith("op6"):
        by = {r["conv_id"]: r for r in rows}
        assert set(by) == {1, None, -1} and by[1]["n_turns"] == 3
        assert by[1]["turns_sha256"] == hashlib.sha256("\n\nuser\nhi </s>\nassistant\n[INST] \\ ~\n".encode()).hexdigest()
        assert by[1]["loss_sha256"] == hashlib.sha256("[INST] \\ ~".encode()).hexdigest()
        assert by[-1]["n_turns"] == 2 and by[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")
    elif name.startswith("op13"):
        # six usable rows, each an entry of its own or the first of equal ones; an empty vector is zeros
        first = {"0.5": "00", "0.1": "05", "0.001": "03", "": "04"}
        assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in rows) == [(False, 0), (False, 1), (False, 1), (False, 50), (False, 51), (True, 0)]
        assert all(r["error"] == 0 and r["label_error"] == 0 and len(r["code"]) == 32 for r in rows)
        assert {r["vec_id"]: r["code"][:2] for r in rows} == {0: first["0.5"], 1: first["0.5"], 50: "03", 51: "03", None: first["0.1"]}
    else:
        check_values(name.split("_")[0], rows)
        assert len(rows) == len(ODD_ROWS)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in ODD_ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, make, name):
    rows = queries.QUERIES[name](spark, make()).collect()
    assert len(rows) == (1 if name.startswith("op6") else 0)


def test_shards(spark, make):
    rows = queries.QUERIES["op1_hash_tree_sharding"](spark, make(**tables())).collect()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((x["text"] or "").encode()) + 1, zlib.crc32((x["text"] or "").encode())) for x in ODD_ROWS)


def test_pipeline_on_odd_rows(spark, make):
    folder = make(clash=True, **tables())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns and docs.count() <= before.count()
    assert docs.filter("NOT lossless").count() == 0


def test_pipeline_on_nothing(spark, make):
    assert corpus_pipeline.run(spark, make()).count() == 0
