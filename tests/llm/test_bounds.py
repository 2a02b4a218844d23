"""Samples and lists that stay bounded, and languages or numbers that once went wrong."""

import random

import corpus_pipeline
from corpusloom.llm import components, langid, pii, quality, topk

from .conftest import docs_of

EN = "the river was cold and they walked home early that morning with the others"
DE = "der fluss war kalt und sie gingen an diesem morgen mit den anderen frueh nach hause"


def few_letters(n):
    """A language of ``n`` letter-free texts and two with letters, and another of lettered ones only."""
    texts = [str(10_000 + i) for i in range(n)] + [DE, f"{DE} {DE[:30]}"] + [f"{EN} {i}" for i in range(300)]
    return [{**r, "lang": "de" if r["doc_id"] < n + 2 else "en"} for r in docs_of(texts)]


def test_a_language_of_mostly_letter_free_texts(spark, make):
    rows = few_letters(20_000)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.op8_language_id(spark, make(documents=rows)).collect()}
    assert all(got[i] == "und" for i in range(20_000))
    assert all(got[r["doc_id"]] == "en" for r in rows[20_002:])


def test_its_lettered_texts_are_what_the_centroids_learn(spark):
    rows = [(str(i), "de") for i in range(30_000)] + [(f"{DE} {i}", "de") for i in range(40)] + [(f"{EN} {i}", "en") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.languages) == {"de", "en"}
    assert langid.classify(DE, model)[0] == "de" and langid.classify(EN, model)[0] == "en"


def test_the_pipeline_takes_them_too(spark, make):
    rows = few_letters(3_000)
    folder = make(documents=rows)
    kept = corpus_pipeline.known_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in rows[3_000:]} and len(kept) >= 300


def test_no_letters_at_all(spark):
    assert langid.fit(spark.createDataFrame([("12 34", "de"), ("!", "en"), (None, "fr"), ("x", None)], "text string, lang string")) is None


def test_random_digit_runs_are_left_alone(spark):
    """Digit runs of a card's length without a cue; those that pass the check digit are base spans."""
    rng = random.Random(5)
    words = EN.split()
    rows = []
    for i in range(2_000):
        first = rng.choice(["4", "51", "37", "6011", ""]) if i % 2 else ""
        digits = first + "".join(rng.choices("0123456789", k=16 - len(first)))
        rows.append((i, f"{' '.join(rng.choices(words, k=8))} {digits} {' '.join(rng.choices(words, k=8))}"))
    rows += [(2_000 + i, f"mail anna{i}@mail.com, card 4111 1111 1111 1111") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_pii(docs).filter("doc_id < 2000").collect()
    added = [r["doc_id"] for r in found if "number:" in r["spans"]]
    unmarked = [r["doc_id"] for r in found if r["n_card"] == 0]
    assert len(unmarked) > 1_500 and len(added) <= len(unmarked) // 100
    masked = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert sum(masked[i] != rows[i][1] for i in unmarked) <= len(unmarked) // 100


def test_the_fitting_sample_is_bounded_in_cells(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = [(" ".join(word() for _ in range(6)) + (" good fine" if i % 2 else " poor bad"), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "text string, quality long")
    whole = quality.fit(df)
    one = len(quality.indicators(rows[0][0], quality.np.zeros(1 << quality.BITS, bool)))
    monkeypatch.setattr(quality, "SAMPLE_CELLS", 30 * one)
    some = quality.fit(df)
    assert isinstance(whole, quality.Model) and isinstance(some, quality.Model)
    assert (some.weight != 0).sum() < 0.6 * (whole.weight != 0).sum()


def test_bands_in_reach(spark):
    rng = random.Random(3)
    bands = [(i, float(v)) for i, v in enumerate(sorted((rng.randrange(50) for _ in range(40)), reverse=True)) if i % 7 != 5 and i >= 4]
    blocks = [(i, rng.choice([float("-inf"), 0.0, 12.0, 25.0, 49.0, 60.0])) for i in range(30)]
    got = topk._in_reach(spark.createDataFrame(bands, "band long, longest double"), spark.createDataFrame(blocks, "block long, reach double"))
    assert {(r["band"], r["block"]) for r in got.collect()} == {(b, q) for b, v in bands for q, reach in blocks if reach <= v}


def test_rounds_over_few_edges_have_few_partitions(spark, monkeypatch):
    held, name = [], "spark.sql.adaptive.coalescePartitions.enabled"

    def kept(df):
        held.append(df.rdd.getNumPartitions())
        return checkpointed(df)

    checkpointed = components.checkpointed
    monkeypatch.setattr(components, "checkpointed", kept)
    spark.conf.set(name, "false")
    try:
        got = {r["node"]: r["component"] for r in components.connected_components(spark.range(40).selectExpr("id * 3 AS a", "id * 3 + 3 AS b").repartition(4)).collect()}
    finally:
        spark.conf.unset(name)
    assert got == {3 * i: 0 for i in range(41)}
    assert len(held) > 2 and set(held[1:]) == {1}
