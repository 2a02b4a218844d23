"""The engine facade, the bounded question loop and the write path."""

from pyspark.sql import functions as F

from corpusloom.plans import indexing, search


def engine(spark):
    files = spark.createDataFrame([(i, f"/r/{i}.md", "ab"[i % 2], i) for i in range(6)], "file_id long, path string, folder_tag string, size long").withColumn("type", F.lit("md"))
    chunks = spark.createDataFrame([(i * 100000, i, f"alpha beta text number {i} " + "gamma " * i) for i in range(6)], "chunk_id long, file_id long, text string")
    vectors = spark.createDataFrame([(i * 100000, [1.0, float(i)]) for i in range(6)], "vec_id long, embedding array<float>")
    return indexing.Engine(files, chunks, vectors, lambda question: [1.0, 5.0])


def test_three_verbs(spark):
    e = engine(spark)
    rows = e.retrieve("gamma", k=3)
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0]["file_id"] == 5
    assert e.retrieve("gamma", k=3) is rows and {r["file_id"] % 2 for r in e.retrieve("gamma", k=3, folder_tag="a")} == {0}
    e.replace(e.files, e.chunks, e.vectors)
    assert e.retrieve("gamma", k=3) is not rows
    assert e.chunk(300000).first()["file_id"] == 3 and e.stats().count() == 3


def test_rerank_and_degradation(spark):
    e = engine(spark)
    rows = e.retrieve("gamma", k=6, rerank=lambda df: df.withColumn("logit", -F.col("file_id")))
    assert {r["file_id"] for r in rows} == {0, 1, 2, 3, 4, 5}
    found = spark.createDataFrame([(1,), (2,)], "x int")

    def broken(df):
        raise RuntimeError("no model")

    assert [r["degraded"] for r in search.gated_rerank(found, broken).collect()] == [True, True]
    assert [r["degraded"] for r in search.gated_rerank(found.limit(1), broken).collect()] == [False]
    assert search.recall_size("a b", 5) == 20 and search.recall_size("a b c d", 30) == 60


def test_question_loop():
    calls = []

    def retrieve(q):
        calls.append(q)
        return [("a", 1.0, 10), (q, 2.0, 10)]

    found, trace = indexing.agentic("q", lambda q: [q], retrieve, lambda rows: False)
    assert [r[0] for r in found[:2]] == ["q", "q 1"] and len(trace) == 3
    found, trace = indexing.agentic("q", lambda q: [], retrieve, lambda rows: True)
    assert len(trace) == 1
    found, _ = indexing.agentic("q", lambda q: [q], retrieve, lambda rows: False, budget=10)
    assert len(found) == 1


def test_roots_and_models():
    assert indexing.validated_folders(["/", "/data/x/", "/data/x", "rel", "/etc"]) == ["/data/x"]
    assert indexing.same_model(None, {"name": "m"}) and not indexing.same_model({"name": "n"}, {"name": "m"})


def test_index_run_and_rebuild(spark, tmp_path):
    import pytest

    seen = spark.createDataFrame([(i, f"/r/{i}.md", "md", "/r", "t", 5, 10, f"sha{i}", "" if i == 2 else f"summary {i}") for i in range(4)], "file_id long, path string, type string, root_path string, folder_tag string, size long, modified_s long, sha256 string, summary string")
    known = seen.filter("file_id = 0")
    chunks = spark.createDataFrame([(i * 100000 + j, i, f"text {i} {j}") for i in range(4) for j in range(3)], "chunk_id long, file_id long, text string")
    calls = []
    embed = lambda texts: calls.append(len(texts)) or [[float(len(t))] for t in texts]
    counts = indexing.index_run(seen, known, chunks, embed, str(tmp_path / "index"))
    assert counts == {"chunks": 9, "summaries": 2, "profiles": 1, "vectors": 9}
    assert indexing.rebuilt(seen, chunks, embed, str(tmp_path / "all")) == {"chunk": 12, "summary": 3}
    vectors = {(r["target"], r["id"]): r["vector"] for r in indexing.reembedded(seen, chunks, embed).collect()}
    assert vectors["chunk", 100001] == [float(len("[MD: 1.md] text 1 1"))] and vectors["summary", 3] == [9.0]
    with pytest.raises(Exception):
        indexing.rebuilt(seen, chunks, lambda texts: [], str(tmp_path / "bad"))


def test_polls_and_question_vectors(spark):
    handed = []
    assert indexing.polled(lambda: ["/a"], lambda: True, handed.append) == [] and indexing.polled(lambda: [], lambda: False, handed.append) == [] and not handed
    assert indexing.polled(lambda: ["/a"], lambda: False, handed.append) == ["/a"] and handed == [["/a"]]
    asked = []
    e = indexing.Engine(None, None, None, lambda q: asked.append(q) or [1.0], prefix="query: ")
    assert e.embed("x") == e.embed("x") == [1.0] and asked == ["query: x"]
