"""The queue as a stream against the batch operators; tables of a stream that appear together; folders as a source."""

import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import state as st
from corpusloom.plans import streams
from corpusloom.sources import folders, readers
from corpusloom.streaming import commit, ingest, queue

FIELDS = [f.split()[0] for f in queue.REQUESTS.split(", ")]


def request(path, seq, at, kind, **more):
    return tuple(({"file_path": path, "seq": seq, "at": at, "request": kind} | more).get(f) for f in FIELDS)


def latest(spark, out):
    """The last state of each document, whatever batch it came in."""
    rows = spark.read.parquet(f"{out}/data")
    cols = [c for c in rows.columns if c not in ("batch", "file_path")]
    return {r["file_path"]: tuple(r["x"]) for r in rows.groupBy("file_path").agg(F.max_by(F.struct(*cols), "batch").alias("x")).collect()}


def test_queue_stream_equals_the_batch_operators(spark, tmp_path):
    rng = random.Random(4)
    paths = [f"/d/{i}" for i in range(12)]
    table = spark.createDataFrame([], st.QUEUE)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    seq = 0
    for step in range(5):
        now, batch = 1_000 + 500 * step, []
        asked = [(p, [rng.choice([1, 2, 3, None]) for _ in range(rng.randrange(4))], 9, "cpu", rng.random() < 0.5, i) for i, p in enumerate(rng.sample(paths, 6 if step == 0 else 2))]
        table = st.enqueue(table, spark.createDataFrame(asked, "file_path string, pages array<int>, page_count int, tier string, force boolean, seq long"), now)
        for p, pages, n, tier, force, _ in asked:
            batch.append(request(p, seq := seq + 1, now, "enqueue", pages=pages, page_count=n, tier=tier, force=force))
        claimed = st.claim(table, now, 900, 3, 3)
        for r in claimed.filter("claimed").collect():
            batch.append(request(r["file_path"], seq := seq + 1, now, "claim"))
        table = claimed.drop("claimed")
        verdicts = [(p, rng.choice(["progress", "done", "failed", "skipped", "release", "requeue"]), rng.randrange(3), "e" * 600, rng.random() < 0.5) for p in rng.sample(paths, 4)]
        table = st.apply_verdicts(table, spark.createDataFrame(verdicts, "file_path string, verdict string, pages_done int, error string, terminal boolean"), now)
        table = spark.createDataFrame(table.collect(), st.QUEUE)
        for p, verdict, done, error, terminal in verdicts:
            batch.append(request(p, seq := seq + 1, now, verdict, pages_done=done, error=error, terminal=terminal))
        spark.createDataFrame(batch, queue.REQUESTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(queue.REQUESTS).parquet(source)
        ingest.drained(queue.queue_states(stream, 900, 3, timers=False), out, "update")
    cols = [f.split()[0] for f in st.QUEUE.split(", ")][1:]
    assert latest(spark, out) == {r["file_path"]: tuple(r[c] for c in cols) for r in table.collect()}


class Held(dict):
    """A map state and its handle in memory."""

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.pop

    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Held())

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_call_serves_many_documents_and_a_timer_many_claims():
    handle, of = Held(), queue._Queue(1, 3, True)
    of.init(handle)
    clock = lambda now: type("T", (), {"getCurrentProcessingTimeInMs": lambda self: now, "getExpiryTimeInMs": lambda self: now})()
    rows = [request(f"/{i}", seq, 5, kind, pages=[1]) for i in range(50) for seq, kind in ((2, "claim"), (1, "enqueue"))]
    ask = lambda some, now: [r[:1] + r[5:6] for df in of.handleInputRows((0,), iter([pd.DataFrame(x, columns=FIELDS) for x in some]), clock(now)) for r in df[["file_path", *queue._FIELDS]].itertuples(index=False)]
    assert sorted(ask([rows[:30], rows[30:]], 1000)) == sorted((f"/{i}", "running") for i in range(50)) and handle.timers == {2000}
    ask([[request("/7", 3, 6, "progress", pages_done=1), request("/8", 4, 6, "done"), request("/none", 5, 6, "claim")]], 1500)
    assert handle.timers == {2000, 2500}
    first, second = (pd.concat(list(of.handleExpiredTimer((0,), clock(t), clock(t)))) for t in (2000, 2500))
    assert set(first["file_path"]) == {f"/{i}" for i in range(50) if i not in (7, 8)} and set(first["status"]) == {"pending"}
    assert list(second["file_path"]) == ["/7"] and not handle.maps["waiting"]


def test_a_stale_claim_comes_back(spark, tmp_path):
    source, out, states = str(tmp_path / "in"), str(tmp_path / "out"), []
    rows = [request("/a", 1, 10, "enqueue", pages=[1], page_count=1, tier="cpu", force=False), request("/a", 2, 11, "claim"), request("/b", 3, 10, "enqueue", pages=[1], page_count=1, tier="cpu", force=False), request("/b", 4, 11, "claim"), request("/b", 5, 12, "done")]
    spark.createDataFrame(rows, queue.REQUESTS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(queue.REQUESTS).parquet(source)
    running = queue.queue_states(stream, stale_after=2).writeStream.outputMode("update").option("checkpointLocation", out).trigger(processingTime="1 second")
    running = running.foreachBatch(lambda df, n: states.extend((r["file_path"], r["status"], r["attempts"]) for r in df.collect())).start()
    try:
        until = time.time() + 60
        while time.time() < until and ("/a", "pending", 1) not in states:
            time.sleep(0.5)
    finally:
        running.stop()
    assert ("/a", "running", 1) in states and ("/a", "pending", 1) in states  # the attempt stays spent
    assert [s for s in states if s[0] == "/b"] == [("/b", "done", 1)]


CHUNKS, VECTORS = "id long, text string", "id long, size long"


def test_two_tables_appear_together_or_not_at_all(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    spark.range(10).select("id", F.lit("ab").alias("text")).coalesce(1).write.parquet(source)
    broken = [True]

    def parts(batch):
        vectors = batch.select("id", F.length("text").cast("long").alias("size"))
        if broken[0]:  # fails when the second table is written
            vectors = vectors.withColumn("size", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("size")))
        return {"chunks": batch, "vectors": vectors}

    def run():
        stream = spark.readStream.schema(CHUNKS).parquet(source)
        query = commit.write_together(stream, root, parts)
        try:
            query.awaitTermination()
        finally:
            query.stop()

    counts = lambda: (commit.visible(spark, root, "chunks", CHUNKS).count(), commit.visible(spark, root, "vectors", VECTORS).count())
    with pytest.raises(Exception, match="lost"):
        run()
    assert len(os.listdir(f"{root}/chunks")) == 1 and counts() == (0, 0)  # the first table's part is there, but no one sees it
    broken[0] = False
    run()
    assert counts() == (10, 10)
    spark.range(10, 15).select("id", F.lit("abc").alias("text")).coalesce(1).write.mode("append").parquet(source)
    run()
    assert counts() == (15, 15)
    # a batch that is tried again after it was published changes nothing
    assert commit.commit(root, 0, parts(spark.read.parquet(source))) is False and counts() == (15, 15)
    gone = commit.swept(spark, root, ["chunks", "vectors"])
    assert any(g.startswith("chunks/") for g in gone) and counts() == (15, 15)
    assert len(os.listdir(f"{root}/chunks")) == 2


@pytest.mark.parametrize("files", [1, 5])
def test_tables_of_one_or_more_files_stream_whole(spark, tmp_path, files):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("bee").alias("text"), (F.col("id") % 4).alias("user_id"), F.col("id").alias("event_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    for name in ("documents", "events"):
        rows.repartition(files).write.parquet(str(tmp_path / f"{name}-all"))
        if files > 1:
            (tmp_path / f"{name}-all").rename(tmp_path / f"{name}.parquet")
        else:
            next((tmp_path / f"{name}-all").glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    assert streams.stream_two_tables(spark, str(tmp_path)).filter("chars = 3 AND e = 2").count() == 40
    assert sorted(tuple(r) for r in streams.stream_last_seen(spark, str(tmp_path)).collect()) == [(u, 10, 36 + u) for u in range(4)]
    assert [(r["n"], r["total"]) for r in streams.stream_windows(spark, str(tmp_path)).collect()] == [(40, 40.0)]


@pytest.fixture
def tree(tmp_path):
    for i in range(40):
        folder = tmp_path / f"a{i % 5}" / f"b{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.{'PY' if i % 2 else 'md'}").write_text("x" * i)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.py").write_text("no")
    (tmp_path / "a0" / ".secret.py").write_text("no")
    (tmp_path / "top.py").write_text("top")
    return tmp_path


def test_folder_source_reads_what_discover_finds(spark, tree):
    folders.register(spark)
    for kinds in (["py"], ["md", "py"], []):
        want = {(r["path"], r["size"], r["type"], bytes(r["content"])) for r in readers.discover(spark, [str(tree)], kinds, content=True).collect()}
        rows = spark.read.format("corpus_folder").option("roots", str(tree)).load()
        rows = rows.filter(F.col("type").isin(*kinds)) if kinds else rows
        # Spark's own reader of whole files leaves out empty ones
        assert {(r["path"], r["size"], r["type"], bytes(r["content"])) for r in rows.collect() if r["size"]} == want
    some = spark.read.format("corpus_folder").option("roots", f'["{tree}/a1", "{tree}/a2"]').option("content", "false").load().filter("size > 10 AND type = 'py' AND length(path) > 3")
    assert {(r["size"], r["content"]) for r in some.collect()} == {(i, None) for i in range(11, 40) if i % 5 in (1, 2) and i % 2}


def test_filters_are_taken_over(tree):
    reader = folders.FolderReader([str(tree)], True)
    back = list(reader.pushFilters([folders.EqualTo(("type",), "py"), folders.GreaterThan(("size",), 10), folders.EqualTo(("modified_at",), 1)]))
    assert len(back) == 1 and len(reader.filters) == 2
    found = [row for p in reader.partitions() for row in reader.read(p)]
    assert {r[1] for r in found} == {i for i in range(11, 40) if i % 2}


def test_folder_stream_gives_each_file_once(spark, tree, tmp_path_factory):
    folders.register(spark)
    out = str(tmp_path_factory.mktemp("out"))

    def poll():
        ingest.drained(spark.readStream.format("corpus_folder").option("roots", str(tree)).option("settle", "0").load().select("path", "size"), out, "append")
        return sorted(os.path.basename(r["path"]) for r in spark.read.parquet(f"{out}/data").collect())

    first = poll()
    assert len(first) == len(set(first)) == 41
    time.sleep(0.05)
    (tree / "a1" / "new.md").write_text("new")
    assert poll() == sorted([*first, "new.md"])
