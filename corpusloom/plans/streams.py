"""Streaming queries over events (event-time windows go beyond what is otherwise needed), and extraction from files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.tables import shared_folder
from corpusloom.plans.registry import query
from corpusloom.plans.texts import stream_sql
from corpusloom.sources import blocks, folders, readers, sinks
from corpusloom.sources.entities import CHUNKS_SQL, FILES_SQL, chunks_of, files, table, with_views
from corpusloom.streaming import commit, ingest, queue


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, df: DataFrame, name: str, mode: str) -> DataFrame:
    out = _folder(spark, name)
    ingest.drained(df, out, mode)
    return spark.read.parquet(f"{out}/data")


@query(
    "stream_windows",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:  # §2.14: tumbling windows, the last state of each
    rows = _streamed(spark, ingest.windowed(ingest.event_stream(spark, d, "events.parquet"), "1 day"), "windows", "update")
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("start", "event_type", "x.*")


@query("stream_last_seen", "SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY user_id")
def stream_last_seen(spark: SparkSession, d: str) -> DataFrame:  # §2.14: keyed state over micro-batches
    rows = _streamed(spark, ingest.last_seen(ingest.event_stream(spark, d, "events.parquet")), "seen", "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n", "last_id"), "batch").alias("x")).select("user_id", "x.*")


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sessions(table(spark, d, "events"), "6 hours")


@query(
    "file_text_round_trip",
    "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT lang, trim(replace(text, chr(13), '')) AS text FROM documents) GROUP BY lang",
)
def file_text_round_trip(spark: SparkSession, d: str) -> DataFrame:  # S1, S2, S7, S8, S10: documents written as JSON lines, found and read again
    out = _folder(spark, "files")
    docs = table(spark, d, "documents").select("lang", F.trim(F.replace("text", F.lit("\r"), F.lit(""))).alias("text"))
    sinks.export_json(docs, f"{out}/all")
    lines = blocks.text_lines(readers.discover(spark, [f"{out}/all"], [".JSON"], content=True))
    rows = lines.select(F.from_json("line", "lang string, text string").alias("x")).select("x.*")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_BLOCK_FILES = "SELECT doc_id // 500 AS file, string_agg(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY 1"


@query("chunk_blocks", f"SELECT file, start, \"end\" FROM ({stream_sql(_BLOCK_FILES, 'file')})")
def chunk_blocks(spark: SparkSession, d: str) -> DataFrame:  # C1, S8: files of 500 documents, a line each, cut by blocks of 256 KB
    out = _folder(spark, "blocks")
    lines = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 500).alias("file"), "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\f\r ]+", " ").alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(parts, "file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(out)
    rows = blocks.block_chunks(readers.discover(spark, [out], ["txt"]), block=1 << 18)
    return rows.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "start", "end")


@query("export_csv", with_views(FILES_SQL) + "SELECT path, CAST(size AS VARCHAR) AS size FROM files WHERE type = 'md'")
def export_csv(spark: SparkSession, d: str) -> DataFrame:  # K13
    out = _folder(spark, "export")
    sinks.export_csv(files(spark, d).filter("type = 'md'").select("path", "size"), out)
    return spark.read.option("header", True).csv(out)


@query("packed_nodes")
def packed_nodes(spark: SparkSession, d: str) -> DataFrame:  # K17, J16: binary records; tests unpack them
    f, zero = files(spark, d), F.lit(0.0)
    nodes = f.select(F.col("file_id").alias("id"), "path", zero.alias("x"), zero.alias("y"), zero.alias("z"), F.sqrt(F.col("size") + 1).alias("radius"), F.lit(0).alias("parent"), F.lit(1).alias("kind"), F.size(F.split("path", "/")).alias("depth"))
    return sinks.packed_nodes(nodes)


@query(
    "csv_extract",
    "SELECT 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS line FROM nation",
)
def csv_extract(spark: SparkSession, d: str) -> DataFrame:  # S9, S16, S17: rows as "header: value" lines
    out = _folder(spark, "csv")
    sinks.export_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), out)
    found = readers.extract(readers.discover(spark, [out], ["csv"], content=True))
    return found.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


@query(
    "history_append",
    """SELECT event_id, user_id, false AS fresh FROM events UNION ALL SELECT 1000000 + c_custkey, c_custkey, true FROM customer""",
)
def history_append(spark: SparkSession, d: str) -> DataFrame:  # K9: event rows are only ever appended
    out = _folder(spark, "history")
    old = table(spark, d, "events").select("event_id", "user_id", F.lit(False).alias("fresh"))
    new = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("event_id"), F.col("c_custkey").alias("user_id"), F.lit(True).alias("fresh"))
    for rows in (old, new):
        rows.write.mode("append").parquet(out)
    return spark.read.parquet(out)


@query("relevance_judgments", "SELECT CAST(doc_id AS VARCHAR) AS query, 'd' || (doc_id % 9) AS id, quality AS grade FROM labels WHERE quality > 0")
def relevance_judgments(spark: SparkSession, d: str) -> DataFrame:  # S19
    out = _folder(spark, "judgments")
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("query"), F.concat(F.lit("d"), (F.col("doc_id") % 9).cast("string")).alias("id"), F.col("quality").alias("grade"))
    rows.write.option("sep", "\t").option("header", True).csv(out)
    return readers.judgments(spark, out)


@query(
    "page_results",
    "SELECT CAST(event_id % 7 - 1 AS INTEGER) AS page, event_type AS text FROM events WHERE event_id % 7 - 1 >= 0 AND event_id % 5 <> 0",
)
def page_results(spark: SparkSession, d: str) -> DataFrame:  # S18: broken lines and negative pages are dropped
    out = _folder(spark, "pages")
    good = F.to_json(F.struct((F.col("event_id") % 7 - 1).cast("int").alias("page"), F.col("event_type").alias("text")))
    table(spark, d, "events").select(F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(good).alias("line")).write.text(out)
    return readers.ndjson(spark, out, "page int, text string")


@query(
    "stream_queue",
    """WITH r AS (SELECT c_custkey AS n, ['progress', 'done', 'failed', 'skipped', 'release', 'requeue', 'failed'][1 + c_custkey % 7] AS v, c_custkey % 4 <> 0 AS claimed, c_custkey % 14 = 6 AS t FROM customer),
h AS (SELECT *, claimed OR v = 'requeue' AS hit FROM r)
SELECT '/q/' || n AS file_path, CASE WHEN NOT hit THEN 'pending' WHEN v = 'progress' THEN 'running' WHEN v IN ('done', 'skipped') THEN v WHEN v = 'failed' AND t THEN 'failed' ELSE 'pending' END AS status,
  CAST(CASE WHEN NOT claimed OR v IN ('release', 'requeue') THEN 0 ELSE 1 END AS INTEGER) AS attempts, CAST(CASE WHEN claimed AND v = 'progress' THEN 2 WHEN claimed AND v = 'done' THEN 3 ELSE 0 END AS INTEGER) AS pages_done FROM h""",
)
def stream_queue(spark: SparkSession, d: str) -> DataFrame:  # §2.14, Q1-Q4: requests as a stream, a row of state for each document
    out, n = _folder(spark, "queue"), F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("progress", "done", "failed", "skipped", "release", "requeue", "failed")])
    of = lambda seq, kind, **more: F.struct(F.lit(seq).cast("long").alias("seq"), kind.alias("request"), *[(more.get(f, F.lit(None))).cast(t).alias(f) for f, t in (("pages", "array<int>"), ("terminal", "boolean"))])
    asked = F.array(
        of(1, F.lit("enqueue"), pages=F.array(F.lit(1), F.lit(2), (n % 9 + 3).cast("int"))),
        of(2, F.when(n % 4 != 0, "claim").otherwise("none")),
        of(3, F.get(names, (n % 7).cast("int")), terminal=n % 14 == 6),
    )
    rows = table(spark, d, "customer").select(F.concat(F.lit("/q/"), n.cast("string")).alias("file_path"), F.explode(asked).alias("r")).select("file_path", "r.*")
    rows = rows.select(
        "file_path", "seq", (1000 + F.col("seq")).alias("at"), "request", "pages", F.lit(9).alias("page_count"), F.lit("cpu").alias("tier"), F.lit(False).alias("force"), F.lit(2).alias("pages_done"), F.lit("e").alias("error"), "terminal",
    )
    rows.write.parquet(f"{out}/in")
    ingest.drained(queue.queue_states(spark.readStream.schema(queue.REQUESTS).parquet(f"{out}/in"), timers=False), f"{out}/out", "update")
    states = spark.read.parquet(f"{out}/out/data").groupBy("file_path").agg(F.max_by(F.struct("status", "attempts", "pages_done"), "batch").alias("x"))
    return states.select("file_path", "x.*")


@query(
    "stream_two_tables",
    with_views(CHUNKS_SQL) + "SELECT chunk_id, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS e FROM chunks",
)
def stream_two_tables(spark: SparkSession, d: str) -> DataFrame:  # §2.14, P2, P5: chunks and their stand-in vectors (counts of one letter), published batch by batch as one
    root, fields = _folder(spark, "together"), "chunk_id long, text string"
    stream = ingest.event_stream(spark, d, "documents.parquet")

    def parts(batch: DataFrame) -> dict[str, DataFrame]:
        rows = chunks_of(batch).select("chunk_id", "text")
        count = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
        return {"chunks": rows, "vectors": rows.select("chunk_id", count.cast("long").alias("e"))}

    running = commit.write_together(stream, root, parts)
    try:
        running.awaitTermination()
    finally:
        running.stop()
    chunks, vectors = commit.visible(spark, root, "chunks", fields), commit.visible(spark, root, "vectors", "chunk_id long, e long")
    return chunks.join(vectors, "chunk_id").select("chunk_id", F.length("text").cast("long").alias("chars"), "e")


@query(
    "folder_source",
    "SELECT type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'md' ELSE 'txt' END AS type, strlen(text) AS size FROM documents WHERE text IS NOT NULL AND text <> '') WHERE size > 500 GROUP BY type",
)
def folder_source(spark: SparkSession, d: str) -> DataFrame:  # S1-S3, P9: documents as files of their own, found by the data source with the test on size pushed to the walk
    out = _folder(spark, "folder")
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    docs.select(F.when(F.col("doc_id") % 3 == 0, "md").otherwise("txt").alias("type"), "doc_id", "text").foreachPartition(_as_files(out))
    folders.register(spark)
    found = spark.read.format("corpus_folder").option("roots", out).load().filter("size > 500")
    return found.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


def _as_files(out: str):
    """Writes each row's text to a file named by its id and type, through the store that the path names."""

    def write(rows) -> None:
        for row in rows:
            store, base, _ = folders.opened(out)
            store.create_dir(f"{base}/part{row['doc_id'] % 17}")
            with store.open_output_stream(f"{base}/part{row['doc_id'] % 17}/doc{row['doc_id']}.{row['type']}") as f:
                f.write(row["text"].encode())

    return write
