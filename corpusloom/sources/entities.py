"""The entities that queries run over, as views of the driver's tables.

``files`` and ``chunks`` are derived from ``documents`` by fixed rules; ``FILES_SQL``
and ``CHUNKS_SQL`` say the same in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a fixed-size chunk and of its overlap with the one before.
CHUNK, OVERLAP = 1024, 50
EXTENSIONS = ("md", "txt", "py", "pdf", "csv")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each document: its source is the folder tag and root."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.get(F.array(*[F.lit(x) for x in EXTENSIONS]), F.pmod(F.floor(n / 7), F.lit(len(EXTENSIONS))).cast("int"))
    root = F.concat(F.lit("/corpus/"), F.col("source"))
    name = F.concat(F.lit("doc"), n.cast("string"), F.lit("."), kind)
    return d.select(
        n.alias("file_id"),
        F.concat_ws("/", root, F.col("lang"), F.concat(F.lit("part"), (n % 7).cast("string")), name).alias("path"),
        F.octet_length("text").cast("long").alias("size"),
        kind.alias("type"),
        F.col("source").alias("folder_tag"),
        root.alias("root_path"),
        (n % 11).alias("usage_count"),
        (F.lit(1704067200) + n * 7919 % 7776000).cast("long").alias("modified_s"),
        F.when(n % 23 == 0, "").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"),
        F.when(n % 6 == 0, "").when(n % 17 == 0, "[ERROR: unreadable]").otherwise(F.substring("text", 1, 80)).alias("summary"),
    )


FILES_SQL = f"""files AS (
  SELECT doc_id AS file_id,
    '/corpus/' || source || '/' || lang || '/part' || (doc_id % 7) || '/doc' || doc_id || '.' || {list(EXTENSIONS)}[1 + doc_id // 7 % {len(EXTENSIONS)}] AS path,
    CAST(strlen(text) AS BIGINT) AS size, {list(EXTENSIONS)}[1 + doc_id // 7 % {len(EXTENSIONS)}] AS type, source AS folder_tag,
    '/corpus/' || source AS root_path, doc_id % 11 AS usage_count, 1704067200 + doc_id * 7919 % 7776000 AS modified_s,
    CASE WHEN doc_id % 23 = 0 THEN '' ELSE sha256(text) END AS sha256,
    CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 17 = 0 THEN '[ERROR: unreadable]' ELSE substr(text, 1, 80) END AS summary
  FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size chunks of every document, by code point."""
    return chunks_of(table(spark, sf_dir, "documents"))


def chunks_of(documents: DataFrame) -> DataFrame:
    from corpusloom.operators.chunking import fixed_chunks

    docs = documents.select(F.col("doc_id").alias("file_id"), "text")
    rows = fixed_chunks(docs, "text", CHUNK, OVERLAP)
    # five digits for the chunk: a text of over 97 million characters would run into the next file's ids, so it stops the job
    fits = F.when(F.col("seq") < 100000, F.col("seq")).otherwise(F.raise_error(F.lit("a file of over 100,000 chunks")).cast("long"))
    return rows.select((F.col("file_id") * 100000 + fits).alias("chunk_id"), "file_id", "seq", "start", "end", F.col("chunk").alias("text"))


CHUNKS_SQL = f"""chunks AS (
  SELECT doc_id * 100000 + i AS chunk_id, doc_id AS file_id, i AS seq, i * {CHUNK - OVERLAP} AS "start",
    least(i * {CHUNK - OVERLAP} + {CHUNK}, length(text)) AS "end", substr(text, i * {CHUNK - OVERLAP} + 1, {CHUNK}) AS text
  FROM documents, range(0, greatest(length(text) - 1, 0) // {CHUNK - OVERLAP} + 1) r(i) WHERE length(text) > 0)"""


def with_views(*parts: str) -> str:
    """The head of an oracle query over derived entities."""
    return "WITH " + ", ".join(parts) + "\n"
