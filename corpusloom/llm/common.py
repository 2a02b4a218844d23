"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and tasks are one process, falls back on a temporary
    folder; on a cluster the setting must name a folder that all machines see.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store with all that lies in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def no_larger_than(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, without counting further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a count; a larger side is left to a shuffled join."""
    return F.broadcast(df) if no_larger_than(df, rows) else df


def broadcast_if_light(df: DataFrame, weight: Column, total: int) -> DataFrame:
    """Broadcast hint where the weights of all rows add up to ``total`` at most."""
    light = (df.agg(F.sum(weight).alias("weight")).first()["weight"] or 0) <= total
    return F.broadcast(df) if light else df


def id_crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(column: str) -> list[Column]:
    """128 bits that name a text: two xxhash64 values under different prefixes."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(7), text).alias("key2")]


#: Rows of an Arrow batch of whole texts; Spark's default of 10,000 would hold tens of MB on both sides of each task.
BATCH_ROWS = 500


def texts_to_python(df: DataFrame) -> DataFrame:
    """``df`` unchanged, after lowering its session's Arrow batch size to BATCH_ROWS (a smaller one stays)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice stay near ``budget`` bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
            held += n or 0
            if held >= budget:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
