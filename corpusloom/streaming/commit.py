"""Several tables written by one stream, visible together or not at all.

Each micro-batch writes its part of every table to a folder of this attempt; a manifest that
names these folders is published last, under the batch's number.  Readers follow manifests, so a
batch that failed between two tables, or was tried twice, shows nothing or shows once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commit(root: str, number: int, parts: dict[str, DataFrame]) -> bool:
    """Write the parts of one batch and publish them; False if the batch is published already.

    The manifest gets its name by a rename, which at most one of several attempts wins.
    """
    spark = next(iter(parts.values())).sparkSession
    store, manifest = _path(spark, f"{root}/manifests/{number:012d}.json")
    if store.exists(manifest):
        return False
    attempt = uuid.uuid4().hex
    named = {name: f"{name}/batch-{number:012d}-{attempt}" for name in parts}
    for name, df in parts.items():
        df.write.parquet(f"{root}/{named[name]}")
    draft = _path(spark, f"{root}/drafts/{attempt}")[1]
    out = store.create(draft)
    out.write(bytearray(json.dumps({"batch": number, "parts": [{"name": n, "path": p} for n, p in named.items()]}).encode()))
    out.close()
    store.mkdirs(manifest.getParent())
    return bool(store.rename(draft, manifest))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(batch, name, path) of all published parts."""
    fields = "batch long, parts array<struct<name: string, path: string>>"
    store, where = _path(spark, f"{root}/manifests")
    rows = spark.read.schema(fields).json(str(where)) if store.exists(where) else spark.createDataFrame([], fields)
    return rows.select("batch", F.explode("parts").alias("part")).select("batch", "part.*")


def visible(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of all published parts of a table."""
    paths = [f"{root}/{r['path']}" for r in manifests(spark, root).filter(F.col("name") == name).select("path").collect()]  # one for each batch
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def swept(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Remove the folders of attempts that no manifest names, and unpublished drafts; for a time when no batch is being written."""
    held = {r["path"] for r in manifests(spark, root).select("path").collect()}
    gone = []
    for name in (*names, "drafts"):
        store, where = _path(spark, f"{root}/{name}")
        for status in store.listStatus(where) if store.exists(where) else ():
            own = f"{name}/{status.getPath().getName()}"
            if own not in held:
                store.delete(status.getPath(), True)
                gone.append(own)
    return gone


def write_together(stream: DataFrame, root: str, parts_of: Callable[[DataFrame], dict[str, DataFrame]], once: bool = True) -> StreamingQuery:
    """Start a stream whose batches are cut into several tables below ``root``, each batch published as one."""

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            commit(root, number, parts_of(held))
        finally:
            held.unpersist()

    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
