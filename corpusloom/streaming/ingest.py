"""Structured Streaming: incremental ingest, event windows and per-path state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str, per_batch: int = 16) -> DataFrame:
    """A table's files as a stream, be the table one file or a folder of them; new files are picked up a bounded number at a time."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(f"{folder}/{name}")
    return stream.option("pathGlobFilter", name).parquet(folder)


def _event_time(events: DataFrame) -> DataFrame:
    """Watermarks need an instant: a timestamp without zone counts in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than the watermark are left out."""
    w = F.window("ts", size, slide or size)
    rows = _event_time(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return _event_time(events).withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def last_seen(events: DataFrame) -> DataFrame:
    """user_id, n, last_id: running state of each key, kept across micro-batches; the last row of a key counts."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        for rows in parts:
            n, last = n + len(rows), max(last, int(rows["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_id": [last]})

    fields = "user_id long, n long, last_id long"
    return events.groupBy("user_id").applyInPandasWithState(update, fields, "n long, last_id long", "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, out: str, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all there is now.  Every micro-batch goes to a folder named by its id, so a retried one replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    query: StreamingQuery = (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(write or store).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def ingest(spark: SparkSession, stream: DataFrame, known: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Poll for files: each micro-batch is compared with the rows known and only what changed is applied.

    ``known`` gives the table's state now, ``apply`` stores (path, state, ...) rows of one batch.
    """
    from corpusloom.operators.scopes import change_state

    def step(batch: DataFrame, number: int) -> None:
        changed = change_state(known(), batch).filter("state <> 'unchanged'")
        apply(batch.join(changed, "path"), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="10 seconds").foreachBatch(step).start()
