"""Table maintenance: each operator gives the new state of a table as a DataFrame."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


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


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that later plans read them and don't derive them again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def ancestors(df: DataFrame, path: str) -> DataFrame:
    """One row for each folder above each path, and the path itself, as ``ancestor``."""
    parts = F.split(path, "/")
    each = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return df.withColumn("ancestor", F.explode(F.when(F.size(parts) > 1, each).otherwise(F.array(F.col(path)))))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1, 2, 3 ... along a total order, without one task for all rows.

    Rows are range-partitioned and sorted; each partition's count is all that is
    gathered to find where it starts.  They are written once with their places: a
    second evaluation could draw other ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    ends = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = ends.select("__part", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))  # a row for each partition
    out = ranged.join(F.broadcast(first), "__part")
    return out.withColumn(name, F.col("__first") + F.col("__at") - F.col("__low") + 1).drop("__part", "__at", "__n", "__low", "__first")


def upsert(old: DataFrame, new: DataFrame, key: str, surrogate: str) -> DataFrame:
    """``old`` with the rows of ``new`` by key; new keys get ids after the greatest, in order of key."""
    fields = [c for c in old.columns if c not in (key, surrogate)]
    incoming = new.select(key, *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__in"))
    both = old.join(incoming, key, "left")
    kept = both.select(surrogate, key, *[F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields])
    fresh = numbered(new.join(old.select(key), key, "left_anti"), [F.asc(key)], "__rn")
    top = old.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("__top"))
    added = fresh.join(F.broadcast(top), how="cross")  # one row
    return kept.unionByName(added.select((F.col("__top") + F.col("__rn")).alias(surrogate), key, *fields))


def last_writer(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the greatest ``by``."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("__row"))
    return best.select(*keys, "__row.*")


def vanished(indexed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows no longer seen, under roots of which something was seen (a dead root removes nothing)."""
    alive = scanned.select("root_path").distinct()
    return indexed.join(alive, "root_path", "left_semi").join(scanned.select("path"), "path", "left_anti")


def newest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n newest rows and those that tie with the last of them.

    The cutoff comes from a distributed top-n, so no window spans the table.
    """
    cutoff = df.select(by).orderBy(F.desc(by)).limit(n).agg(F.min(by).alias("__cut"))
    return df.join(F.broadcast(cutoff), F.col(by) >= F.col("__cut")).drop("__cut")  # one row


def running_total(df: DataFrame, size: str, number: str, name: str, bucket: int = 4096) -> DataFrame:
    """``name``: the sum of ``size`` over all rows up to each one by ``number`` (1, 2, 3 ...).

    Sums go by buckets, and sums of buckets by buckets of buckets, so a window never
    holds more than ``bucket`` rows, up to bucket ** 3 rows in all.
    """
    rows = df.withColumn("__b", F.floor(F.col(number) / bucket)).withColumn("__c", F.floor(F.col("__b") / bucket))
    low = rows.groupBy("__c", "__b").agg(F.sum(size).alias("__s"))
    high = low.groupBy("__c").agg(F.sum("__s").alias("__s"))
    before = lambda of: F.coalesce(F.sum("__s").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = high.select("__c", before(Window.orderBy("__c")).alias("__high"))  # a row for bucket ** 2 rows
    low = low.select("__c", "__b", before(Window.partitionBy("__c").orderBy("__b")).alias("__low"))
    run = rows.join(low.join(high, "__c"), ["__c", "__b"])
    own = Window.partitionBy("__c", "__b").orderBy(number)
    total = F.col("__high") + F.col("__low") + F.sum(size).over(own)
    return run.withColumn(name, total).drop("__b", "__c", "__high", "__low")


def evict(df: DataFrame, size: str, order: list[Column], limit: int) -> DataFrame:
    """The newest rows (``order``: oldest last) whose sizes add up to the limit at most."""
    run = running_total(numbered(df, order, "__rn"), size, "__rn", "__total")
    return run.filter(F.col("__total") <= limit).drop("__rn", "__total")


def write_state(df: DataFrame, path: str) -> DataFrame:
    """Write a table's new state beside the old ones and read it back: readers of an old state keep it."""
    out = f"{path}/state-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def sql(spark: SparkSession, text: str, args: dict[str, object], **frames: DataFrame) -> DataFrame:
    """A parameterised statement over DataFrames by name."""
    return spark.sql(text, args=args, **frames)


#: What a reset empties.  The page cache goes by content, so it outlives the files and goes only when asked for.
CLEARED = {
    "all": ("files", "chunks", "vectors", "history", "profiles", "queue"),
    "vectors": ("vectors",),
    "history": ("history",),
    "cache": ("cache",),
}


def cleared(state: dict[str, DataFrame], what: str) -> dict[str, DataFrame]:
    """The new state of all tables after a reset of ``what``: emptied ones keep their columns, the others their rows."""
    return {name: df.limit(0) if name in CLEARED[what] else df for name, df in state.items()}


def reset_counts(state: dict[str, DataFrame], what: str) -> DataFrame:
    """(target, removed, left) of each table for a reset of ``what``."""
    out = None
    for name, df in state.items():
        n, none = F.count("*"), F.lit(0).cast("long")
        removed, left = (n, none) if name in CLEARED[what] else (none, n)
        row = df.agg(F.lit(name).alias("target"), removed.alias("removed"), left.alias("left"))
        out = row if out is None else out.unionByName(row)
    return out
