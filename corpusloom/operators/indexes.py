"""Indexes beside a table: built once for a state of the table, published whole, found again by its fingerprint."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.tables import shared_folder

#: Goes up when an index is laid out anew, so that older ones are not taken for it.
FORMAT = 3


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fingerprint(df: DataFrame, *more: object) -> str:
    """A digest of the names, sizes and times of the files that ``df`` reads, and of ``more``."""
    spark, digest = df.sparkSession, hashlib.sha256(repr((FORMAT, sorted(df.columns), *more)).encode())
    for name in sorted(df.inputFiles()):
        store, where = _path(spark, name)
        status = store.getFileStatus(where)
        digest.update(f"{name}\t{status.getLen()}\t{status.getModificationTime()}\n".encode())
    return digest.hexdigest()[:32]


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _path(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    store, where = _path(spark, path)
    store.delete(where, True)


def published(df: DataFrame, kind: str, build: Callable[[str], None], *more: object) -> str:
    """The folder of the index of this kind for the files that ``df`` reads, built if there is none.

    ``build`` writes to a folder of its own that gets its final name once whole, so a build that
    fails or is lost leaves nothing that a reader could take for an index; of two builds at a
    time one wins.  Another state of the table has another folder.
    """
    spark = df.sparkSession
    final = f"{shared_folder(spark)}/{kind}-{fingerprint(df, *more)}"
    if exists(spark, final):
        return final
    part = f"{final}.part-{uuid.uuid4().hex}"
    build(part)
    store, where = _path(spark, part)
    if exists(spark, final) or not store.rename(where, _path(spark, final)[1]):
        store.delete(where, True)
    return final
