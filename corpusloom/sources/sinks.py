"""Outputs: tables, exports, and the packed node buffer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: one node of the packed buffer.
RECORD = "<ffffIIII"


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def done_keys(journal: DataFrame, key: list[str]) -> DataFrame:
    """Keys of journal rows that didn't fail."""
    return journal.filter(F.coalesce("failed", F.lit(False)) == False).select(*key).distinct()  # noqa: E712


def packed_nodes(nodes: DataFrame) -> DataFrame:
    """id and record: x, y, z, radius, and the first 32 bits of the path's hash, parent, kind and depth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fields = rows[["x", "y", "z", "radius", "hash", "parent", "kind", "depth"]].itertuples(index=False)
            yield pd.DataFrame({"id": rows["id"], "record": [struct.pack(RECORD, *map(float, r[:4]), *(int(v) & 0xFFFFFFFF for v in r[4:])) for r in fields]})

    hashed = nodes.withColumn("hash", F.xxhash64("path").bitwiseAND(0xFFFFFFFF))
    return hashed.select("id", "x", "y", "z", "radius", "hash", "parent", "kind", "depth").mapInPandas(run, "id long, record binary")
