"""A positional index over trigrams: keyword questions are answered from postings alone, no text is read.

Each task cuts its rows into segments of a bounded number of characters and writes, for each
trigram of a segment, the keys that hold it, how often, and at which places.  A term occurs where the trigrams
that cover it stand at their distances from one another, so its counts come from the
postings of each segment by intersection of shifted places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.operators.tables import cut

GRAM = 3
#: Characters of a segment (a longer text is one of its own).
SEGMENT = 1 << 21
#: Trigrams of a segment that go to Spark in one batch, and most rows of the table in a segment.
ROWS_A_SLOT, ROWS_A_SPLIT = 5_000, 50_000
#: A lookup reads the pages of its trigrams only, so row groups and pages are small.
LAYOUT = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.page.row.count.limit": 1000}


def packed(gram: str) -> int:
    """Three code points in one number."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def segment(keys: pa.Array, texts: list[str], number: int) -> pa.RecordBatch:
    """number, gram, keys, counts, places: a row for each trigram of the texts, its places flat by key and in order."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    begins = np.flatnonzero(row[: -(GRAM - 1)] == row[GRAM - 1 :])  # three characters of one text
    grams = codes[begins] << 42 | codes[begins + 1] << 21 | codes[begins + 2]
    order = np.argsort(grams, kind="stable")
    grams, row, place = grams[order], row[begins[order]], place[begins[order]]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    other = new.copy()
    other[1:] |= row[1:] != row[:-1]
    first, held = np.flatnonzero(new), np.flatnonzero(other)
    counts = np.diff(np.append(held, len(grams))).astype(np.int32)
    ends = pa.array(np.append(np.searchsorted(held, first), len(held)).astype(np.int32))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)).astype(np.int32)), pa.array(place))
    lists = [pa.ListArray.from_arrays(ends, keys.take(pa.array(row[held]))), pa.ListArray.from_arrays(ends, pa.array(counts)), places]
    return pa.record_batch([pa.array(np.full(len(first), number)), pa.array(grams[first]), *lists], ["segment", "gram", "keys", "counts", "places"])


def build(df: DataFrame, key: str, text: str, path: str) -> None:
    """Write ``postings``, ``lengths`` (key, dl) and ``totals`` of all rows below ``path``; keys are unique.

    Postings are written where the texts are read, without a shuffle: of about the size of the texts for each of
    keys and places, in order of trigrams within a segment.
    Rows without a key are left out; null texts and those of under three characters have no trigrams and length 0.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"), F.length(text).alias("n"))
    lengths = rows.select("key", F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - (GRAM - 1)).alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    totals = spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    most, batch_rows, characters = ROWS_A_SPLIT, ROWS_A_SLOT, SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def cut_off(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            whole = segment(pa.array(keys, kind), texts, number)
            yield from (whole.slice(at, batch_rows) for at in range(0, whole.num_rows, batch_rows))

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(name)
                texts.append(low)
                held += len(low)
                if held >= characters or len(keys) >= most:
                    yield from cut_off(kind)
                    number, keys, texts, held = number + 1, [], [], 0
        if keys:
            yield from cut_off(kind)

    kind = dict(rows.dtypes)["key"]
    found = rows.select("key", "low").mapInArrow(run, f"segment long, gram long, keys array<{kind}>, counts array<int>, places array<int>")
    found.write.mode("overwrite").options(**LAYOUT).parquet(f"{path}/postings")


def cover(term: str) -> list[int]:
    """Where trigrams begin that together hold every character of the term."""
    last = len(term) - GRAM
    return [*range(0, last, GRAM), last]


def occurrences(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(key, term, tf): how often each row holds each term, overlaps included; rows without one are absent.

    One shuffle, by segment, of the postings of the terms' trigrams.
    """
    covers = [[(packed(t[at : at + GRAM]), at) for at in cover(t)] for t in terms]
    held = spark.read.parquet(f"{path}/postings")
    kind = held.schema["keys"].dataType.elementType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, numbers = np.unique(np.concatenate(rows["keys"].to_list()), return_inverse=True)
        numbers = np.split(numbers, np.cumsum([len(k) for k in rows["keys"]])[:-1])
        begins = {g: np.repeat(k, n) * (1 << 32) + p for g, k, n, p in zip(rows["gram"], numbers, rows["counts"], rows["places"], strict=True)}
        out = []
        for i, grams in enumerate(covers):
            if all(g in begins for g, _ in grams):
                common = begins[grams[0][0]]
                for g, at in grams[1:]:
                    common = np.intersect1d(common, begins[g] - at, assume_unique=True)
                own, tf = np.unique(common >> 32, return_counts=True)
                out.append(pd.DataFrame({"key": names[own], "term": i, "tf": tf}))
        return pd.concat(out) if out else pd.DataFrame({"key": names[:0], "term": [], "tf": []})

    asked = held.filter(F.col("gram").isin(sorted({g for grams in covers for g, _ in grams})))
    return asked.groupBy("segment").applyInPandas(run, f"key {kind}, term int, tf int")


def search(spark: SparkSession, path: str, terms: list[str], key: str = "key") -> DataFrame:
    """(key, score): the scores of ``retrieval.bm25`` over all rows of the table, from the index alone."""
    terms = sorted({t.lower() for t in terms if len(t) >= GRAM})
    lengths = spark.read.parquet(f"{path}/lengths")
    if not terms:
        return lengths.select(F.col("key").alias(key), F.lit(0.0).alias("score")).limit(0)
    counted = cut(occurrences(spark, path, terms))
    held = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.count("*").alias("n")).collect()}
    total = spark.read.parquet(f"{path}/totals").first()
    k1, b = retrieval.K1, retrieval.B
    idf = {i: max(retrieval.LEAST_IDF, math.log((total["n"] - n + 0.5) / (n + 0.5))) for i, n in held.items()}
    norm = F.col("dl") / float(total["avg"] or 1.0) * (k1 * b) + k1 * (1 - b)
    tf = counted.groupBy("key").pivot("term", list(range(len(terms)))).agg(F.first("tf")).na.fill(0)
    scored = tf.join(lengths, "key")
    score = F.lit(0.0)
    for i, weight in sorted(idf.items()):
        score = score + F.lit(weight) * F.col(str(i)) * (k1 + 1) / (F.col(str(i)) + norm)
    return scored.select(F.col("key").alias(key), score.alias("score"))
