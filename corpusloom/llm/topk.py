"""Exact top-k inner products over integer vectors.

Vectors go in bands of descending length.  An orthogonal rotation from the SVD of
all vectors moves most of their length into the first coordinates, so a partial
inner product over these plus the Cauchy-Schwarz bound on the rest decides most
pairs.  Bands are searched in rounds, the longest first; after each round every
query's k-th best score so far is its bound.  A band whose greatest length cannot reach
the bounds of a block of queries is not sent to it, a vector whose partial sum and
residual cannot reach a query's bound is dropped, and only the rest is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import broadcast_if_small, checkpointed, table

#: Vectors of a band and queries of a block, which one task holds; vectors scored between two looks at the bounds.
BAND, QUERY_BLOCK, STEP = 16_384, 8192, 1024
#: Coordinates of the partial sums.
HEAD = 24
#: Pairs of a block and a band (16 bytes each) up to so many are broadcast.
BROADCAST_PAIRS = 500_000
#: Each round takes so many times the bands of all rounds before.
GROWTH = 3


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) per component, for every usable row.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without a vec_id; an empty vector counts as zeros.  Rows that repeat a vec_id or are
    exact copies stay, each a candidate of its own.
    """
    x = F.col("embedding")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vector = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & usable)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the width x width second moment summed over tasks."""

    def moment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("vector").to_pylist(), width).astype(float)
            total += x.T @ x
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

    cells = vectors.select("vector").mapInArrow(moment, "cell long, value double")
    total = np.zeros(width * width)
    for row in cells.groupBy("cell").agg(F.sum("value").alias("value")).toLocalIterator():  # width * width rows
        total[row["cell"]] = row["value"]
    values, rotation = np.linalg.eigh(total.reshape(width, width))
    return rotation[:, np.argsort(-values)]


def _packed(rows: DataFrame, block: str, width: int, kind: str) -> DataFrame:
    """One row for each range partition: ids, vectors (longest first) and their lengths in binary, and the greatest length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held)
            x = _matrix(rows["vector"], width)
            lengths = np.sqrt((x.astype(float) ** 2).sum(1))
            order = np.lexsort((rows["vec_id"], -lengths))
            parts = {"ids": rows["vec_id"].to_numpy(np.int64)[order], "data": x[order].astype(kind), "lengths": lengths[order]}
            yield pd.DataFrame({block: [int(rows[block].iloc[0])], **{k: [v.tobytes()] for k, v in parts.items()}, "longest": [float(lengths.max())]})

    rows = rows.withColumn(block, F.spark_partition_id().cast("long"))
    return rows.mapInPandas(run, f"{block} long, ids binary, data binary, lengths binary, longest double")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _scan(rotation: np.ndarray, head: int, k: int, width: int, kind: str, exact: type):
    """Of one block of queries and one band of vectors: each query's best k that reach its bound.

    ``exact``: a number type that holds every inner product without rounding.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        fields = ["block", "at", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=fields).astype("int64")
        vectors, queries = left.iloc[0], right.iloc[0]
        ids, own = np.frombuffer(vectors["ids"], np.int64), np.frombuffer(queries["ids"], np.int64)
        x = np.frombuffer(vectors["data"], kind).reshape(-1, width).astype(exact)
        q = np.frombuffer(queries["data"], kind).reshape(-1, width).astype(exact)
        x_lengths, q_lengths = np.frombuffer(vectors["lengths"]), np.frombuffer(queries["lengths"])
        bounds = np.frombuffer(queries["bounds"]).copy() if queries["bounds"] else np.full(len(q), -np.inf)
        xr, qr = x @ rotation, q @ rotation
        rest_x, rest_q = (np.sqrt(np.maximum(0, (m[:, head:] ** 2).sum(1))) for m in (xr, qr))
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        for at in range(0, len(x), STEP):
            part = slice(at, at + STEP)
            slack = 1e-6 * (1 + np.abs(np.where(np.isfinite(bounds), bounds, 0))) + 1e-9 * q_lengths * x_lengths[at]
            live = np.flatnonzero(q_lengths * x_lengths[at] + slack >= bounds)
            for some in np.array_split(live, -(-len(live) // STEP)) if len(live) else ():
                upper = qr[some, :head] @ xr[part, :head].T
                upper += np.outer(rest_q[some], rest_x[part])
                for row, i in enumerate(some):
                    near = at + np.flatnonzero(upper[row] + slack[i] >= bounds[i])
                    near = near[ids[near] != own[i]]
                    if len(near):
                        scores, those = found[i]
                        scores, those = np.concatenate([scores, (x[near] @ q[i]).astype(np.int64)]), np.concatenate([those, ids[near]])
                        best = _best(scores, those, k)
                        found[i] = scores[best], those[best]
                        if len(best) == k:
                            bounds[i] = max(bounds[i], scores[best[-1]])
        sizes = [len(s) for s, _ in found]
        at = np.repeat(np.arange(len(q)), sizes)
        out = pd.DataFrame({"block": int(key[0]), "at": at, "query_id": own[at], "vec_id": np.concatenate([v for _, v in found]), "score": np.concatenate([s for s, _ in found])})
        return out[fields].astype("int64")

    return run


def _bounded(blocks: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``blocks`` with each query's k-th best score so far and ``reach``, the least band length that any of them can gain from."""

    def gather(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lengths = np.frombuffer(left["lengths"].iloc[0])
        bounds = np.full(len(lengths), -np.inf)
        bounds[right["at"].to_numpy(np.int64)] = right["score"]
        least = np.where(bounds > 0, bounds * (1 - 1e-6) / np.maximum(lengths, 1e-300), -np.inf)
        return pd.DataFrame({"block": [key[0]], "bounds": [bounds.tobytes()], "reach": [float(least.min())]})

    kth = best.filter(F.col("n") == k).select("block", "at", "score")  # a row for each query of the block
    rows = blocks.select("block", "lengths").groupBy("block").cogroup(kth.groupBy("block"))
    return blocks.join(rows.applyInPandas(gather, "block long, bounds binary, reach double"), "block")


def _in_reach(bands: DataFrame, blocks: DataFrame) -> DataFrame:
    """(band, block) of all pairs whose longest vector reaches the block's bound.

    Bands are numbered from the longest on, so a block takes those up to the last one that
    it reaches: found by one sort of bands and blocks, a row for BAND vectors or QUERY_BLOCK queries.
    """
    none = F.lit(None).cast("long")
    every = bands.select(F.col("longest").cast("double").alias("reach"), F.col("band").cast("long").alias("band"), none.alias("block"))
    every = every.unionByName(blocks.select(F.col("reach").cast("double").alias("reach"), none.alias("band"), F.col("block").cast("long").alias("block")))
    first = bands.agg(F.min("band").cast("long").alias("__first")).first()[0]
    upto = Window.orderBy(F.desc("reach"), F.col("band").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = every.withColumn("last", F.max("band").over(upto)).filter("block IS NOT NULL AND last IS NOT NULL")
    pairs = last.select(F.explode(F.sequence(F.lit(first), "last")).alias("band"), "block")
    return pairs.join(bands.select("band"), "band", "left_semi")  # a range may have stayed empty


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of every query.

    ``vectors`` and ``queries`` are (vec_id, vector of long).  Rows of a query's own vec_id are
    no candidates; ties go to the smaller vec_id; with fewer candidates all are
    returned.  Vectors of unequal width count as padded with zeros; without
    vectors or queries there are no rows.  Repeated vec_ids are candidates each, and
    as queries share one list.  Work goes by (block of queries, band of vectors): no
    task holds more than one of each, and a pair whose band is too short for the
    block's bounds is left out before anything is sent.
    """
    vectors = checkpointed(vectors)
    spark = vectors.sparkSession
    greatest = F.array_max(F.transform("vector", lambda v: F.abs(v)))
    found = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("w"), F.coalesce(F.max(greatest), F.lit(0)).alias("m")).first()
    n_queries = queries.count()
    if not found["n"] or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width or 1, found["w"] or 1)
    kind = next(t for t, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if found["m"] < top)
    length = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    bands, blocks = -(-found["n"] // BAND), -(-n_queries // QUERY_BLOCK)
    # the row's own number parts rows that repeat a length and a vec_id
    order = [F.desc("length"), F.asc("vec_id"), F.asc("row")]
    numbered = lambda df: df.select("vec_id", "vector", length.alias("length"), F.monotonically_increasing_id().alias("row"))
    bands_of = checkpointed(_packed(numbered(vectors).repartitionByRange(bands, *order), "band", width, kind))
    blocks_of = checkpointed(_packed(numbered(queries).repartitionByRange(blocks, *order), "block", width, kind).drop("longest"))
    bands = bands_of.agg(F.max("band")).first()[0] + 1
    exact = np.float64 if found["m"] ** 2 * width < 1 << 53 else np.int64
    scan = _scan(_rotation(vectors, width), min(HEAD, width), k, width, kind, exact)

    ranked = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "block long, at long, query_id long, vec_id long, score long, n int")
    begin, end = 0, 1
    while begin < bands:
        bounded = checkpointed(_bounded(blocks_of, best, k))
        some = bands_of.filter(F.col("band").between(begin, end - 1))
        pairs = checkpointed(_in_reach(some.select("band", "longest"), bounded.select("block", "reach")))
        chosen = broadcast_if_small(pairs, BROADCAST_PAIRS)
        named = lambda: chosen.select(F.col("band").alias("band"), F.col("block").alias("block"))  # noqa: E731  columns of its own for each side
        left, right = some.join(named(), "band"), bounded.join(named(), "block")
        fields = "block long, at long, query_id long, vec_id long, score long"
        scanned = left.groupBy("block", "band").cogroup(right.groupBy("block", "band")).applyInPandas(scan, fields)
        every = best.drop("n").unionByName(scanned).withColumn("n", F.row_number().over(ranked))
        best = checkpointed(every.filter(F.col("n") <= k))
        begin, end = end, min(bands, end * (1 + GROWTH))
    # queries that repeat a vec_id share a list
    of_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = best.withColumn("rank", F.row_number().over(of_id)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op5_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every vector whose vec_id is divisible by 50."""
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    vectors = checkpointed(vectors)
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def oracle() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
