"""A vector index: coarse centroids, inverted lists of int8 codes, probes, exact scores for what remains.

Each list holds its vectors' codes and how far each vector lies from its code, so a score by
codes is an interval around the true cosine.  A query reads the lists of its nearest
centroids; of the vectors there only those stay whose interval reaches the k-th best, and
these are scored in full.  In exact mode a second round reads each list whose widest
angle from its centroid lets it hold a better vector; it answers like a scan of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.tables import cut

#: Most lists of an index; rows of the sample for each list that centroids are fitted on, and rounds of that.
LISTS, SAMPLE_A_LIST, ROUNDS = 4096, 64, 8
#: Vectors of a part of a list and queries of a block: what one task scores against each other.
PART_ROWS, QUERY_BLOCK = 8192, 2048
#: Queries of the sample that tells how many lists must be read to find this share of their nearest rows.
CALIBRATE, RECALL = 100, 0.95
#: Distances are rounded to six places; intervals are widened by this for it.
SLACK = 2e-6


def finite(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is there and holds finite components only."""
    return vectors.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, zeros after the end of shorter vectors, and which rows have no length."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.asarray(column.flatten(), np.float64)
    x = np.zeros((len(column), width))
    inside = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = inside < width
    x[np.repeat(np.arange(len(column)), sizes)[fits], inside[fits]] = values[fits]
    length = np.sqrt((x * x).sum(1))
    return x / np.maximum(length, 1e-300)[:, None], length == 0


def _fit(sample: DataFrame, lists: int, width: int) -> np.ndarray:
    """Spherical k-means over the sample; only sums of ``lists`` rows come to the driver in each round."""
    first = sample.orderBy(F.xxhash64("row", F.lit(1)), "row").limit(lists).select("embedding").toArrow()
    column = first.column("embedding").combine_chunks()
    centres, _ = _units(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, width)
    context = sample.sparkSession.sparkContext
    for _ in range(ROUNDS):
        held = context.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(held.value)
            for batch in batches:
                x, _ = _units(batch.column(0), width)
                np.add.at(total, (x @ held.value.T).argmax(1), x)
            cells = np.flatnonzero(total)
            yield pa.record_batch([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

        total = np.zeros_like(centres)
        for cell, value in sample.select("embedding").mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value")).toLocalIterator():
            total.ravel()[cell] = value
        length = np.sqrt((total * total).sum(1, keepdims=True))
        centres = np.where(length > 0, total / np.maximum(length, 1e-300), centres)
    return centres


def build(vectors: DataFrame, path: str, lists: int | None = None) -> None:
    """Write the index of (vec_id, embedding) below ``path``.

    ``lists``: the root of the number of rows unless given, LISTS at most.  Centroids are
    fitted on SAMPLE_A_LIST * lists rows at most, drawn by a hash; every row is indexed.  A list
    of any size is dealt over parts.  Null and non-finite vectors are left out; those of no
    length lie at distance 0 of everything and are kept apart; repeated rows stay.
    """
    spark = vectors.sparkSession
    rows = finite(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")))
    rows.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors")
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    empty = F.forall("embedding", lambda v: v == 0)
    rows.filter(empty).select("row", "vec_id").write.mode("overwrite").parquet(f"{path}/zeros")
    rows, width = rows.filter(~empty), told["width"] or 1
    lists = min(LISTS, max(1, lists or int(told["n"] ** 0.5)))
    share = min(1.0, 1.2 * SAMPLE_A_LIST * lists / max(1, told["n"]))
    drawn = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share * float(1 << 30)).orderBy(F.xxhash64("row"), "row").limit(SAMPLE_A_LIST * lists)
    centres = _fit(cut(drawn), lists, width)
    held = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _units(batch.column(1), width)
            near = x @ held.value.T
            scale = np.abs(x).max(1) / 127
            codes = np.rint(x / scale[:, None]).astype(np.int8)
            away = x - codes * scale.astype(np.float32)[:, None].astype(float)
            # rounded up: the true distance is never more
            rest = np.nextafter((np.sqrt((away * away).sum(1)) + 1e-9).astype(np.float32), np.float32(np.inf))
            columns = [batch.column(0), pa.array(near.argmax(1)), pa.array(near.max(1)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(rest)]
            yield pa.record_batch(columns, ["row", "list", "near", "code", "scale", "rest"])

    assigned = cut(rows.select("row", "embedding").mapInArrow(assign, "row long, list long, near double, code binary, scale float, rest float"))
    sizes = assigned.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"), F.min("near").alias("least"))
    sizes = cut(sizes)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = {c: [pdf[c].to_numpy(t).tobytes()] for c, t in (("row", np.int64), ("scale", np.float32), ("rest", np.float32))}
        return pd.DataFrame({"list": [key[0]], "part": [key[1]], **whole, "code": [b"".join(pdf["code"])]})

    dealt = assigned.join(F.broadcast(sizes.select("list", "parts")), "list")  # LISTS rows at most
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    dealt.groupBy("list", "part").applyInPandas(pack, "list long, part long, row binary, scale binary, rest binary, code binary").write.mode("overwrite").parquet(f"{path}/lists")
    fields = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list long, centre array<double>")
    fields.join(sizes, "list").write.mode("overwrite").parquet(f"{path}/centres")
    probes = _probes(spark, path, assigned.select("row", "list"))
    spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{path}/told")


def _probes(spark: SparkSession, path: str, assigned: DataFrame, k: int = 10) -> int:
    """How many lists, nearest centroid first, hold RECALL of the k nearest rows of CALIBRATE of the indexed vectors."""
    some = spark.read.parquet(f"{path}/vectors").orderBy(F.xxhash64("row", F.lit(2)), "row").limit(CALIBRATE)
    some = cut(some.filter(F.exists("embedding", lambda v: v != 0)).select(F.col("row").alias("vec_id"), "embedding"))
    truth = search(spark, path, some, k, probes=1, exact=True, rows=True).join(assigned, "row")
    truth, own = truth.select("query_id", "list").toPandas(), some.toArrow()  # k * CALIBRATE and CALIBRATE rows
    if not len(truth):
        return 1
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").toPandas()
    middle, column = np.array(centres["centre"].tolist()), own.column("embedding").combine_chunks()
    x, _ = _units(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, middle.shape[1])
    place = np.argsort(np.argsort(-(x @ middle.T), axis=1, kind="stable"), axis=1, kind="stable")
    query = {q: i for i, q in enumerate(own.column("vec_id").to_pylist())}
    at = {name: i for i, name in enumerate(centres["list"])}
    needed = np.sort([place[query[q], at[name]] for q, name in zip(truth["query_id"], truth["list"], strict=True)])
    return int(needed[max(0, int(np.ceil(RECALL * len(needed))) - 1)]) + 1


def _scored(asked: DataFrame, path: str, k: int, width: int) -> DataFrame:
    """(query, row, low, high) of the rows of each asked list (list, query, embedding) that may be among a query's k best of it."""
    spark = asked.sparkSession
    asked = cut(asked)
    parts = F.broadcast(spark.read.parquet(f"{path}/centres").select("list", "parts"))  # LISTS rows at most
    blocks = cut(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks")))
    blocked = asked.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("query"), "blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, _ = _units(pa.array(pdf["embedding"], pa.list_(pa.float32())), width)
        return pd.DataFrame({"list": [key[0]], "block": [key[1]], "query": [pdf["query"].to_numpy(np.int64).tobytes()], "data": [x.tobytes()]})

    def scan(key: tuple, some: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = {"query": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "low": np.zeros(0), "high": np.zeros(0)}
        if not len(some) or not len(asking):
            return pd.DataFrame(out)
        some, asking = some.iloc[0], asking.iloc[0]
        row, own = np.frombuffer(some["row"], np.int64), np.frombuffer(asking["query"], np.int64)
        scale, rest = (np.frombuffer(some[c], np.float32).astype(float) for c in ("scale", "rest"))
        x = np.frombuffer(some["code"], np.int8).reshape(len(row), width).astype(float) * scale[:, None]
        q = np.frombuffer(asking["data"]).reshape(len(own), width)
        found = []
        for at in range(0, len(q), 256):
            score = q[at : at + 256] @ x.T
            low, high = score - rest - SLACK, score + rest + SLACK
            bound = np.partition(low, -k, axis=1)[:, -k] if len(row) > k else np.full(len(low), -np.inf)
            i, j = np.nonzero(high >= bound[:, None])
            found.append((own[at + i], row[j], low[i, j], high[i, j]))
        return pd.DataFrame(dict(zip(out, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    packed = cut(blocked.groupBy("list", "block").applyInPandas(pack, "list long, block long, query binary, data binary"))
    left = spark.read.parquet(f"{path}/lists").join(F.broadcast(blocks), "list").withColumn("block", every("blocks"))
    right = packed.join(parts, "list").withColumn("part", every("parts"))
    key = ["list", "part", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scan, "query long, row long, low double, high double")


def _reaching(scored: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose interval reaches their query's k-th best lower end, and these ends (query, bound)."""
    w = Window.partitionBy("query").orderBy(F.desc("low"), "row")
    best = scored.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k)
    bounds = cut(best.select("query", F.col("low").alias("bound")))
    near = scored.join(bounds, "query", "left").filter(F.col("bound").isNull() | (F.col("high") >= F.col("bound")))
    return near.drop("bound"), bounds


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, rows: bool = False) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest rows of the index for each row of (vec_id, embedding); none is its own neighbour.

    Reads the ``probes`` lists of the nearest centroids (as many as the build's sample needed, unless given),
    and in exact mode whatever other list may hold a nearer vector; ``rows`` adds the index's own row numbers.  Ties go by vec_id.  Null and non-finite queries have no
    neighbours; one without a vec_id asks as if it were no row of the index; a query of no length is at distance 0 of everything, as are vectors of no length.
    """
    from corpusloom.operators.retrieval import cosine_distance

    centres = spark.read.parquet(f"{path}/centres").orderBy("list").toPandas()  # LISTS rows at most
    probes = probes or (1 if exact else spark.read.parquet(f"{path}/told").first()["probes"])
    stored = spark.read.parquet(f"{path}/vectors")
    asked = finite(queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")))
    asked = cut(asked.withColumn("query", F.monotonically_increasing_id()))
    none = F.forall("embedding", lambda v: v == 0)
    asking, near, spare = asked.filter(~none), None, k + 1  # one more: a query may be among its own
    if len(centres):
        middle, names = np.array(centres["centre"].tolist()), centres["list"].to_numpy(np.int64)
        width, angle = middle.shape[1], np.arccos(np.clip(centres["least"].to_numpy(float), -1, 1))
        held = spark.sparkContext.broadcast((middle, names, angle))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Lists of a batch of (query, embedding, bound): the nearest without a bound, else all others that reach it."""
            middle, names, angle = held.value
            for batch in batches:
                x, _ = _units(batch.column(1), width)
                close = x @ middle.T
                first = np.zeros(close.shape, bool)
                np.put_along_axis(first, np.argsort(-close, axis=1, kind="stable")[:, :probes], True, axis=1)
                if batch.column(2).null_count < batch.num_rows:
                    bound = np.array(batch.column(2).to_pylist(), float)[:, None]
                    reach = np.cos(np.maximum(0, np.arccos(np.clip(close, -1, 1)) - angle - 1e-7))
                    first = ~first & (reach + SLACK >= bound)
                i, j = np.nonzero(first)
                at = pa.array(i)
                yield pa.record_batch([pa.array(names[j]), batch.column(0).take(at), batch.column(1).take(at)], ["list", "query", "embedding"])

        fields = "list long, query long, embedding array<float>"
        bare = asking.select("query", "embedding", F.lit(None).cast("double").alias("bound"))
        near, bounds = _reaching(cut(_scored(bare.mapInArrow(chosen, fields), path, spare, width)), spare)
        if exact:
            open_ = asking.join(bounds, "query", "left").select("query", "embedding", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
            more = _scored(open_.mapInArrow(chosen, fields), path, spare, width)
            near, _ = _reaching(cut(near.unionByName(more)), spare)
    pairs = None if near is None else near.select("query", "row")
    zeros = spark.read.parquet(f"{path}/zeros").orderBy("vec_id", "row").limit(spare).collect()  # as many as a query can use
    if zeros:
        every = asking.select("query", F.explode(F.array(*[F.lit(z["row"]) for z in zeros])).alias("row"))
        pairs = every if pairs is None else pairs.unionByName(every)
    if not asked.filter(none).isEmpty():
        least = stored.orderBy("vec_id", "row").limit(spare).select("row").collect()
        every = asked.filter(none).select("query", F.explode(F.array(*[F.lit(z["row"]) for z in least])).alias("row"))
        pairs = every if pairs is None else pairs.unionByName(every)
    if pairs is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double" + (", row long" if rows else ""))
    full = pairs.join(stored.select("row", "vec_id", F.col("embedding").alias("own")), "row").join(asked, "query").filter("query_id IS NULL OR vec_id <> query_id")
    full = full.select("query_id", "query", "vec_id", "row", F.round(cosine_distance(F.col("own"), F.col("embedding")), 6).alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", "vec_id", "row")
    ranked = full.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance", *(["row"] if rows else []))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's true rows, or of rows as near, that were found; both as ``search`` gives them."""
    far = truth.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    hits = found.join(far, "query_id").filter(F.col("distance") <= F.col("far")).groupBy("query_id").agg(F.count("*").alias("hits"))
    return far.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
