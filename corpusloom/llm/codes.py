"""Compression of vectors into codes: product codebooks, nearest entries by broadcast kd-trees.

Vectors become integers and are cut into equal parts.  In each round the trees of all
codebooks are broadcast, tasks look up every part's nearest entry by branch and bound and
add up the parts of each entry as integers; the sums of all tasks give the new entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf; vectors that a task looks up together.
LEAF, BLOCK = 8, 16_384
#: Integers beyond this magnitude (components beyond half a million) are set to it, so that all sums stay exact in 64 bits.
LARGEST = 1 << 27
#: Labels up to so many are broadcast with their errors.
BROADCAST_LABELS = 500_000


class Tree:
    """A kd-tree over the entries of one codebook: bounding boxes, halves by the widest axis."""

    def __init__(self, entries: np.ndarray, places: np.ndarray | None = None):
        places = np.arange(len(entries)) if places is None else places
        self.places, self.entries, own = places, entries[places], entries[places]
        self.low, self.high, self.halves = own.min(0), own.max(0), ()
        wide = self.high - self.low
        if len(places) > LEAF and wide.size and wide.max() > 0:
            order = places[np.argsort(own[:, wide.argmax()], kind="stable")]
            self.halves = tuple(Tree(entries, np.sort(half)) for half in np.array_split(order, 2))

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Least squared distance from each row of ``x`` to the box."""
        away = np.maximum(self.low - x, 0) + np.maximum(x - self.high, 0)
        return np.einsum("ij,ij->i", away, away)

    def search(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Lower ``best`` and ``at`` of ``rows``.  A box at exactly the best distance is entered: an entry in it may tie with a lower index."""
        if not self.halves:
            for place, entry in zip(self.places, self.entries, strict=True):
                away = x[rows] - entry
                d = np.einsum("ij,ij->i", away, away)
                won = (d < best[rows]) | ((d == best[rows]) & (place < at[rows]))
                best[rows[won]], at[rows[won]] = d[won], place
            return
        bounds = [half.bound(x[rows]) for half in self.halves]
        left_first = bounds[0] <= bounds[1]
        for group, order in ((left_first, (0, 1)), (~left_first, (1, 0))):
            for i in order:
                near = group & (bounds[i] <= best[rows])
                if near.any():
                    self.halves[i].search(x, rows[near], best, at)


def nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, lowest of ties, and its squared distance."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
    tree.search(x, np.arange(len(x)), best, at)
    return at, best


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column as rows of ``width``, zeros after the end of shorter vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return np.clip(np.floor(out * scale), -LARGEST, LARGEST).astype(np.int64)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows whose vector is not null and holds no null and no non-finite component."""
    x = F.col("embedding")
    return embeddings.filter(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _parts(block: pa.Table, width: int, parts: int) -> np.ndarray:
    column = block.column("embedding").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return integers(column, width).reshape(block.num_rows, parts, width // parts)


def codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, component): the ``entries`` rows of smallest vec_id, moved to the floor of their parts' means in each round.

    Only the first entries and, for each round, parts * entries sums come to the driver.
    """
    first = rows.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    books = np.ascontiguousarray(_parts(first, width, parts).transpose(1, 0, 2))
    step = width // parts + 1  # a count beside the sums of each entry
    for _ in range(rounds):
        trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], trees=trees, n=books.shape[1]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, n, step), np.int64)
            for block in _blocks(batches):
                x = _parts(block, width, parts)
                for p in range(parts):
                    at, _ = nearest(trees.value[p], x[:, p])
                    total[p, :, 0] += np.bincount(at, minlength=n)
                    np.add.at(total[p, :, 1:], at, x[:, p])
            cells = np.flatnonzero(total)
            yield pa.record_batch([pa.array(cells), pa.array(total.ravel()[cells])], ["cell", "value"])

        total = np.zeros(books.shape[:2] + (step,), np.int64)
        found = rows.select("embedding").mapInArrow(sums, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value"))
        for cell, value in found.toLocalIterator():  # parts * entries * step rows
            total.ravel()[cell] = value
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` without their embedding but with ``code``, two hex digits a part, and ``error``, the squared distance to what the code stands for."""
    parts, _, sub = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    keep = [c for c in rows.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = _parts(block, parts * sub, parts)
            found = [nearest(trees.value[p], x[:, p]) for p in range(parts)]
            marks = np.stack([at for at, _ in found], 1).astype(np.uint8).tobytes().hex()
            code = [marks[i : i + 2 * parts] for i in range(0, len(marks), 2 * parts)]
            error = np.sum([d for _, d in found], 0)
            columns = [*(block.column(c) for c in keep), pa.array(code, pa.string()), pa.array(error)]
            yield from pa.table(columns, [*keep, "code", "error"]).to_batches()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{types}, code string, error long")


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray] | None:
    """Codes of all usable rows, in place of their vectors, and the codebooks; None without a usable row.

    Vectors shorter than the longest, or than the next multiple of ``parts``, count as if zeros
    followed; repeated rows and ids each have a code; rows without a vec_id are the last choice
    as first entries; with fewer rows than ``entries`` a codebook has as many entries as rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    rows = usable(embeddings)
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return None
    width = -(-width // parts) * parts
    books = codebooks(rows, width, parts, entries, rounds)
    return encoded(rows, books), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable embedding, the error of its label and a digest of the codebooks.

    Null vectors and vectors with a null or non-finite component are dropped; empty ones are
    zeros; see ``compressed`` for ties, repeated rows and mixed lengths.  No usable row, no result rows.
    """
    found = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows, books = found
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = rows.join(broadcast_if_small(sums, BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle() -> str:
    """The same for 64 components, that is parts of four."""
    distance = " + ".join(f"(x.x[{i}] - c.x[{i}]) * (x.x[{i}] - c.x[{i}])" for i in range(1, 5))
    ctes = []
    for r in range(ROUNDS + 1):
        ctes.append(f"""a{r} AS (SELECT x.p, x.row, any_value(x.x) AS x, min(({distance}) * 64 + c.e) AS best FROM x JOIN c{r} c USING (p) GROUP BY x.p, x.row)""")
        if r < ROUNDS:
            mean = ", ".join(f"CAST(floor(CAST(sum(x[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, 5))
            ctes.append(f"""m{r} AS (SELECT p, best % 64 AS e, [{mean}] AS x FROM a{r} GROUP BY ALL),
c{r + 1} AS (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, e))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, p, v[4 * p + 1:4 * p + 4] AS x FROM v, range(16) t(p)),
c0 AS (SELECT p, row AS e, x FROM x WHERE row < 64),
{f",{chr(10)}".join(ctes)},
f AS (SELECT row, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN v USING (row), h"""
