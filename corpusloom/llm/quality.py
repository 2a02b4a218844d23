"""Quality classifier: support vectors over naive-Bayes-scaled n-gram indicators.

Indicators of hashed byte n-grams are scaled by the log-ratio of their counts in
the two classes; a linear hinge-loss model is fitted to the scaled vectors by dual
coordinate descent, and its margins are calibrated to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import broadcast_if_small, checkpointed, id_crc_mod, slices, table, text_key, texts_to_python
from corpusloom.llm.grams import codes_of, hashed

BITS, SIZES = 16, (1, 2, 3, 4)
#: Bound of the sample of distinct labelled texts that the support vectors are fitted on.
SAMPLE = 16_000
#: Cells (two bytes each) of all texts of the sample together: what the fitting task holds, however long texts are.
SAMPLE_CELLS = 96_000_000
#: One in so many sampled rows calibrates the margins instead.
CALIBRATE = 4
COST, ROUNDS, SMOOTHING = 1.0, 12, 1.0
#: Labels up to so many rows (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Shares of words that repeat the word before; each reached one is an indicator too.
REPEATS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)


def indicators(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """The n-gram cells of a text in ascending order; none for a null or empty text.

    Besides byte n-grams: bigrams of a word with itself, by their share of the words.
    ``scratch`` is a zeroed bool array of 2 ** BITS, left zeroed.
    """
    if not text:
        return np.zeros(0, np.uint16)
    for h in hashed(codes_of(text), SIZES, BITS):
        scratch[h] = True
    words = text.split()
    if len(words) > 1:
        share = sum(map(str.__eq__, words, words[1:])) / (len(words) - 1)
        for i, least in enumerate(REPEATS):
            if share >= least:
                scratch[i * 7919 + 11] = True
    cells = np.flatnonzero(scratch)
    scratch[cells] = False
    return cells.astype(np.uint16)


@dataclass(frozen=True)
class Model:
    """Score: sigmoid(slope * margin + offset), margin = (ratio * weight)[cells] / |ratio[cells]| + bias."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, cells: np.ndarray) -> float:
        r = self.ratio[cells]
        return float(r @ self.weight[cells]) / max(float(np.sqrt(r @ r)), 1e-9) + self.bias

    def score(self, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(cells) + self.offset, -40, 40))))


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over unit-length scaled indicators."""
    weight, bias = np.zeros(len(ratio)), 0.0
    inverse = [1 / max(float(np.sqrt(ratio[c] @ ratio[c])), 1e-9) for c in rows]
    alpha, signs = np.zeros(len(rows)), np.where(labels == 1, 1.0, -1.0)
    # both classes weigh the same in sum, so a rare one is not drowned
    cost = COST * len(rows) / 2 / np.where(labels == 1, max(1, (labels == 1).sum()), max(1, (labels != 1).sum()))
    order, rng = np.arange(len(rows)), np.random.default_rng(7)
    for _ in range(ROUNDS):
        rng.shuffle(order)
        for i in order:
            c = rows[i]
            x = ratio[c] * inverse[i]
            gradient = signs[i] * (x @ weight[c] + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), cost[i])
            if step := (new - alpha[i]) * signs[i]:
                alpha[i] = new
                weight[c] += step * x
                bias += step
    return weight, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid by Newton's method on smoothed targets."""
    up, down = (labels == 1).sum(), (labels != 1).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margins**2).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * margins).sum(), g.sum()])
        step *= min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(labelled: DataFrame) -> Model | float:
    """Learn from (text, quality); a constant score where only one class is known, 0.5 where none is.

    Counts cover all rows; the support vectors take SAMPLE distinct texts at most, picked
    by a hash of the text, in one task.  Counts and weights (a fixed number of
    cells) come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, scratch = np.zeros((2, 1 << BITS), np.int64), [0, 0], np.zeros(1 << BITS, bool)
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True):
                seen[label][indicators(text, scratch)] += 1
                rows[label] += 1
        for label in (0, 1):
            cells = np.flatnonzero(seen[label])
            cell, n = np.append(cells, -1), np.append(seen[label][cells], rows[label])
            yield pa.record_batch([pa.array(np.full(len(cell), label)), pa.array(cell), pa.array(n)], ["label", "cell", "n"])

    counts = texts_to_python(labelled).select("text", "quality").mapInArrow(count, "label long, cell long, n long")
    counts = counts.groupBy("label", "cell").agg(F.sum("n").alias("n")).toPandas()  # two rows for a cell at most
    by_class = np.full((2, 1 << BITS), SMOOTHING)
    inner = counts[counts["cell"] >= 0]
    by_class[inner["label"], inner["cell"]] += inner["n"]
    rows = {label: int(counts.loc[(counts["cell"] < 0) & (counts["label"] == label), "n"].sum()) for label in (0, 1)}
    if not rows[0] or not rows[1]:
        return (rows[1] + 1) / (rows[0] + rows[1] + 2)
    shares = by_class / by_class.sum(1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, bool)
        for batch in slices(batches, "text"):
            cells = [indicators(t, scratch).tobytes() for t in batch.column("text").to_pylist()]
            known = [batch.column(batch.schema.get_field_index(c)) for c in ("quality", "key1", "key2")]
            yield pa.record_batch([*known, pa.array(cells, pa.binary())], ["quality", "key1", "key2", "cells"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, labels = [], []
        for batch in batches:
            cells += [np.frombuffer(c, np.uint16) for c in batch.column("cells").to_pylist()]
            labels += batch.column("quality").to_pylist()
        labels, apart = np.array(labels), np.arange(len(labels)) % CALIBRATE == 0
        if len(set(labels[apart])) < 2 or len(set(labels[~apart])) < 2:
            apart = np.zeros(len(labels), bool)
        weight, bias = dual_coordinate_descent([c for c, x in zip(cells, apart, strict=True) if not x], labels[~apart], ratio)
        check = apart if apart.any() else ~apart
        plain = Model(ratio, weight, bias, 1.0, 0.0)
        slope, offset = calibrate(np.array([plain.margin(c) for c, x in zip(cells, check, strict=True) if x]), labels[check])
        yield pa.record_batch([pa.array([weight.tobytes()]), pa.array([[bias, slope, offset]])], ["weight", "rest"])

    # distinct (label, text) by a hash of the text: neither null or repeated ids nor copies can exceed the bound
    share = min(1.0, SAMPLE / (rows[0] + rows[1]))
    key = ["quality", "key1", "key2"]
    keyed = labelled.select("quality", *text_key("text"), "text")
    drawn = F.xxhash64("key2", "key1", "quality")
    keys = keyed.filter(F.pmod(drawn, F.lit(1 << 30)) < share * float(1 << 30)).select(*key).distinct()
    keys = checkpointed(keys.orderBy(drawn, *key).limit(SAMPLE))
    sample = texts_to_python(keyed.join(broadcast_if_small(keys, SAMPLE), key, "left_semi")).mapInArrow(pack, "quality long, key1 long, key2 long, cells binary")
    # one task on a bounded sample, in an order of its own so that the fit is the same each time
    packed = checkpointed(sample.dropDuplicates(key))
    # SAMPLE rows of key and size: from the first on in the order of the draw, as long as their cells fit
    upto = Window.orderBy(drawn, *key).rowsBetween(Window.unboundedPreceding, 0)
    fits = packed.select(*key, F.sum(F.octet_length("cells") / 2).over(upto).alias("sum")).filter(F.col("sum") <= SAMPLE_CELLS).drop("sum")
    one = packed.join(broadcast_if_small(fits, SAMPLE), key, "left_semi").repartition(1).sortWithinPartitions(F.xxhash64("key2", "key1", "quality"), *key).select("quality", "cells")
    found = one.mapInArrow(train, "weight binary, rest array<double>").first()
    return Model(ratio, np.frombuffer(found["weight"], np.float64), *found["rest"])


def scored(docs: DataFrame, model: Model | float, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of every whole text.

    A null or empty text has no n-grams and the score of the bias alone.  Repeated
    rows are scored alike; an empty table gives no rows; columns of ``docs`` that aren't
    kept are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch, model = np.zeros(1 << BITS, bool), held.value
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            scores = [model if isinstance(model, float) else model.score(indicators(t, scratch)) for t in texts]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch([*(batch.column(i) for i in rest), pa.array(scores, pa.float64())], [*(batch.schema.names[i] for i in rest), "score"])

    rows = docs.select(*keep, "text")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return texts_to_python(rows).mapInArrow(run, f"{types}, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Score and verdict of every document; labels come from the rows not held out.

    Labels other than 0 and 1 are ignored; of several for one doc_id the least counts.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").filter("quality IN (0, 1)").filter(id_crc_mod("doc_id", 5) != 0)
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("quality"))
    model = fit(docs.join(broadcast_if_small(labels, BROADCAST_LABELS), "doc_id"))
    judged = scored(docs.withColumn("held_out", id_crc_mod("doc_id", 5) == 0), model, ["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
