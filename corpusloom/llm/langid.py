"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Document frequencies are counted over all training rows.  Per language a bounded
sample is clustered by spherical k-means into a few centroids.  A text takes the
language of the centroid with the greatest cosine and is rejected where even that
one is farther than the language's own texts of the sample ever are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import broadcast_if_small, checkpointed, id_crc_mod, slices, table, text_key, texts_to_python
from corpusloom.llm.grams import codes_of, hashed

BITS, SIZES = 14, (1, 2, 3, 4)
#: Bound of the sample of distinct texts that a language's centroids are fitted on, and centroids per language.
SAMPLE, CENTROIDS = 1000, 8
#: Shares of so many languages, and as many samples' keys, are broadcast; more are joined by shuffle.
BROADCAST_LANGUAGES = 200
#: A text is rejected below this share of the least cosine of its language's sample; the
#: cosine of a text of fewer bytes is expected to be lower by the root of its length.
REJECT_SHARE, FULL_BYTES = 0.4, 64
UNKNOWN = "und"

#: Bytes of letters in lower case and of non-ASCII characters stay; the rest is a space.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def term_counts(text: str) -> np.ndarray:
    codes = codes_of(text, _LETTERS)
    counts = np.zeros(1 << BITS, np.float32)
    for h in hashed(codes, SIZES, BITS):
        counts += np.bincount(h, minlength=1 << BITS)
    return counts


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF vector; all zero for a text without n-grams."""
    v = np.log1p(term_counts(text)) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


@dataclass(frozen=True)
class Model:
    """``languages`` per row of ``centroids``; ``least``: the cosine below which each rejects."""

    idf: np.ndarray
    languages: tuple[str, ...]
    centroids: np.ndarray
    least: np.ndarray


def _cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from the first row and then the rows farthest from those chosen."""
    chosen = [x.mean(0)]
    for _ in range(min(k, len(x)) - 1):
        near = np.max(x @ np.array(chosen).T, axis=1)
        chosen.append(x[int(near.argmin())])
    centres = np.array(chosen)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        member = (own == np.arange(len(centres))[:, None]).astype(x.dtype)
        sums = member @ x  # no copies of parts of x
        centres = np.where(member.sum(1, keepdims=True) > 0, sums, centres)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def fit(rows: DataFrame) -> Model | None:
    """Learn from the columns text and lang; null when no row has a language and a letter.

    Document frequencies cover all rows; centroids take SAMPLE distinct texts of a language
    at most, picked by a hash of the text.  The counts and the model, of a size fixed by
    the number of languages, are all that comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, langs = np.zeros(1 << BITS, np.int64), {}
        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if has_letter(text):
                    seen += term_counts(text) > 0
                    langs[lang] = langs.get(lang, 0) + 1
        cells = np.flatnonzero(seen)
        lang = pa.array([None] * len(cells) + list(langs), pa.string())
        cell = pa.array([*cells.tolist(), *[-1] * len(langs)], pa.int64())
        n = pa.array([*seen[cells].tolist(), *langs.values()], pa.int64())
        yield pa.record_batch([lang, cell, n], ["lang", "cell", "n"])

    # texts without a letter are neither counted nor drawn, so a language of many such texts has as large a sample as any
    rows = rows.select(F.col("text").cast("string").alias("text"), "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = ["lang", "key1", "key2"]
    counts = texts_to_python(rows).select("text", "lang").mapInArrow(count, "lang string, cell long, n long")
    counts = checkpointed(counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")))
    docs_per_language = counts.filter("cell < 0")
    n_docs = docs_per_language.agg(F.sum("n").alias("n")).first()["n"]
    if not n_docs:
        return None
    idf = np.full(1 << BITS, np.log(1.0 + n_docs) + 1, np.float32)
    for r in counts.filter("cell >= 0").collect():  # 2 ** BITS cells at most
        idf[r["cell"]] = np.log((1.0 + n_docs) / (1.0 + r["n"])) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [vector(t, idf) if has_letter(t) else np.zeros(1 << BITS, np.float32) for t in batch.column("text").to_pylist()]
            cells = [np.flatnonzero(v) for v in found]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in key]
            columns += [pa.array([c.astype(np.uint16).tobytes() for c in cells], pa.binary()), pa.array([v[c].tobytes() for v, c in zip(found, cells, strict=True)], pa.binary())]
            yield pa.record_batch(columns, [*key, "cells", "weights"])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["cells"].str.len() > 0].sort_values(["key2", "key1"])
        if not len(pdf):
            return pd.DataFrame({"lang": pd.Series(dtype="str"), "data": pd.Series(dtype="object"), "least": pd.Series(dtype="float64")})
        x = np.zeros((len(pdf), 1 << BITS), np.float32)
        for i, (cells, weights) in enumerate(zip(pdf["cells"], pdf["weights"], strict=True)):
            x[i, np.frombuffer(cells, np.uint16)] = np.frombuffer(weights, np.float32)
        c = _cluster(x, CENTROIDS)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "data": [v.tobytes() for v in c], "least": float((x @ c.T).max(1).min())})

    # distinct (language, text) by a hash of the text: neither null or repeated ids nor copies can exceed the bound
    shares = docs_per_language.select("lang", F.least(F.lit(1.0), SAMPLE / F.col("n")).alias("share"))
    keyed = rows.select("lang", *text_key("text"), "text").join(broadcast_if_small(shares, BROADCAST_LANGUAGES), "lang")
    drawn = F.xxhash64("key2", "key1")
    keys = keyed.filter(F.pmod(drawn, F.lit(1 << 30)) < F.col("share") * float(1 << 30)).select(*key).distinct()
    first = Window.partitionBy("lang").orderBy(drawn, "key1", "key2")
    keys = checkpointed(keys.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE).drop("n"))
    sample = keyed.join(broadcast_if_small(keys, BROADCAST_LANGUAGES * SAMPLE), key, "left_semi")
    # at most 2 ** BITS cells for a text, whatever its length
    sample = texts_to_python(sample).mapInArrow(vectors, "lang string, key1 long, key2 long, cells binary, weights binary").dropDuplicates(key)
    fitted = sample.groupBy("lang").applyInPandas(centroids, "lang string, data binary, least double")
    fitted = sorted(fitted.collect(), key=lambda r: (r["lang"], bytes(r["data"])))
    if not fitted:
        return None
    return Model(
        idf,
        tuple(r["lang"] for r in fitted),
        np.array([np.frombuffer(r["data"], np.float32) for r in fitted]),
        np.array([r["least"] * REJECT_SHARE for r in fitted], np.float32),
    )


def classify(text: str | None, model: Model | None) -> tuple[str, float, bool]:
    """(language, cosine of its nearest centroid, rejected)."""
    if model is None or not has_letter(text):
        return UNKNOWN, 0.0, True
    near = model.centroids @ vector(text, model.idf)
    best = int(near.argmax())
    limit = model.least[best] * min(1.0, (len(text.encode()) / FULL_BYTES) ** 0.5)
    return model.languages[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < limit)


def predict(docs: DataFrame, model: Model | None, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep`` columns with lang_pred, score and rejected (``prefix`` before each), from whole texts.

    A null text or one without a letter is ``und`` with score 0, and rejected; so is every
    text when nothing could be learned.  Repeated rows are judged alike; an empty table
    gives no rows; columns that aren't kept are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages * centroids * 2 ** BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            found = [classify(t, held.value) for t in batch.column(at).to_pylist()]
            rest = [i for i in range(batch.num_columns) if i != at]
            langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch(
                [*(batch.column(i) for i in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [*(batch.schema.names[i] for i in rest), *(prefix + c for c in ("lang_pred", "score", "rejected"))],
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return texts_to_python(rows).mapInArrow(run, f"{types}, {prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(id_crc_mod("doc_id", 3) != 1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the two thirds that are not held out.

    Texts without a letter, null and empty ones among them, are ``und`` with score 0, whatever
    share of a language they are; see ``predict`` for repeated rows, empty tables and other columns.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs))
    judged = predict(docs.withColumn("held_out", id_crc_mod("doc_id", 3) == 1), model, ["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model learned from them doesn't reject."""
    model = fit(training_rows(docs))
    return predict(docs, model, docs.columns, "__lid_").filter("NOT __lid_rejected").select(*docs.columns)
