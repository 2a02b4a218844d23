"""Ranking: keyword and vector legs, fusion, allocation across domains, context packing."""

from __future__ import annotations

import bisect
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.tables import cut, shared_folder

# Keyword ranking, fusion and allocation constants.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, LEG_WEIGHTS = 60, {"keyword": 0.4, "vector": 0.6, "summary": 0.05}
DOMAIN_SHARE = 0.6
RERANK_K, RERANK_WEIGHT, RERANK_CHARS = 10, 0.5, 2048
#: Queries and vectors that one task scores.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16_384
#: Pairs of a block of queries and a block of vectors that are scanned; for more the vectors are indexed.
MOST_PAIRS = 64


def overlaps_itself(term: str) -> bool:
    """Whether a term can occur again before it ends, as ``aa`` in ``aaa``."""
    return any(term.startswith(term[i:]) for i in range(1, len(term)))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, overlaps included.

    What is missing once the term is taken out tells it, without a pattern; only a term
    that can overlap itself needs one.
    """
    if not overlaps_itself(term):
        return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))) / len(term.encode())).cast("int")
    quoted = "".join(f"\\x{{{ord(c):x}}}" for c in term)
    return F.when(F.contains(text, F.lit(term)), F.regexp_count(text, F.lit(f"(?={quoted})"))).otherwise(0)


def bm25(df: DataFrame, text: str, terms: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` (greater is better) of the rows that hold a term of three characters or more.

    Length counts trigrams; row counts and average length are those of all rows,
    whatever is filtered afterwards.
    """
    total = df.agg(F.count("*").alias("n"), F.avg(F.greatest(F.lit(0), F.length(text) - 2)).alias("avg")).first()
    return bm25_scored(df, text, sorted({t.lower() for t in terms if len(t) >= 3}), keep, total["n"], total["avg"])


def bm25_scored(df: DataFrame, text: str, terms: list[str], keep: list[str], n_rows: int, average: float | None) -> DataFrame:
    """Scores of the rows of ``df`` that hold a term, among ``n_rows`` rows of that average length.

    ``df`` must hold every row with a term.  Terms are counted once; the rows that hold
    one, without their texts, are written and give the terms' document counts and scores.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t))
    counted = df.filter(hit).select(*keep, F.greatest(F.lit(0), F.length(text) - 2).alias("__dl"), *[occurrences(low, t).alias(f"__tf{i}") for i, t in enumerate(terms)])
    counted = cut(counted)
    held = counted.agg(F.count("*"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    norm = (F.col("__dl") / float(average or 1.0)) * (K1 * B) + K1 * (1 - B)
    for i in range(len(terms)):
        df_i = held[f"df{i}"] or 0
        idf = max(LEAST_IDF, math.log((n_rows - df_i + 0.5) / (df_i + 0.5)))
        tf = F.col(f"__tf{i}")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + norm)
    return counted.select(*keep, score.alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 for a vector of no length or with a non-finite component."""
    d = 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.isnan(d) | d.isNull() | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k rows nearest to one query; the filter holds before the top-k."""
    rows = vectors if where is None else vectors.filter(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", F.round(cosine_distance(F.col("embedding"), target), 6)).orderBy("distance", "vec_id").limit(k)


def _in_blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(name, ids, data): blocks of about ``size`` unit vectors each, packed in tasks."""
    parts = max(1, -(-rows.count() // size))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held)
            x = np.array(rows["embedding"].tolist(), float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            yield pd.DataFrame({name: [int(rows[name].iloc[0])], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "data": [x.tobytes()]})

    from corpusloom.operators.vector_index import finite

    ranged = finite(rows.select("vec_id", "embedding")).repartitionByRange(parts, "vec_id").withColumn(name, F.spark_partition_id().cast("long"))
    return cut(ranged.mapInPandas(pack, f"{name} long, ids binary, data binary"))


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, distance for a stated query set against all vectors.

    A query is no neighbour of itself; null and non-finite vectors take no part; one of no length
    is at distance 0 of all.  Up to MOST_PAIRS pairs of blocks each task scores one block of
    queries and one of vectors; beyond, an index is built (and left in the shared folder, as the
    result reads it) whose exact mode reads only the lists that can matter.  Nothing but the
    numbers of the blocks comes to the driver.
    """
    if -(-vectors.count() // VECTOR_BLOCK) * -(-queries.count() // QUERY_BLOCK) > MOST_PAIRS:
        from corpusloom.operators import vector_index

        path = f"{shared_folder(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}"
        vector_index.build(vectors, path)
        return vector_index.search(vectors.sparkSession, path, queries, k, exact=True)
    left, right = _in_blocks(vectors, VECTOR_BLOCK, "band"), _in_blocks(queries, QUERY_BLOCK, "block")
    bands, blocks = ((df.agg(F.max(name)).first()[0] or 0) + 1 for df, name in ((left, "band"), (right, "block")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def scan(key: tuple, some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        fields = ["query_id", "vec_id", "distance"]
        if not len(some) or not len(asked):
            return pd.DataFrame([], columns=fields).astype({"query_id": "int64", "vec_id": "int64", "distance": "float64"})
        v, own = (np.frombuffer(df["ids"].iloc[0], np.int64) for df in (some, asked))
        x, q = (np.frombuffer(df["data"].iloc[0]).reshape(len(ids), -1) for df, ids in ((some, v), (asked, own)))
        out = []
        for at in range(0, len(q), 256):
            d = np.round(1 - q[at : at + 256] @ x.T, 6)
            d[:, ~x.any(1)] = 0.0
            d[~q[at : at + 256].any(1)] = 0.0
            d[own[at : at + 256, None] == v[None, :]] = np.inf
            if len(v) > 4 * k:  # all that tie with the k-th stay for the sort
                d = np.where(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k], d, np.inf)
            order = np.lexsort((np.broadcast_to(v, d.shape), d), axis=1)[:, :k]
            part = pd.DataFrame({"query_id": np.repeat(own[at : at + 256], order.shape[1]), "vec_id": v[order].ravel(), "distance": np.take_along_axis(d, order, 1).ravel()})
            out.append(part[np.isfinite(part["distance"])])
        return pd.concat(out)

    pairs = left.withColumn("block", every(blocks)).groupBy("block", "band").cogroup(right.withColumn("band", every(bands)).groupBy("block", "band"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    scored = pairs.applyInPandas(scan, "query_id long, vec_id long, distance double")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def id_order(name: str) -> list[Column]:
    """Digits as numbers first, then the rest as text."""
    digits = F.col(name).rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, F.col(name).try_cast("decimal(38,0)")), F.col(name)]


def fuse(legs: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] = LEG_WEIGHTS) -> DataFrame:
    """query, id, score: weighted reciprocal ranks (rank from 0) summed over the legs, times 1000, to four places."""
    parts = [df.select("query", "id", (F.lit(weights[leg]) / (k + F.col("rank") + 1)).alias("part")) for leg, df in legs.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("query", "id").agg(F.round(F.sum("part") * 1000, 4).alias("score"))


def allocate(df: DataFrame, k: int, domain: str) -> DataFrame:
    """The k rows of each query that its domains share (columns query, pos).

    Domains take turns in order of first appearance, each up to its share of k; what
    is left over is filled in order of pos.  ``slot`` is the new position, from 1.
    """
    cap = math.ceil(k * DOMAIN_SHARE)
    own = Window.partitionBy("query", domain)
    df = df.withColumn("__r", F.row_number().over(own.orderBy("pos"))).withColumn("__first", F.min("pos").over(own))
    late = (F.col("__r") > cap).cast("int")
    order = Window.partitionBy("query").orderBy(late, F.when(late == 0, F.col("__r")), F.when(late == 0, F.col("__first")), "pos")
    return df.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= k).drop("__r", "__first")


def reallocate_head(df: DataFrame, k: int, domain: str) -> DataFrame:
    """The first k positions allocated anew, the rest as they were."""
    head = allocate(df.filter(F.col("pos") <= k), k, domain)
    return head.unionByName(df.filter(F.col("pos") > k).withColumn("slot", F.col("pos").cast("int")))


def per_file(df: DataFrame, n: int, path: str = "path") -> DataFrame:
    w = Window.partitionBy("query", path).orderBy("pos")
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def rerank_fused(df: DataFrame) -> DataFrame:
    """``fused``: reciprocal ranks of the reranker's order and the first order, half each (columns query, pos, logit)."""
    by_logit = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("logit"), "pos")) - 1
    first = F.row_number().over(Window.partitionBy("query").orderBy("pos")) - 1
    score = RERANK_WEIGHT / (RERANK_K + by_logit + 1) + (1 - RERANK_WEIGHT) / (RERANK_K + first + 1)
    return df.withColumn("fused", F.round(score, 8))


def footprint_prefix(df: DataFrame, budget: int = 60_000, times_k: int = 40) -> DataFrame:
    """The longest prefix (one row at least) whose padded size, rows times the longest text so far, fits.

    The reranker reads RERANK_CHARS characters of a text at most, so a longer one counts as that.
    """
    upto = Window.partitionBy("query").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__n": F.count("*").over(upto), "__w": F.max(F.least(F.length("text"), F.lit(RERANK_CHARS))).over(upto)})
    bad = (F.col("__n") * F.col("__w") > budget) | (F.col("__n") > times_k)
    df = df.withColumn("__bad", F.max((bad & (F.col("__n") > 1)).cast("int")).over(upto))
    return df.filter("__bad = 0").drop("__n", "__w", "__bad")


def without_repeats(df: DataFrame, cap: int = 100) -> DataFrame:
    """Rows whose text, white space levelled, no earlier row of the query has; short texts always stay."""
    from corpusloom.functions.text import squashed

    short = F.length("text") < 50
    name = F.when(short, F.concat(F.lit("row"), F.col("pos").cast("string"))).otherwise(F.sha2(squashed(F.col("text")).cast("binary"), 256))
    df = df.withColumn("__name", name)
    first = F.row_number().over(Window.partitionBy("query", "__name").orderBy("pos"))
    kept = df.withColumn("__r", first).filter("__r = 1").drop("__r", "__name")
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy("pos"))).filter(F.col("__n") <= cap).drop("__n")


def without_overlaps(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Greedy by pos: a span that overlaps a kept one of its path by the share of the shorter is dropped.

    Which rows stay depends on which stayed before.  Spans only clash within a path, so the
    rows of each query and path are streamed in order of pos; only kept spans are held.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans, longest = None, [], 0
        for batch in batches:
            keep = []
            for query, path, a, b in zip(*(batch.column(c).to_pylist() for c in ("query", "path", "start", "end")), strict=True):
                if (query, path) != now:
                    now, spans, longest = (query, path), [], 0
                # kept spans by start: only those that begin within the longest one before can reach this one
                near = spans[bisect.bisect_left(spans, (a - longest, a)) : bisect.bisect_left(spans, (b, b))]
                clash = any(max(0, min(b, d) - max(a, c)) / max(1, min(b - a, d - c)) >= share for c, d in near)
                keep.append(not clash)
                if not clash:
                    bisect.insort(spans, (a, b))
                    longest = max(longest, b - a)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition("query", "path").sortWithinPartitions("query", "path", "pos").mapInArrow(walk, df.schema)


def without_redundancy(df: DataFrame, share: float = 0.7, cap: int = 100) -> DataFrame:
    """One walk of each query's rows by pos (columns query, pos, path, start, end, text): up to ``cap`` rows stay.

    A text under 50 characters always stays and is compared with nothing.  Of the others
    one goes if its text, white space levelled, is that of a kept row of any file, or if
    it shares ``share`` of the shorter span with a kept row of its file.  Rows are
    streamed in order; what is held of a query is the ``cap`` rows kept at most.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, texts, spans = object(), 0, set(), {}
        for batch in batches:
            keep = []
            for query, path, a, b, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("query", "path", "start", "end", "text")), strict=True):
                if query != now:
                    now, kept, texts, spans = query, 0, set(), {}
                text, stays = text or "", kept < cap
                if stays and len(text) >= 50:
                    name, own = " ".join(text.split()), spans.setdefault(path, []) if None not in (path, a, b) else None
                    shared = own is not None and any(min(b, d) > max(a, c) and min(b, d) - max(a, c) >= share * min(b - a, d - c) for c, d in own)
                    stays = name not in texts and not shared
                    if stays:
                        texts.add(name)
                        if own is not None:
                            own.append((a, b))
                kept += stays
                keep.append(stays)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition("query").sortWithinPartitions("query", "pos").mapInArrow(walk, df.schema)


def packed(df: DataFrame, budget: int) -> DataFrame:
    """Snippets of each query cut to a token budget: each takes half of what is left at most, 32 tokens at least.

    Columns query, pos, text; adds ``tokens`` given to each and drops rows that get none.
    While tokens are left every row takes all it needs or 32 at least, so a row is only reached
    if the rows before it need less than the budget at 32 each: ``budget`` rows a query at most.
    No text gives more than ``budget`` tokens, so only that much of it is handed on.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows, left, given = rows.sort_values("pos"), budget, []
        for text in rows["text"]:
            need = max(1, len(text) // 4)
            give = min(need, max(32, left // 2), left)
            given.append(give)
            left -= give
        rows = rows.assign(tokens=given)
        return rows[rows["tokens"] > 0].assign(text=lambda r: [t[: 4 * n] for t, n in zip(r["text"], r["tokens"], strict=True)])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    before = Window.partitionBy("query").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    least = F.least(F.greatest(F.lit(1), F.floor(F.length("text") / 4)), F.lit(32))
    df = df.withColumns({"__least": least, "text": F.substring("text", 1, 4 * budget)})
    reached = df.withColumn("__before", F.coalesce(F.sum("__least").over(before), F.lit(0))).filter(F.col("__before") < budget)
    return reached.drop("__least", "__before").groupBy("query").applyInPandas(fill, f"{fields}, tokens long")


def context_budget(window: Column, cap: Column, question: Column, turns: Column) -> Column:
    """Tokens for context: what the window and the class allow, less fixed costs, 1000 at least."""
    room = F.least(cap, window)
    return F.greatest(F.lit(1000), room - 400 - F.least(F.lit(1000), F.floor(F.length(question) / 4)) - 80 - 400 * turns).cast("long")


def parent_windows(hits: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """hit_id and parent_text: the text around each hit, stitched from its neighbours without repeats.

    The window is ``width`` characters around the middle of the hit.  Neighbours come
    by file and bucket of offsets; each adds what lies beyond the text so far.
    """
    from corpusloom.operators.analytics import overlap_join

    middle = F.floor((F.col("start") + F.col("end")) / 2)
    wanted = hits.select("hit_id", "file_id", F.greatest(F.lit(0), middle - width // 2).alias("s"), (middle + width // 2).alias("e"))
    near = overlap_join(chunks.select("file_id", "start", "end", "text"), wanted, "file_id", 4096)
    before = Window.partitionBy("hit_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.coalesce(F.max("end").over(before), F.col("s")), F.col("s"))
    lead = F.greatest(covered, F.col("start"))
    upto = F.least("end", "e")
    near = near.withColumns({"__lead": lead, "__upto": upto})
    piece = F.substr(F.col("text"), (F.col("__lead") - F.col("start") + 1).cast("int"), F.greatest(F.lit(0), F.col("__upto") - F.col("__lead")).cast("int"))
    pieces = near.filter("__upto > __lead").select("hit_id", F.struct(F.col("start"), piece.alias("t")).alias("p"))
    return pieces.groupBy("hit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("parent_text"))


def merge_evidence(df: DataFrame) -> DataFrame:
    """The best row of each chunk over all rounds; equal scores: the earliest."""
    w = Window.partitionBy("query", "id").orderBy(F.desc("score"), "seq")
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def contradiction(a: Column, b: Column) -> Column:
    """Texts that share over half of the terms of the shorter, of which only one negates."""
    from corpusloom.functions.text import words

    x, y = F.array_distinct(F.filter(words(a), lambda w: F.length(w) > 4)), F.array_distinct(F.filter(words(b), lambda w: F.length(w) > 4))
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.least(F.size(x), F.size(y)))
    negates = lambda t: F.lower(t).rlike(r"\b(?:not|never|no|cannot|false|incorrect|wrong)\b")
    return (share > 0.5) & (negates(a) != negates(b))


# Words of a question that never count as a gap.
GAP_STOP_WORDS = "which where about could would should their there these those because through using under".split()


def knowledge_gaps(question: str, retrieved: DataFrame, corpus: DataFrame, least: int = 3) -> DataFrame:
    """(gap): what the question asks about and the rows found (pos, text, rerank_score) don't cover.

    A word of over four letters is a gap if no retrieved text holds it and fewer than ``least``
    rows of the corpus do.  The whole question is one if nothing was retrieved, or if no
    word is a gap and the best row's rerank score lies below -2.
    """
    spark = corpus.sparkSession
    words = sorted({w for w in re.sub(r"[^a-z0-9\s]", " ", question.lower()).split() if len(w) > 4} - set(GAP_STOP_WORDS))
    low = F.lower(F.coalesce("text", F.lit("")))
    found = retrieved.agg(F.count("*").alias("n"), F.min_by("rerank_score", "pos").alias("best"), *[F.max(F.contains(low, F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)]).first()
    missing = [w for i, w in enumerate(words) if not found[f"w{i}"]] if found["n"] else []
    gaps = [question] if not found["n"] else []
    if missing:
        counts = corpus.agg(*[F.sum(F.contains(low, F.lit(w)).cast("long")).alias(f"w{i}") for i, w in enumerate(missing)]).first()
        gaps = [w for i, w in enumerate(missing) if (counts[f"w{i}"] or 0) < least]
    if not gaps and found["best"] is not None and found["best"] < -2.0:
        gaps = [question]
    return spark.createDataFrame([(g,) for g in gaps], "gap string")
