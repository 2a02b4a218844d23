"""Hybrid retrieval as one plan: legs, fusion, caps and allocation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import keyword_index as ki
from corpusloom.operators import retrieval as rt
from corpusloom.operators import vector_index as vi


def recall_size(question: str, k: int) -> int:  # T10
    """Candidates of a leg: more for longer questions, twice k at least."""
    words = len(question.split())
    return max(20 if words <= 3 else 35 if words <= 8 else 50, 2 * k)


def hybrid(
    chunks: DataFrame,
    files: DataFrame,
    vectors: DataFrame,
    terms: list[str],
    query_vector: list[float],
    k: int = 15,
    per_file: int = 2,
    rerank: Callable[[DataFrame], DataFrame] | None = None,
    keyword_index: str | None = None,
    vector_index: str | None = None,
) -> DataFrame:
    """rank, chunk_id, file_id, score: the best chunks for one question.

    ``rerank`` may add a column ``logit`` to the fused list; without it the fused order
    stands.  The legs give a bounded number of ids, so what follows them is small.  With the
    folder of an index of chunks or vectors that leg is a lookup, exact like the scan.
    """
    n = 2 * k
    alone = F.lit(0).alias("query")
    spark = chunks.sparkSession
    keyword = ki.search(spark, keyword_index, terms, "chunk_id") if keyword_index else rt.bm25(chunks, "text", terms, ["chunk_id"])
    keyword = keyword.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(n)
    if vector_index:
        asked = spark.createDataFrame([(None, [float(x) for x in query_vector])], "vec_id long, embedding array<float>")
        vector = vi.search(spark, vector_index, asked, n, exact=True)
    else:
        vector = rt.nearest(vectors, query_vector, n)
    rank = lambda *by: (F.row_number().over(Window.orderBy(*by)) - 1).alias("rank")  # noqa: E731  over a leg's rows
    legs = {
        "keyword": keyword.select(alone, F.col("chunk_id").cast("string").alias("id"), rank(F.desc("score"), "chunk_id")),
        "vector": vector.select(alone, F.col("vec_id").cast("string").alias("id"), rank("distance", "vec_id")),
    }
    fused = rt.fuse(legs).withColumn("chunk_id", F.col("id").cast("long"))
    found = chunks.select("chunk_id", "file_id").join(F.broadcast(fused), "chunk_id")  # 2 * n ids at most
    found = found.join(files, "file_id")
    order = [F.desc("score"), *rt.id_order("id")]
    if rerank:
        found = rt.rerank_fused(rerank(found.withColumn("pos", F.row_number().over(Window.orderBy(*order)))))
        order = [F.desc("fused"), F.asc("pos")]
    found = found.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    capped = rt.per_file(found, per_file, "file_id")
    return rt.allocate(capped, k, "domain").select(F.col("slot").alias("rank"), "chunk_id", "file_id", "score")


def with_fallback(leg: Callable[[], DataFrame], empty: DataFrame) -> DataFrame:  # R6
    """A leg that can't be planned gives way to an empty one, so that the others still answer."""
    try:
        return leg()
    except Exception:  # noqa: BLE001  any failure of an injected leg
        return empty


def gated_rerank(found: DataFrame, rerank: Callable[[DataFrame], DataFrame]) -> DataFrame:  # R28
    """Reranked rows; one row at most needs no reranking, and a failing model leaves the order, marked."""
    if found.limit(2).count() <= 1:
        return found.withColumn("degraded", F.lit(False))
    try:
        return rerank(found).withColumn("degraded", F.lit(False))
    except Exception:  # noqa: BLE001  any failure of an injected model
        return found.withColumn("degraded", F.lit(True))
