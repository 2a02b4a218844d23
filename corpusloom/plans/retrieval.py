"""Ranked retrieval over chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.operators import indexes, keyword_index, vector_index
from corpusloom.operators import retrieval as rt
from corpusloom.plans.registry import query
from corpusloom.sources.entities import CHUNKS_SQL, chunks, table, with_views

TERMS = ["tion", "license", "über"]


def _bm25_sql(source: str, key: str) -> str:
    counts = ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)} AS tf{i}" for i, t in enumerate(sorted(TERMS)))
    dfs = ", ".join(f"greatest(1e-6, ln((count(*) - count(*) FILTER (tf{i} > 0) + 0.5) / (count(*) FILTER (tf{i} > 0) + 0.5))) AS idf{i}" for i in range(len(TERMS)))
    score = " + ".join(f"idf{i} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avg_dl))" for i in range(len(TERMS)))
    any_ = " OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))
    return f"""t AS (SELECT {key} AS id, greatest(0, length(text) - 2) AS dl, {counts} FROM {source}),
st AS (SELECT avg(dl) AS avg_dl, {dfs} FROM t),
kw AS (SELECT id, round({score}, 6) AS score FROM t, st WHERE {any_})"""


@query("bm25_topk", f"WITH {_bm25_sql('documents', 'doc_id')} SELECT id AS doc_id, score FROM kw ORDER BY score DESC, id LIMIT 40")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:  # R1, R2, T1
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rt.bm25(docs, "text", TERMS, ["doc_id"]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(40)


def _vector_of(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    row = table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()
    return list(row["embedding"]) if row else [1.0]


_DIST = "round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(
    "cosine_topk",
    f"SELECT e.vec_id, e.label, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.label <> 4 ORDER BY distance, e.vec_id LIMIT 30",
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:  # R3, T2, F2, X25
    return rt.nearest(table(spark, d, "embeddings"), _vector_of(spark, d, 3), 30, F.col("label") != 4).select("vec_id", "label", "distance")


_NEAREST_SQL = f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10"""


@query("cosine_topk_batch", _NEAREST_SQL)
def cosine_topk_batch(spark: SparkSession, d: str) -> DataFrame:  # J17, T3
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rt.nearest_of_each(v, v.filter("vec_id % 50 = 0"), 10).select("query_id", "rank", "vec_id", "distance")


@query(
    "semantic_cache",
    f"""SELECT vec_id, distance FROM (SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
  WHERE e.label = (SELECT label FROM embeddings WHERE vec_id = 3) ORDER BY distance, e.vec_id LIMIT 1) WHERE distance < 0.03""",
)
def semantic_cache(spark: SparkSession, d: str) -> DataFrame:  # R21, T9
    e = table(spark, d, "embeddings")
    scope = e.filter("vec_id = 3").select("label")
    rows = e.join(F.broadcast(scope), "label")  # one row
    return rt.nearest(rows, _vector_of(spark, d, 3), 1).filter("distance < 0.03").select("vec_id", "distance")


_LEGS = """k AS (SELECT doc_id // 25 AS query, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY doc_id // 25 ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents),
v AS (SELECT doc_id // 25 AS query, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY doc_id // 25 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents),
s AS (SELECT doc_id // 25 AS query, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id * 7919 % 1009, doc_id) - 1 AS rank FROM documents),
fused AS (SELECT query, id, round(sum(p) * 1000, 4) AS score FROM (
  SELECT query, id, 0.4 / (61 + rank) AS p FROM k WHERE rank < 20 UNION ALL SELECT query, id, 0.6 / (61 + rank) FROM v WHERE rank < 20 UNION ALL SELECT query, id, 0.05 / (61 + rank) FROM s WHERE rank < 20) GROUP BY query, id)"""


def _legs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    q, i = F.floor(F.col("doc_id") / 25).alias("query"), F.col("doc_id").cast("string").alias("id")
    w = Window.partitionBy(F.floor(F.col("doc_id") / 25))
    leg = lambda *by: docs.select(q, i, (F.row_number().over(w.orderBy(*by, "doc_id")) - 1).alias("rank"))
    vector = leg(F.md5(F.col("doc_id").cast("string").cast("binary")))
    return {
        "keyword": leg(F.desc("n_chars")).filter("rank < 20"),
        "vector": vector.filter("rank < 20"),
        "summary": leg(F.col("doc_id") * 7919 % 1009).filter("rank < 20"),
    }


@query("rrf_fuse", f"WITH {_LEGS} SELECT query, id, score FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:  # R5, W1
    return rt.fuse(_legs(spark, d))


@query(
    "fused_order",
    f"""WITH {_LEGS} SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, CAST(id AS BIGINT)) AS INTEGER) AS pos FROM fused""",
)
def fused_order(spark: SparkSession, d: str) -> DataFrame:  # W12
    w = Window.partitionBy("query").orderBy(F.desc("score"), *rt.id_order("id"))
    return rt.fuse(_legs(spark, d)).select("query", "id", F.row_number().over(w).alias("pos"))


_RANKED = """r AS (SELECT doc_id // 100 AS query, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id % 7 = 0 THEN 'b' ELSE source END AS dom, source, text,
  row_number() OVER (PARTITION BY doc_id // 100 ORDER BY n_chars DESC, doc_id) AS pos FROM documents)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    dom = F.when(n % 3 == 0, "a").when(n % 7 == 0, "b").otherwise(F.col("source"))
    w = Window.partitionBy(F.floor(n / 100)).orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select(F.floor(n / 100).alias("query"), "doc_id", dom.alias("dom"), "source", "text", F.row_number().over(w).alias("pos"))


@query(
    "domain_allocate",
    f"""WITH {_RANKED}, a AS (SELECT *, row_number() OVER (PARTITION BY query, dom ORDER BY pos) AS rr, min(pos) OVER (PARTITION BY query, dom) AS f FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN rr <= 6 THEN 0 ELSE 1 END, CASE WHEN rr <= 6 THEN rr END, CASE WHEN rr <= 6 THEN f END, pos) AS slot FROM a)
SELECT query, doc_id, CAST(slot AS INTEGER) AS slot FROM b WHERE slot <= 10""",
)
def domain_allocate(spark: SparkSession, d: str) -> DataFrame:  # W4, W5
    return rt.allocate(_ranked(spark, d).drop("text"), 10, "dom").select("query", "doc_id", "slot")


@query("per_file_cap", f"WITH {_RANKED} SELECT query, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query, dom ORDER BY pos) AS n FROM r) WHERE n <= 2")
def per_file_cap(spark: SparkSession, d: str) -> DataFrame:  # W3
    return rt.per_file(_ranked(spark, d).drop("text"), 2, "dom").select("query", "doc_id")


@query(
    "rerank_fuse",
    f"""WITH {_RANKED}, l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc_id * 7919 % 1000 DESC, pos) - 1 AS i FROM r)
SELECT query, doc_id, round(0.5 / (11 + i) + 0.5 / (10 + pos), 8) AS fused FROM l""",
)
def rerank_fuse(spark: SparkSession, d: str) -> DataFrame:  # W6, R7
    rows = _ranked(spark, d).withColumn("logit", F.col("doc_id") * 7919 % 1000)
    return rt.rerank_fused(rows.drop("text")).select("query", "doc_id", "fused")


@query(
    "budget_prefix",
    f"""WITH {_RANKED}, p AS (SELECT query, doc_id, pos, max(least(length(text), 2048)) OVER (PARTITION BY query ORDER BY pos ROWS UNBOUNDED PRECEDING) AS w FROM r),
b AS (SELECT *, max(CASE WHEN pos > 1 AND (pos * w > 60000 OR pos > 40) THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bad FROM p)
SELECT query, doc_id FROM b WHERE bad = 0""",
)
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:  # W7
    return rt.footprint_prefix(_ranked(spark, d)).select("query", "doc_id")


@query(
    "dedup_text",
    f"""WITH {_RANKED}, n AS (SELECT *, CASE WHEN length(text) < 50 THEN 'row' || pos ELSE sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS name FROM r),
f AS (SELECT query, doc_id, pos, row_number() OVER (PARTITION BY query, name ORDER BY pos) AS k FROM n)
SELECT query, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS m FROM f WHERE k = 1) WHERE m <= 100""",
)
def dedup_text(spark: SparkSession, d: str) -> DataFrame:  # R10
    return rt.without_repeats(_ranked(spark, d)).select("query", "doc_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = _ranked(spark, d).drop("text")
    return rows.select("query", "pos", "doc_id", F.concat(F.lit("f"), (n % 4).cast("string")).alias("path"), (n * 31 % 900).alias("start"), (n * 31 % 900 + 120 + n % 70).alias("end"))


@query("dedup_spans")
def dedup_spans(spark: SparkSession, d: str) -> DataFrame:  # J14, X18: which rows stay depends on those before
    return rt.without_overlaps(_spans(spark, d)).select("query", "doc_id")


@query("dedup_redundant")
def dedup_redundant(spark: SparkSession, d: str) -> DataFrame:  # R10: text and span tests in one walk; which rows stay depends on those before
    n = F.col("doc_id")
    span = {"path": F.concat(F.lit("f"), (n % 4).cast("string")), "start": n * 31 % 900, "end": n * 31 % 900 + 120 + n % 70}
    return rt.without_redundancy(_ranked(spark, d).select("query", "pos", "doc_id", "text").withColumns(span)).select("query", "doc_id")


_GIVE = "least(need, greatest(32, remaining // 2), remaining)"


@query(
    "pack_context",
    f"""WITH RECURSIVE {_RANKED}, n AS (SELECT query, pos, doc_id, greatest(1, length(text) // 4) AS need FROM r),
p AS (SELECT DISTINCT query, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS tokens, CAST(2000 AS BIGINT) AS remaining FROM n
  UNION ALL SELECT n.query, n.pos, n.doc_id, {_GIVE}, remaining - {_GIVE} FROM p JOIN n ON n.query = p.query AND n.pos = p.pos + 1 WHERE remaining > 0)
SELECT query, CAST(pos AS INTEGER) AS pos, doc_id, tokens FROM p WHERE tokens > 0""",
)
def pack_context(spark: SparkSession, d: str) -> DataFrame:  # R11, R13, W15: each share depends on those before
    return rt.packed(_ranked(spark, d).select("query", "pos", "doc_id", "text"), 2000).select("query", "pos", "doc_id", "tokens")


@query(
    "parent_window",
    with_views(CHUNKS_SQL)
    + """, h AS (SELECT chunk_id AS hit_id, file_id, greatest(0, ("start" + "end") // 2 - 1536) AS s, ("start" + "end") // 2 + 1536 AS e FROM chunks),
n AS (SELECT h.hit_id, c."start", c."end", c.text, h.s, h.e FROM h JOIN chunks c ON c.file_id = h.file_id AND c."start" < h.e AND c."end" > h.s),
l AS (SELECT *, greatest("start", s, coalesce(max("end") OVER (PARTITION BY hit_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS lead, least("end", e) AS upto FROM n)
SELECT hit_id, md5(string_agg(substr(text, lead - "start" + 1, upto - lead), '' ORDER BY "start")) AS parent_md5 FROM l WHERE upto > lead GROUP BY hit_id""",
)
def parent_window(spark: SparkSession, d: str) -> DataFrame:  # R9, W16
    c = chunks(spark, d)
    hits = c.select(F.col("chunk_id").alias("hit_id"), "file_id", "start", "end")
    return rt.parent_windows(hits, c, 3072).select("hit_id", F.md5(F.col("parent_text").cast("binary")).alias("parent_md5"))


@query(
    "merge_evidence",
    """SELECT query, id, event_id FROM (SELECT user_id % 20 AS query, event_id % 300 AS id, event_id,
  row_number() OVER (PARTITION BY user_id % 20, event_id % 300 ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""",
)
def merge_evidence(spark: SparkSession, d: str) -> DataFrame:  # R27
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("query"), (F.col("event_id") % 300).alias("id"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return rt.merge_evidence(e).select("query", "id", F.col("seq").alias("event_id"))


_PAIRS = "p AS (SELECT a.item_id AS a, b.item_id AS b, a.text || CASE WHEN a.item_id % 2 = 0 THEN ' never' ELSE '' END AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 4)"
_LONG = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 4))"
_NEG = "regexp_matches(lower({0}), '\\b(?:not|never|no|cannot|false|incorrect|wrong)\\b')"


@query(
    "contradiction_terms",
    f"WITH {_PAIRS} SELECT a, b, len(list_intersect({_LONG.format('x')}, {_LONG.format('y')})) / greatest(1, least(len({_LONG.format('x')}), len({_LONG.format('y')}))) > 0.5 AND {_NEG.format('x')} <> {_NEG.format('y')} AS clash FROM p",
)
def contradiction_terms(spark: SparkSession, d: str) -> DataFrame:  # R14
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("a"), F.concat("text", F.when(F.col("item_id") % 2 == 0, " never").otherwise("")).alias("x"), (F.col("item_id") - F.col("item_id") % 4).alias("b"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, "b").select("a", "b", rt.contradiction(F.col("x"), F.col("y")).alias("clash"))


GAPS_QUESTION = "Which license covers turbulence, quarks or tionre there?"


@query(
    "knowledge_gaps",
    f"""WITH {_bm25_sql('documents', 'doc_id')}, top AS (SELECT id FROM kw ORDER BY score DESC, id LIMIT 10),
w AS (SELECT unnest(['license', 'covers', 'turbulence', 'quarks', 'tionre']) AS gap),
g AS (SELECT gap FROM w WHERE NOT EXISTS (SELECT 1 FROM top JOIN documents ON doc_id = id WHERE contains(lower(text), gap)) AND (SELECT count(*) FROM documents WHERE contains(lower(text), gap)) < 3)
SELECT gap FROM g UNION ALL SELECT '{GAPS_QUESTION}' WHERE NOT EXISTS (SELECT 1 FROM top)""",
)
def knowledge_gaps(spark: SparkSession, d: str) -> DataFrame:  # R15: words of the question that neither the best rows nor the corpus hold
    docs = table(spark, d, "documents").select("doc_id", "text")
    best = rt.bm25(docs, "text", TERMS, ["doc_id", "text"]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(10)
    rows = best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("pos"), "text", F.lit(0.5).alias("rerank_score"))  # ten rows
    return rt.knowledge_gaps(GAPS_QUESTION, rows, docs)


@query("keyword_index_topk", f"WITH {_bm25_sql('documents', 'doc_id')} SELECT id AS doc_id, score FROM kw ORDER BY score DESC, id LIMIT 40")
def keyword_index_topk(spark: SparkSession, d: str) -> DataFrame:  # R1, R2, T1, A13: the positional index is built once for a state of the table, then read
    docs = table(spark, d, "documents").select("doc_id", "text")
    path = indexes.published(docs, "keyword", lambda path: keyword_index.build(docs, "doc_id", "text", path))
    found = keyword_index.search(spark, path, TERMS, "doc_id")
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(40)


def _vector_index(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return v, indexes.published(v, "vectors", lambda path: vector_index.build(v, path))


@query("vector_index_topk", _NEAREST_SQL)
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:  # R3, J17, T3: exact mode, every list that can matter
    v, path = _vector_index(spark, d)
    return vector_index.search(spark, path, v.filter("vec_id % 50 = 0"), 10, exact=True)


@query("vector_index_recall")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:  # R3: the share of each query's true neighbours that the calibrated probes find; lists depend on k-means, so no SQL
    v, path = _vector_index(spark, d)
    asked = v.filter("vec_id % 50 = 0")
    return vector_index.recall(vector_index.search(spark, path, asked, 10), vector_index.search(spark, path, asked, 10, exact=True))


@query(
    "context_budgets",
    """SELECT conv_id, turn, CAST(greatest(1000, least(CASE role WHEN 'user' THEN 4000 ELSE 10000 END, 8000 + 100 * conv_id) - 400 - least(1000, length(text) // 4) - 80 - 400 * least(turn, 3)) AS BIGINT) AS budget,
  CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM conversations""",
)
def context_budgets(spark: SparkSession, d: str) -> DataFrame:  # R12, R13
    c = table(spark, d, "conversations")
    cap = F.when(F.col("role") == "user", 4000).otherwise(10000)
    budget = rt.context_budget(8000 + 100 * F.col("conv_id"), cap, F.col("text"), F.least("turn", F.lit(3)))
    return c.select("conv_id", "turn", budget.alias("budget"), tx.token_estimate(F.col("text")).alias("tokens"))


_HYBRID_SQL = (
    with_views(CHUNKS_SQL).rstrip()
    + f""", {_bm25_sql('chunks', 'chunk_id')},
k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM kw ORDER BY score DESC, id LIMIT 30),
vv AS (SELECT e.vec_id * 100000 AS id, row_number() OVER (ORDER BY {_DIST}, e.vec_id) - 1 AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY rank LIMIT 30),
f AS (SELECT id, round(sum(p) * 1000, 4) AS score FROM (SELECT id, 0.4 / (61 + rank) AS p FROM k UNION ALL SELECT id, 0.6 / (61 + rank) FROM vv) GROUP BY id),
o AS (SELECT f.id, f.score, c.file_id, d.source AS dom, row_number() OVER (ORDER BY f.score DESC, f.id) AS pos FROM f JOIN chunks c ON c.chunk_id = f.id JOIN documents d ON d.doc_id = c.file_id),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS n FROM o) WHERE n <= 2),
a AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY pos) AS rr, min(pos) OVER (PARTITION BY dom) AS ff FROM u),
b AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rr <= 9 THEN 0 ELSE 1 END, CASE WHEN rr <= 9 THEN rr END, CASE WHEN rr <= 9 THEN ff END, pos) AS slot FROM a)
SELECT CAST(slot AS INTEGER) AS rank, id AS chunk_id, file_id AS doc_id, score FROM b WHERE slot <= 15"""
)


@query("hybrid_search", _HYBRID_SQL)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:  # R6, R26: keyword and vector legs, fused, capped per file, shared over domains
    from corpusloom.plans.search import hybrid

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("domain"))
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") * 100000).alias("vec_id"), "embedding")
    found = hybrid(chunks(spark, d), docs, vectors, TERMS, _vector_of(spark, d, 3), k=15)
    return found.select("rank", "chunk_id", F.col("file_id").alias("doc_id"), "score")


@query("hybrid_indexed", _HYBRID_SQL)
def hybrid_indexed(spark: SparkSession, d: str) -> DataFrame:  # R6, R26, R2, R3: both legs from indexes, built once for a state of the tables
    from corpusloom.plans.search import hybrid

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("domain"))
    vectors = table(spark, d, "embeddings").select((F.col("vec_id") * 100000).alias("vec_id"), "embedding")
    pieces = chunks(spark, d)
    words = indexes.published(pieces, "chunk-keyword", lambda path: keyword_index.build(pieces, "chunk_id", "text", path))
    near = indexes.published(vectors, "chunk-vectors", lambda path: vector_index.build(vectors, path))
    found = hybrid(pieces, docs, vectors, TERMS, _vector_of(spark, d, 3), k=15, keyword_index=words, vector_index=near)
    return found.select("rank", "chunk_id", F.col("file_id").alias("doc_id"), "score")
