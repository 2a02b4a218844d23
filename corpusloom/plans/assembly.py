"""Remaining steps from candidates to an answer's context, and of an index run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import analytics as an
from corpusloom.operators import retrieval as rt
from corpusloom.operators import tables
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval import _DIST, _vector_of
from corpusloom.sources.entities import CHUNKS_SQL, FILES_SQL, chunks, files, table, with_views


@query(
    "adjacency_paths",
    """WITH RECURSIVE n AS (SELECT doc_id + 1 AS id, (doc_id + 1) // 4 AS parent, 'd' || doc_id AS name FROM documents),
p AS (SELECT id, '/' || name AS path, 1 AS depth FROM n WHERE parent = 0 UNION ALL SELECT n.id, p.path || '/' || n.name, p.depth + 1 FROM p JOIN n ON n.parent = p.id) SELECT id, path, depth FROM p""",
)
def adjacency_paths(spark: SparkSession, d: str) -> DataFrame:  # S4: paths from (id, parent, name) by pointer doubling
    n = table(spark, d, "documents").select((F.col("doc_id") + 1).alias("id"), F.floor((F.col("doc_id") + 1) / 4).alias("parent"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    return an.paths_from_parents(n)


@query(
    "stable_chunk_ids",
    with_views(FILES_SQL, CHUNKS_SQL) + 'SELECT row_number() OVER (ORDER BY f.path, c."start") AS id, f.path, c."start" FROM chunks c JOIN files f USING (file_id)',
)
def stable_chunk_ids(spark: SparkSession, d: str) -> DataFrame:  # K2, K10: ids by content order, the same in any run
    rows = chunks(spark, d).select("file_id", "start").join(files(spark, d).select("file_id", "path"), "file_id")
    return tables.numbered(rows, [F.asc("path"), F.asc("start")], "id").select("id", "path", "start")


@query(
    "candidate_cap",
    """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE length(text) >= 50) WHERE rn <= 101""",
)
def candidate_cap(spark: SparkSession, d: str) -> DataFrame:  # F8
    rows = table(spark, d, "documents").filter(F.length("text") >= 50).select("source", "doc_id", "n_chars")
    return an.top_per(rows, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 101).select("source", "doc_id")


@query(
    "typed_nearest",
    with_views(FILES_SQL)
    + f"""SELECT e.vec_id, {_DIST} AS distance FROM embeddings e JOIN files f ON f.file_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 3) q
WHERE ends_with(lower(f.path), '.md') ORDER BY distance, e.vec_id LIMIT 20""",
)
def typed_nearest(spark: SparkSession, d: str) -> DataFrame:  # the type filter holds before the top-k, so nothing is over-fetched
    typed = files(spark, d).filter(F.lower("path").endswith(".md")).select(F.col("file_id").alias("vec_id"))
    rows = table(spark, d, "embeddings").join(typed, "vec_id", "left_semi")
    return rt.nearest(rows, _vector_of(spark, d, 3), 20).select("vec_id", "distance")


@query(
    "profile_leg",
    with_views(FILES_SQL)
    + f""", p AS (SELECT folder_tag, min(file_id) AS vec_id, count(*) AS n FROM files GROUP BY folder_tag)
SELECT p.folder_tag, p.n, {_DIST} AS distance FROM p JOIN embeddings e USING (vec_id), (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY distance, p.vec_id LIMIT 2""",
)
def profile_leg(spark: SparkSession, d: str) -> DataFrame:  # R23, J18
    p = files(spark, d).groupBy("folder_tag").agg(F.min("file_id").alias("vec_id"), F.count("*").alias("n"))
    return rt.nearest(table(spark, d, "embeddings").join(p, "vec_id"), _vector_of(spark, d, 3), 2).select("folder_tag", "n", "distance")


@query(
    "challenge_rows",
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents ORDER BY pos LIMIT 15), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id * 7919 % 1009, doc_id) AS pos FROM documents ORDER BY pos LIMIT 3)
SELECT doc_id, pos FROM a UNION ALL SELECT doc_id, 15 + pos FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
)
def challenge_rows(spark: SparkSession, d: str) -> DataFrame:  # R16: the second question's new rows follow the first's
    docs = table(spark, d, "documents")
    pos = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("long").alias("pos")  # noqa: E731  over the top-k only
    a = docs.orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id", pos(F.desc("n_chars"), "doc_id"))
    by = F.col("doc_id") * 7919 % 1009
    b = docs.orderBy(by, "doc_id").limit(3).select("doc_id", pos(by, "doc_id"))
    return a.unionByName(b.join(a, "doc_id", "left_anti").withColumn("pos", F.col("pos") + 15))


@query(
    "fast_answer",
    with_views(FILES_SQL)
    + "SELECT 'You have ' || count(*) || ' files (' || CAST(CAST(round(sum(size) / 1048576.0, 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' MB): ' || (SELECT string_agg(n || ' ' || type, ', ' ORDER BY n DESC, type) FROM (SELECT type, count(*) AS n FROM files GROUP BY type)) AS answer FROM files",
)
def fast_answer(spark: SparkSession, d: str) -> DataFrame:  # R18, R30
    f = files(spark, d)
    by = f.groupBy("type").agg(F.count("*").alias("n"))
    parts = by.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n"))).alias("x"))  # a row for each type
    listed = F.array_join(F.transform("x", lambda e: F.concat_ws(" ", e["n"].cast("string"), e["type"])), ", ")
    total = f.agg(F.count("*").alias("files"), (F.sum("size") / 1048576).cast("decimal(18,2)").cast("string").alias("mb"))
    return total.join(F.broadcast(parts), how="cross").select(F.concat(F.lit("You have "), "files", F.lit(" files ("), "mb", F.lit(" MB): "), listed).alias("answer"))


@query(
    "context_sections",
    """WITH t AS (SELECT source, doc_id, lang || ' ' || n_chars AS line FROM documents WHERE doc_id % 3 <> 0)
SELECT source, doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY source) THEN '## ' || source || chr(10) || chr(10) || line ELSE line END AS line FROM t""",
)
def context_sections(spark: SparkSession, d: str) -> DataFrame:  # R30, D4
    line = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat_ws(" ", "lang", F.col("n_chars").cast("string")))
    return an.sections(table(spark, d, "documents").select("source", "doc_id", line.alias("line")), "source", "doc_id", "line")


@query(
    "sweep_grid",
    """WITH s AS (SELECT c_custkey AS run, [c_custkey % 3 * 10 + 10, c_custkey % 5 + 60] AS k, ['0.4', CASE WHEN c_custkey % 2 = 0 THEN '0.6' ELSE '0.5' END] AS w, [1, 2, c_custkey % 4 + 3] AS build FROM customer),
x AS (SELECT run, unnest(k) AS k, w, build FROM s), y AS (SELECT run, k, unnest(w) AS w, build FROM x), z AS (SELECT run, k, w, unnest(build) AS build FROM y)
SELECT run, CAST(k AS INTEGER) AS k, w, CAST(build AS INTEGER) AS build, k || '/' || w || '/' || build AS name FROM z""",
)
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:  # X24: stated settings of each run, parsed and multiplied out
    n = F.col("c_custkey")
    number = lambda c: c.cast("string")
    stated = F.concat(F.lit("quiet k="), number(n % 3 * 10 + 10), F.lit(","), number(n % 5 + 60), F.lit(" w=0.4,"), F.when(n % 2 == 0, "0.6").otherwise("0.5"), F.lit(" build=1,2,"), number(n % 4 + 3))
    rows = an.expanded(table(spark, d, "customer").select(n.alias("run"), stated.alias("stated")), "stated", ["k", "w", "build"])
    return rows.select("run", F.col("k").cast("int").alias("k"), "w", F.col("build").cast("int").alias("build"), F.concat_ws("/", "k", "w", "build").alias("name"))


@query(
    "fusion_sweep",
    """WITH r AS (SELECT doc_id // 30 AS query, doc_id AS id, row_number() OVER (PARTITION BY doc_id // 30 ORDER BY n_chars DESC, doc_id) - 1 AS a, row_number() OVER (PARTITION BY doc_id // 30 ORDER BY doc_id * 7919 % 1009, doc_id) - 1 AS b FROM documents),
s AS (SELECT k, query, id, round((0.4 / (k + a + 1) + 0.6 / (k + b + 1)) * 1000, 6) AS s FROM r, (SELECT unnest([10, 60, 200]) AS k)),
o AS (SELECT *, row_number() OVER (PARTITION BY k, query ORDER BY s DESC, id) AS rn FROM s)
SELECT k, round(avg(h), 6) AS share FROM (SELECT k, query, avg(CASE WHEN id % 7 < 2 THEN 1 ELSE 0 END) AS h FROM o WHERE rn <= 5 GROUP BY k, query) GROUP BY k""",
)
def fusion_sweep(spark: SparkSession, d: str) -> DataFrame:  # M21, M22: ranks once, fused at each setting
    w = Window.partitionBy(F.floor(F.col("doc_id") / 30))
    rank = lambda *by: F.row_number().over(w.orderBy(*by, "doc_id")) - 1
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 30).alias("query"), F.col("doc_id").alias("id"), rank(F.desc("n_chars")).alias("a"), rank(F.col("doc_id") * 7919 % 1009).alias("b"))
    each = rows.withColumn("k", F.explode(F.array(F.lit(10), F.lit(60), F.lit(200))))
    score = F.round((0.4 / (F.col("k") + F.col("a") + 1) + 0.6 / (F.col("k") + F.col("b") + 1)) * 1000, 6)
    top = an.top_per(each.withColumn("s", score), ["k", "query"], [F.desc("s"), F.asc("id")], 5, "rn")
    per = top.groupBy("k", "query").agg(F.avg((F.col("id") % 7 < 2).cast("int")).alias("h"))
    return per.groupBy("k").agg(F.round(F.avg("h"), 6).alias("share"))


@query("capped_by_id", with_views(FILES_SQL) + "SELECT file_id, path FROM files ORDER BY file_id LIMIT 200000")
def capped_by_id(spark: SparkSession, d: str) -> DataFrame:  # T7: the view's limit is the feature
    return files(spark, d).orderBy("file_id").limit(200000).select("file_id", "path")


@query(
    "null_discipline",
    """SELECT vec_id, CASE WHEN label % 3 = 0 THEN NULL ELSE greatest(label, 4) END AS strict_max, coalesce(NULLIF(label, 2), -1) AS filled,
  CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END AS clean FROM (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN vec_id % 7 = 0 THEN 'Infinity'::DOUBLE ELSE vec_id / 2 END AS x FROM embeddings)""",
)
def null_discipline(spark: SparkSession, d: str) -> DataFrame:  # X13, D7: max() of any null is null; non-finite numbers are 0
    label = F.col("label")
    maybe = F.when(label % 3 != 0, label)
    strict = F.when(maybe.isNotNull(), F.greatest(maybe, F.lit(4)))
    x = F.when(F.col("vec_id") % 5 == 0, float("nan")).when(F.col("vec_id") % 7 == 0, float("inf")).otherwise(F.col("vec_id") / 2)
    rows = table(spark, d, "embeddings").select("vec_id", strict.alias("strict_max"), F.coalesce(F.nullif(label, F.lit(2)), F.lit(-1)).alias("filled"), x.alias("x"))
    return rows.select("vec_id", "strict_max", "filled", F.when(F.isnan("x") | (F.abs("x") == float("inf")), 0.0).otherwise(F.col("x")).alias("clean"))


@query(
    "score_badges",
    "SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'high' WHEN n_chars > 800 THEN 'medium' ELSE 'low' END AS badge, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE CAST(CAST(round(n_chars / 1024.0, 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' KB' END AS size FROM documents",
)
def score_badges(spark: SparkSession, d: str) -> DataFrame:  # X22, X10
    n = F.col("n_chars")
    badge = F.when(n > 3000, "high").when(n > 800, "medium").otherwise("low")
    size = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat((n.cast("decimal(18,6)") / 1024).cast("decimal(18,1)").cast("string"), F.lit(" KB")))
    return table(spark, d, "documents").select("doc_id", badge.alias("badge"), size.alias("size"))


@query(
    "unit_vectors",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS length2, label IN (1, 2) AS kept FROM embeddings",
)
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:  # X25, R25
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(rt.dot(v, v), 4).alias("length2"), F.col("label").isin(1, 2).alias("kept"))


@query(
    "unseen_evidence",
    """WITH r AS (SELECT user_id % 6 AS round, event_id % 400 AS id FROM events), f AS (SELECT id, min(round) AS first FROM r GROUP BY id)
SELECT r.round, count(DISTINCT r.id) AS ids, count(DISTINCT r.id) FILTER (f.first = r.round) AS new, count(DISTINCT r.id) FILTER (f.first = r.round) = 0 AS fixpoint FROM r JOIN f USING (id) GROUP BY r.round""",
)
def unseen_evidence(spark: SparkSession, d: str) -> DataFrame:  # U7: a round that finds nothing new ends the loop
    r = table(spark, d, "events").select((F.col("user_id") % 6).alias("round"), (F.col("event_id") % 400).alias("id")).distinct()
    rows = r.join(r.groupBy("id").agg(F.min("round").alias("first")), "id")
    new = F.sum((F.col("first") == F.col("round")).cast("long"))
    return rows.groupBy("round").agg(F.count("*").alias("ids"), new.alias("new"), (new == 0).alias("fixpoint"))


@query(
    "clear_all",
    with_views(FILES_SQL, CHUNKS_SQL)
    + """SELECT 'files' AS target, count(*) AS removed, 0 AS "left" FROM files UNION ALL SELECT 'chunks', count(*), 0 FROM chunks UNION ALL SELECT 'vectors', count(*), 0 FROM embeddings
UNION ALL SELECT 'history', count(*), 0 FROM events UNION ALL SELECT 'cache', 0, count(*) FROM customer""",
)
def clear_all(spark: SparkSession, d: str) -> DataFrame:  # K6: the cache goes by content and stays
    state = {"files": files(spark, d), "chunks": chunks(spark, d), "vectors": table(spark, d, "embeddings"), "history": table(spark, d, "events"), "cache": table(spark, d, "customer")}
    return tables.reset_counts(state, "all")


def toy_embedding(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often five letters occur."""
    return [[float(t.count(c)) for c in "etaon"] for t in texts]


@query(
    "reembed",
    with_views(FILES_SQL, CHUNKS_SQL)
    + """, t AS (SELECT 'chunk' AS target, c.chunk_id AS id, '[' || upper(f.type) || ': ' || regexp_extract(f.path, '[^/]*$') || '] ' || c.text AS text FROM chunks c JOIN files f USING (file_id)
UNION ALL SELECT 'summary', file_id, summary FROM files WHERE summary <> '' AND NOT starts_with(summary, '[ERROR:'))
SELECT target, id, list_transform(['e', 't', 'a', 'o', 'n'], lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE)) AS vector FROM t""",
)
def reembed(spark: SparkSession, d: str) -> DataFrame:  # P8: vectors of all chunks and summaries, made anew
    from corpusloom.plans.indexing import reembedded

    return reembedded(files(spark, d), chunks(spark, d), toy_embedding)


@query(
    "index_run",
    with_views(FILES_SQL, CHUNKS_SQL)
    + """, n AS (SELECT file_id FROM files WHERE file_id % 3 <> 0)
SELECT 'chunks' AS target, count(*) AS n FROM chunks WHERE file_id IN (SELECT file_id FROM n) UNION ALL SELECT 'summaries', count(*) FROM files WHERE file_id IN (SELECT file_id FROM n) AND summary <> '' AND NOT starts_with(summary, '[ERROR:')
UNION ALL SELECT 'profiles', count(DISTINCT root_path) FROM files""",
)
def index_run(spark: SparkSession, d: str) -> DataFrame:  # P1, P2, P5, P8: what one run writes to each table, from one change set
    from corpusloom.plans.indexing import outputs

    f = files(spark, d)
    old = f.filter("file_id % 3 = 0")
    parts = outputs(f.withColumn("sha256", F.coalesce("sha256", F.lit(""))), old.withColumn("sha256", F.lit("x")), chunks(spark, d))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("target"), "n") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
