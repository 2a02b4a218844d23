"""Filters, joins, set operations and table maintenance over files, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import scopes, tables
from corpusloom.plans.registry import query
from corpusloom.sources.entities import CHUNKS_SQL, FILES_SQL, chunks, files, table, with_views


@query(
    "prefix_scope",
    with_views(FILES_SQL)
    + """SELECT file_id, path, size FROM files
WHERE path = '/corpus/src1' OR starts_with(path, '/corpus/src1/') OR starts_with(path, '/corpus/src1' || chr(92))""",
)
def prefix_scope(spark: SparkSession, d: str) -> DataFrame:  # F5, D5
    return files(spark, d).filter(scopes.under(F.col("path"), "/corpus/src1/")).select("file_id", "path", "size")


@query(
    "typed_scope",
    with_views(FILES_SQL) + "SELECT file_id, path FROM files WHERE type = 'md' AND folder_tag = 'src3'",
)
def typed_scope(spark: SparkSession, d: str) -> DataFrame:  # F1, F17
    return scopes.having(files(spark, d), type="md", folder_tag="src3", size=None).select("file_id", "path")


@query(
    "folded_path_match",
    with_views(FILES_SQL)
    + "SELECT file_id FROM files WHERE contains(lower(replace(path, chr(92), '/')), 'src1/en/part_') OR contains(lower(replace(path, chr(92), '/')), 'src2/en/part1')",
)
def folded_path_match(spark: SparkSession, d: str) -> DataFrame:  # F6, F12
    path = F.col("path")
    hit = scopes.same_folder_text(path, "SRC1\\en/Part_") | scopes.same_folder_text(path, "SRC2\\en\\Part1")
    return files(spark, d).filter(hit).select("file_id")


@query(
    "folder_scope_split",
    with_views(FILES_SQL)
    + """SELECT DISTINCT root_path, regexp_extract(root_path, '([^/]+)/*$', 1) AS tag,
  regexp_replace(root_path, '/+$', '') AS root FROM files""",
)
def folder_scope_split(spark: SparkSession, d: str) -> DataFrame:  # F4
    roots = files(spark, d).select("root_path").distinct()
    return roots.select("root_path", scopes.basename(F.regexp_replace("root_path", "/+$", "")).alias("tag"), F.regexp_replace("root_path", "/+$", "").alias("root"))


_CHANGE = """,
seen AS (SELECT path, CASE WHEN file_id % 29 = 0 THEN NULL WHEN file_id % 5 = 0 THEN modified_s + 60 ELSE modified_s END AS m FROM files WHERE file_id % 13 <> 0),
old AS (SELECT path, modified_s, sha256 FROM files WHERE file_id % 7 <> 0)
"""


@query(
    "change_detect",
    with_views(FILES_SQL)
    + _CHANGE
    + """SELECT seen.path, CASE WHEN m IS NULL THEN 'unreadable' WHEN old.path IS NULL THEN 'new'
  WHEN m = modified_s AND coalesce(sha256, '') NOT IN ('', 'ERROR', 'CANCELLED', 'NOCONTENT') THEN 'unchanged' ELSE 'changed' END AS state
FROM seen LEFT JOIN old ON seen.path = old.path""",
)
def change_detect(spark: SparkSession, d: str) -> DataFrame:  # F7
    f = files(spark, d)
    n = F.col("file_id")
    m = F.when(n % 29 == 0, None).when(n % 5 == 0, F.col("modified_s") + 60).otherwise(F.col("modified_s"))
    return scopes.change_state(f.filter(n % 7 != 0), f.filter(n % 13 != 0).select("path", m.alias("modified_s")))


@query(
    "extract_status",
    """SELECT doc_id, CASE WHEN starts_with(t, '[BINARY:') THEN 'binary' WHEN starts_with(t, '[UNREADABLE:') THEN 'unreadable'
  WHEN starts_with(t, '[ENCRYPTED') THEN 'encrypted' WHEN length(trim(t)) = 0 THEN 'empty' WHEN length(t) < 50 THEN 'nocontent' ELSE '' END AS status
FROM (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '[BINARY: x]' WHEN doc_id % 37 = 0 THEN '[ENCRYPTED pdf]' WHEN doc_id % 41 = 0 THEN ' ' ELSE text END AS t FROM documents)""",
)
def extract_status(spark: SparkSession, d: str) -> DataFrame:  # F13, F14
    n = F.col("doc_id")
    t = F.when(n % 31 == 0, "[BINARY: x]").when(n % 37 == 0, "[ENCRYPTED pdf]").when(n % 41 == 0, " ").otherwise(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"))
    stub = scopes.stub_state(F.col("t"))
    state = F.when(stub != "", stub).when(F.length(F.trim("t")) == 0, "empty").when(F.length("t") < 50, "nocontent").otherwise("")
    return rows.select("doc_id", state.alias("status"))


@query(
    "regate_candidates",
    with_views(FILES_SQL)
    + """SELECT path FROM files WHERE path LIKE '%.pdf' AND coalesce(sha256, '') NOT IN ('', 'ERROR', 'CANCELLED', 'NOCONTENT')
  AND (starts_with(path, '/corpus/src1/') OR starts_with(path, '/corpus/src2/'))""",
)
def regate_candidates(spark: SparkSession, d: str) -> DataFrame:  # F15
    path = F.col("path")
    rooted = scopes.under(path, "/corpus/src1") | scopes.under(path, "/corpus/src2")
    valid = ~F.coalesce("sha256", F.lit("")).isin(*scopes.DIGEST_STATES)
    return files(spark, d).filter(path.endswith(".pdf") & valid & rooted).select("path")


@query(
    "usable_summaries",
    with_views(FILES_SQL) + "SELECT file_id, folder_tag FROM files WHERE coalesce(summary, '') <> '' AND NOT starts_with(summary, '[ERROR:')",
)
def usable_summaries(spark: SparkSession, d: str) -> DataFrame:  # F16, D4
    return files(spark, d).filter(scopes.usable_summary(F.col("summary"))).select("file_id", "folder_tag")


@query(
    "relevance_cut",
    """WITH r AS (SELECT doc_id % 97 AS query, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY n_chars DESC, doc_id) AS pos, doc_id,
  n_chars / 1000.0 AS score, CASE doc_id % 97 % 3 WHEN 0 THEN NULL WHEN 1 THEN n_chars / 2000.0 - 2.5 ELSE CASE WHEN doc_id % 2 = 0 THEN 1.0 END END AS rr FROM documents),
w AS (SELECT *, count(*) OVER q AS n, count(rr) OVER q AS k, max(CASE WHEN pos = 1 THEN score END) OVER q AS top, max(CASE WHEN rr >= -2 THEN 1 ELSE 0 END) OVER q AS good FROM r WINDOW q AS (PARTITION BY query))
SELECT query, pos, doc_id FROM w
WHERE (k = n AND CASE WHEN good = 1 THEN rr >= -2 ELSE pos = 1 END) OR (k = 0 AND (top <= 0 OR score >= top * 0.5)) OR (k > 0 AND k < n)""",
)
def relevance_cut(spark: SparkSession, d: str) -> DataFrame:  # F9
    docs = table(spark, d, "documents")
    q = F.col("doc_id") % 97
    w = Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc_id")
    rr = F.when(q % 3 == 0, None).when(q % 3 == 1, F.col("n_chars") / 2000.0 - 2.5).when(F.col("doc_id") % 2 == 0, 1.0)
    rows = docs.select(q.alias("query"), "doc_id", "n_chars").withColumn("pos", F.row_number().over(w))
    rows = rows.select("query", "pos", "doc_id", (F.col("n_chars") / 1000.0).alias("score"), rr.alias("rerank_score"))
    return scopes.relevant(rows).select("query", F.col("pos").cast("long").alias("pos"), "doc_id")


@query(
    "near_misses",
    """SELECT source, rn - 5 AS miss, doc_id FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn BETWEEN 6 AND 15""",
)
def near_misses(spark: SparkSession, d: str) -> DataFrame:  # F11
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).cast("long").alias("rn"))
    return rows.filter(F.col("rn").between(6, 15)).select("source", (F.col("rn") - 5).alias("miss"), "doc_id")


@query(
    "root_tags",
    with_views(FILES_SQL)
    + """, roots AS (SELECT '/corpus/src1' AS root, 'one' AS tag, 2 AS pri UNION ALL SELECT '/corpus/src1/en', 'one-en', 1 UNION ALL SELECT '/corpus/src2', 'two', 3)
SELECT f.path, coalesce(arg_min(tag, pri), 'Unknown') AS tag, coalesce(arg_min(root, pri), '') AS root
FROM files f LEFT JOIN roots ON f.path = root OR starts_with(f.path, root || '/') GROUP BY f.path""",
)
def root_tags(spark: SparkSession, d: str) -> DataFrame:  # S6
    roots = spark.createDataFrame([("/corpus/src1", "one", 2), ("/corpus/src1/en", "one-en", 1), ("/corpus/src2", "two", 3)], "root string, tag string, at int")
    return scopes.first_root(files(spark, d), roots)


@query(
    "outermost_roots",
    with_views(FILES_SQL)
    + """, r AS (SELECT DISTINCT root_path AS root FROM files UNION SELECT root_path || '/en' FROM files UNION SELECT root_path || 'x' FROM files)
SELECT root FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE starts_with(a.root, b.root || '/'))""",
)
def outermost_roots(spark: SparkSession, d: str) -> DataFrame:  # S5
    r = files(spark, d).select("root_path").distinct()
    every = r.select(F.explode(F.array("root_path", F.concat("root_path", F.lit("/en")), F.concat("root_path", F.lit("x")))).alias("root"))
    return scopes.outermost(every)


@query(
    "points_and_pages",
    """SELECT doc_id, 'id' AS kind FROM documents WHERE doc_id IN (1, 5, 7, 9000000) UNION ALL
SELECT * FROM (SELECT doc_id, 'page' FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50)""",
)
def points_and_pages(spark: SparkSession, d: str) -> DataFrame:  # S20, T12
    ids = table(spark, d, "documents").select("doc_id")
    points = ids.filter(F.col("doc_id").isin(1, 5, 7, 9000000)).select("doc_id", F.lit("id").alias("kind"))
    page = ids.filter("doc_id > 100").orderBy("doc_id").limit(50).select("doc_id", F.lit("page").alias("kind"))
    return points.unionByName(page)


@query("vector_census", "SELECT count(*) AS n, max(vec_id) AS max_id, count(DISTINCT vec_id) AS ids FROM embeddings")
def vector_census(spark: SparkSession, d: str) -> DataFrame:  # S21, A2
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.max("vec_id").alias("max_id"), F.countDistinct("vec_id").alias("ids"))


# ---- joins


@query(
    "chunks_with_files",
    with_views(FILES_SQL, CHUNKS_SQL)
    + "SELECT c.chunk_id, f.path, f.folder_tag, c.\"start\", c.\"end\" FROM chunks c JOIN files f USING (file_id) WHERE f.type = 'md'",
)
def chunks_with_files(spark: SparkSession, d: str) -> DataFrame:  # J1
    f = files(spark, d).filter("type = 'md'").select("file_id", "path", "folder_tag")
    return chunks(spark, d).drop("text").join(f, "file_id").select("chunk_id", "path", "folder_tag", "start", "end")


@query(
    "vectors_chunks_files",
    with_views(FILES_SQL, CHUNKS_SQL)
    + "SELECT e.vec_id, c.chunk_id, f.path FROM embeddings e JOIN chunks c ON c.chunk_id = e.vec_id * 100000 JOIN files f ON f.file_id = c.file_id",
)
def vectors_chunks_files(spark: SparkSession, d: str) -> DataFrame:  # J2, J3, D1
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 100000).alias("chunk_id"))
    return e.join(chunks(spark, d).select("chunk_id", "file_id"), "chunk_id").join(files(spark, d).select("file_id", "path"), "file_id").select("vec_id", "chunk_id", "path")


@query("missing_vectors", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:  # J4
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left_anti")


@query(
    "ghost_vectors",
    """SELECT coalesce(doc_id, vec_id) AS id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'ghost' END AS state
FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL""",
)
def ghost_vectors(spark: SparkSession, d: str) -> DataFrame:  # J19, U5
    left = table(spark, d, "documents").select("doc_id")
    both = left.join(table(spark, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "full")
    lone = both.filter("doc_id IS NULL OR vec_id IS NULL")
    return lone.select(F.coalesce("doc_id", "vec_id").alias("id"), F.when(F.col("vec_id").isNull(), "missing").otherwise("ghost").alias("state"))


@query(
    "chunks_per_doc",
    with_views(FILES_SQL, CHUNKS_SQL)
    + """SELECT f.file_id, count(c.chunk_id) AS n_chunks, CAST(coalesce(sum(length(c.text)), 0) AS BIGINT) AS chars
FROM files f LEFT JOIN chunks c USING (file_id) GROUP BY f.file_id""",
)
def chunks_per_doc(spark: SparkSession, d: str) -> DataFrame:  # J5
    per = chunks(spark, d).groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    return files(spark, d).select("file_id").join(per, "file_id", "left").select(
        "file_id", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("c", F.lit(0)).cast("long").alias("chars")
    )


@query(
    "first_n_per_file",
    with_views(CHUNKS_SQL) + "SELECT chunk_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS rn FROM chunks) WHERE rn <= 3",
)
def first_n_per_file(spark: SparkSession, d: str) -> DataFrame:  # J9, W2, D9
    w = Window.partitionBy("file_id").orderBy("chunk_id")
    rows = chunks(spark, d).select("chunk_id", "file_id").withColumn("rn", F.row_number().over(w))
    return rows.filter("rn <= 3").drop("rn")


@query(
    "head_chunks",
    with_views(CHUNKS_SQL) + "SELECT file_id, min(chunk_id) AS chunk_id, max(\"end\") AS base_offset FROM chunks GROUP BY file_id",
)
def head_chunks(spark: SparkSession, d: str) -> DataFrame:  # A14, A15
    return chunks(spark, d).groupBy("file_id").agg(F.min("chunk_id").alias("chunk_id"), F.max("end").alias("base_offset"))


@query(
    "semi_profile_exists",
    with_views(FILES_SQL)
    + """, p AS (SELECT DISTINCT root_path || '/en' AS folder FROM files UNION SELECT DISTINCT root_path || '/xx' FROM files)
SELECT folder FROM p WHERE EXISTS (SELECT 1 FROM files WHERE path = folder OR starts_with(path, folder || '/'))""",
)
def semi_profile_exists(spark: SparkSession, d: str) -> DataFrame:  # J6
    f = files(spark, d)
    roots = f.select("root_path").distinct()
    p = roots.select(F.explode(F.array(F.concat("root_path", F.lit("/en")), F.concat("root_path", F.lit("/xx")))).alias("folder"))
    return p.join(tables.ancestors(f, "path").select(F.col("ancestor").alias("folder")), "folder", "left_semi")


@query(
    "semi_json_value",
    """SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT))""",
)
def semi_json_value(spark: SparkSession, d: str) -> DataFrame:  # J7, X12
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.join(n, "k", "left_semi").select("event_id")


@query(
    "ranked_path_expansion",
    with_views(FILES_SQL, CHUNKS_SQL)
    + """, p AS (SELECT path, file_id, rank FROM (SELECT path, file_id, row_number() OVER (ORDER BY size DESC, path) - 1 AS rank FROM files) WHERE rank < 20)
SELECT rank, chunk_id FROM (SELECT p.rank, c.chunk_id, row_number() OVER (PARTITION BY c.file_id ORDER BY c.chunk_id) AS rn FROM p JOIN chunks c USING (file_id)) WHERE rn <= 5""",
)
def ranked_path_expansion(spark: SparkSession, d: str) -> DataFrame:  # J12, R4
    top = files(spark, d).orderBy(F.desc("size"), "path").limit(20)  # the top-k is the operator
    ranked = top.select("file_id", (F.row_number().over(Window.orderBy(F.desc("size"), "path")) - 1).cast("long").alias("rank"))
    w = Window.partitionBy("file_id").orderBy("chunk_id")
    rows = chunks(spark, d).select("chunk_id", "file_id").join(F.broadcast(ranked), "file_id")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("rank", "chunk_id")


# ---- maintenance: the new state of a table as a DataFrame

_UPSERT = """,
old AS (SELECT file_id AS id, path, lower(type) AS type, size FROM files WHERE file_id % 4 <> 0),
new AS (SELECT path, type, size + 1 AS size FROM files WHERE file_id % 3 = 0)
"""


@query(
    "upsert_merge",
    with_views(FILES_SQL)
    + _UPSERT
    + """SELECT coalesce(old.id, (SELECT max(id) FROM old) + row_number() OVER (PARTITION BY old.id IS NULL ORDER BY coalesce(new.path, old.path))) AS id,
  coalesce(new.path, old.path) AS path, coalesce(lower(new.type), old.type) AS type, coalesce(new.size, old.size) AS size
FROM old FULL JOIN new ON old.path = new.path""",
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:  # K1, K15, K3
    f = files(spark, d)
    old = f.filter("file_id % 4 <> 0").select(F.col("file_id").alias("id"), "path", "type", "size")
    new = f.filter("file_id % 3 = 0").select("path", F.lower("type").alias("type"), (F.col("size") + 1).alias("size"))
    return tables.upsert(old, new, key="path", surrogate="id")


@query(
    "latest_by_key",
    """SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:  # K3
    return tables.last_writer(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(
    "delete_cascade",
    with_views(FILES_SQL, CHUNKS_SQL)
    + """SELECT 'files' AS kept, file_id AS id FROM files WHERE NOT starts_with(path, '/corpus/src1/') UNION ALL
SELECT 'chunks', chunk_id FROM chunks WHERE file_id NOT IN (SELECT file_id FROM files WHERE starts_with(path, '/corpus/src1/'))""",
)
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:  # K4, K5, K11
    f, c = files(spark, d), chunks(spark, d).select("chunk_id", "file_id")
    gone = f.filter(scopes.under(F.col("path"), "/corpus/src1")).select("file_id")
    kept = f.join(gone, "file_id", "left_anti").select(F.lit("files").alias("kept"), F.col("file_id").alias("id"))
    return kept.unionByName(c.join(gone, "file_id", "left_anti").select(F.lit("chunks").alias("kept"), F.col("chunk_id").alias("id")))


@query(
    "vanished_files",
    with_views(FILES_SQL)
    + """, scanned AS (SELECT path, root_path FROM files WHERE file_id % 9 <> 0 AND folder_tag <> 'src4')
SELECT path FROM files f WHERE path NOT IN (SELECT path FROM scanned) AND root_path IN (SELECT root_path FROM scanned)""",
)
def vanished_files(spark: SparkSession, d: str) -> DataFrame:  # K7
    f = files(spark, d).select("file_id", "path", "root_path", "folder_tag")
    return tables.vanished(f, f.filter("file_id % 9 <> 0 AND folder_tag <> 'src4'")).select("path")


@query(
    "usage_increment",
    with_views(FILES_SQL)
    + """, used AS (SELECT doc_id % 50 AS file_id FROM documents)
SELECT f.file_id, CAST(f.usage_count + coalesce(n, 0) AS BIGINT) AS usage_count FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM used GROUP BY 1) u USING (file_id)""",
)
def usage_increment(spark: SparkSession, d: str) -> DataFrame:  # K8
    used = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("file_id")).groupBy("file_id").agg(F.count("*").alias("n"))
    rows = files(spark, d).select("file_id", "usage_count").join(used, "file_id", "left")
    return rows.select("file_id", (F.col("usage_count") + F.coalesce("n", F.lit(0))).alias("usage_count"))


@query(
    "cache_prune",
    "SELECT event_id FROM (SELECT event_id, rank() OVER (ORDER BY ts DESC) AS r FROM events) WHERE r <= 500",
)
def cache_prune(spark: SparkSession, d: str) -> DataFrame:  # K12
    return tables.newest(table(spark, d, "events").select("event_id", "ts"), "ts", 500).select("event_id")


@query(
    "resume_set",
    """SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type IN (SELECT min(event_type) FROM events) AND value IS NOT NULL)""",
)
def resume_set(spark: SparkSession, d: str) -> DataFrame:  # K14
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    done = e.join(F.broadcast(first), "event_type").filter("value IS NOT NULL").select("event_id")  # one row
    return e.select("event_id").join(done, "event_id", "left_anti")


# ---- set operations


@query(
    "rank_intersection",
    """SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200) INTERSECT
SELECT vec_id FROM embeddings""",
)
def rank_intersection(spark: SparkSession, d: str) -> DataFrame:  # U4
    top = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(200).select("doc_id")
    return top.intersect(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query(
    "pool_union",
    """SELECT doc_id, min(pos) AS pos FROM (
  SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE lang = 'en' UNION ALL
  SELECT doc_id, 1000000 + row_number() OVER (ORDER BY doc_id) FROM documents WHERE source = 'src1') GROUP BY doc_id""",
)
def pool_union(spark: SparkSession, d: str) -> DataFrame:  # U6, W11, R17
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    forced = tables.numbered(docs.filter("lang = 'en'"), [F.desc("n_chars"), F.asc("doc_id")], "pos")
    others = tables.numbered(docs.filter("source = 'src1'"), [F.asc("doc_id")], "pos").withColumn("pos", F.col("pos") + 1000000)
    both = forced.select("doc_id", "pos").unionByName(others.select("doc_id", "pos"))
    return both.groupBy("doc_id").agg(F.min("pos").alias("pos"))


@query(
    "kept_tags",
    with_views(FILES_SQL) + "SELECT DISTINCT folder_tag FROM files EXCEPT SELECT folder_tag FROM files WHERE type = 'md' AND size > 20000",
)
def kept_tags(spark: SparkSession, d: str) -> DataFrame:  # U5, A24
    f = files(spark, d)
    return f.select("folder_tag").distinct().exceptAll(f.filter("type = 'md' AND size > 20000").select("folder_tag").distinct())


@query(
    "node_stream",
    with_views(FILES_SQL)
    + "SELECT DISTINCT 'folder' AS kind, root_path AS path, CAST(NULL AS BIGINT) AS size FROM files UNION ALL SELECT 'file', path, size FROM files",
)
def node_stream(spark: SparkSession, d: str) -> DataFrame:  # D3, D7, U1
    f = files(spark, d)
    folders = f.select(F.lit("folder").alias("kind"), F.col("root_path").alias("path")).distinct()
    return folders.unionByName(f.select(F.lit("file").alias("kind"), "path", "size"), allowMissingColumns=True)


@query("parameterised_sql", "SELECT lang, count(*) AS n FROM documents WHERE n_chars >= 500 AND lang <> 'fr' GROUP BY lang")
def parameterised_sql(spark: SparkSession, d: str) -> DataFrame:  # D6
    return tables.sql(
        spark, "SELECT lang, count(*) AS n FROM {docs} WHERE n_chars >= :least AND lang <> :skip GROUP BY lang",
        {"least": 500, "skip": "fr"}, docs=table(spark, d, "documents"),
    )
