"""Aggregations, roll-ups, intervals and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.operators import analytics as an
from corpusloom.operators import tables
from corpusloom.plans.registry import query
from corpusloom.sources.entities import CHUNKS_SQL, FILES_SQL, chunks, files, table, with_views


@query(
    "file_stats",
    with_views(FILES_SQL)
    + """SELECT 'type' AS src, type AS label, count(*) AS cnt, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) / 1048576.0, 2) AS mb FROM files GROUP BY type UNION ALL
SELECT 'folder', folder_tag, count(*), CAST(sum(size) AS BIGINT), round(sum(size) / 1048576.0, 2) FROM files GROUP BY folder_tag""",
)
def file_stats(spark: SparkSession, d: str) -> DataFrame:  # A1, U1, X10
    return an.tagged_counts(files(spark, d)).withColumn("mb", tx.megabytes(F.col("bytes")))


@query(
    "dashboard_top_cold",
    with_views(FILES_SQL)
    + """SELECT 'large' AS list, rank, path FROM (SELECT path, row_number() OVER (ORDER BY size DESC, path) AS rank FROM files) WHERE rank <= 10 UNION ALL
SELECT 'cold', rank, path FROM (SELECT path, row_number() OVER (ORDER BY usage_count, size DESC, path) AS rank FROM files) WHERE rank <= 15""",
)
def dashboard_top_cold(spark: SparkSession, d: str) -> DataFrame:  # A3, T5
    return an.cold_and_large(files(spark, d), 10, 15)


@query("dashboard_totals", with_views(FILES_SQL) + "SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_docs FROM files")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:  # A2, A3, A12, A27
    docs = table(spark, d, "documents").filter(F.length("text") > 0).agg(F.count("*").alias("n_docs"))
    totals = files(spark, d).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return totals.join(F.broadcast(docs), how="cross")  # one row each


@query(
    "top_per_extension",
    with_views(FILES_SQL)
    + """SELECT type, rank, path FROM (SELECT type, path, row_number() OVER (PARTITION BY type ORDER BY usage_count, size DESC, path) AS rank FROM files) WHERE rank <= 15""",
)
def top_per_extension(spark: SparkSession, d: str) -> DataFrame:  # A4
    return an.top_per(files(spark, d).select("type", "path", "usage_count", "size"), ["type"], [F.asc("usage_count"), F.desc("size"), F.asc("path")], 15).select("type", "rank", "path")


@query(
    "folder_profiles",
    with_views(FILES_SQL)
    + """, e AS (SELECT root_path, type, count(*) AS n, row_number() OVER (PARTITION BY root_path ORDER BY count(*) DESC, type) AS rank FROM files GROUP BY root_path, type),
t AS (SELECT root_path, string_agg(type || ': ' || n, ', ' ORDER BY rank) AS top_extensions FROM e WHERE rank <= 8 GROUP BY root_path)
SELECT f.root_path, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size, any_value(top_extensions) AS top_extensions, '' AS key_files,
  '.' || (SELECT arg_min(type, rank) FROM e WHERE e.root_path = f.root_path) || ' files' AS project
FROM files f JOIN t USING (root_path) GROUP BY f.root_path""",
)
def folder_profiles(spark: SparkSession, d: str) -> DataFrame:  # A5, A6, P7
    f = files(spark, d)
    return an.folder_profiles(f).join(an.project_types(f), "root_path")


@query(
    "ancestor_rollup",
    with_views(FILES_SQL)
    + """, p AS (SELECT string_split(path, '/') AS x, size, usage_count FROM files)
SELECT array_to_string(x[1:i], '/') AS folder, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS size, CAST(sum(usage_count) AS BIGINT) AS usage
FROM p, range(2, len(x)) r(i) GROUP BY 1""",
)
def ancestor_rollup(spark: SparkSession, d: str) -> DataFrame:  # A7
    return an.ancestor_rollup(files(spark, d))


@query(
    "collapsed_folders",
    with_views(FILES_SQL)
    + """, p AS (SELECT string_split(path, '/') AS x, size FROM files),
r AS (SELECT array_to_string(x[1:i], '/') AS folder, CAST(sum(size) AS BIGINT) AS size FROM p, range(2, len(x)) r(i) GROUP BY 1),
c AS (SELECT regexp_replace(folder, '/[^/]*$', '') AS folder FROM r GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT folder FROM c WHERE folder NOT IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM files)),
u AS (SELECT r.folder, r.size, a.i, array_to_string(string_split(r.folder, '/')[1:a.i], '/') IN (SELECT folder FROM l) AS link FROM r, range(2, len(string_split(r.folder, '/'))) a(i) WHERE r.folder NOT IN (SELECT folder FROM l)),
t AS (SELECT r.folder, r.size, coalesce((SELECT max(i) FROM u WHERE u.folder = r.folder AND NOT link), 1) AS last FROM r WHERE r.folder NOT IN (SELECT folder FROM l))
SELECT folder, size, array_to_string(string_split(folder, '/')[last + 1:], ' / ') AS name FROM t""",
)
def collapsed_folders(spark: SparkSession, d: str) -> DataFrame:  # A10
    f = files(spark, d)
    return an.collapsed_chains(an.ancestor_rollup(f), f).select("folder", "size", "name")


@query(
    "tree_by_root",
    with_views(FILES_SQL)
    + "SELECT root_path, count(*) AS n, min(path) AS first_path, max(path) AS last_path, CAST(sum(CAST('0x' || substr(md5(path), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM files GROUP BY root_path",
)
def tree_by_root(spark: SparkSession, d: str) -> DataFrame:  # A8, D2
    # a sum of hashes needs no list of a root's paths in one place
    part = F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 8), 16, 10).cast("long")
    return files(spark, d).groupBy("root_path").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"), F.sum(part).alias("digest"))


@query(
    "category_rollup",
    with_views(FILES_SQL)
    + """, c AS (SELECT CASE WHEN type IN ('md', 'txt') THEN 'text' WHEN type = 'py' THEN 'code' ELSE 'data' END AS category, type, size FROM files)
SELECT category, type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, round(sqrt(sum(size) + 1) * 10, 6) AS weight FROM c GROUP BY ROLLUP (category, type)""",
)
def category_rollup(spark: SparkSession, d: str) -> DataFrame:  # A9
    category = F.when(F.col("type").isin("md", "txt"), "text").when(F.col("type") == "py", "code").otherwise("data")
    rows = files(spark, d).select(category.alias("category"), "type", "size")
    return rows.rollup("category", "type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.round(F.sqrt(F.sum("size") + 1) * 10, 6).alias("weight"))


@query(
    "term_document_frequency",
    "SELECT t.term, count(*) FILTER (contains(lower(text), term)) AS df FROM documents, (VALUES ('the'), ('ction'), ('über'), ('license')) t(term) GROUP BY t.term",
)
def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:  # A13
    terms = ("the", "ction", "über", "license")
    low = table(spark, d, "documents").select(F.lower("text").alias("t"))
    counts = low.agg(*[F.sum(F.contains("t", F.lit(w)).cast("long")).alias(w) for w in terms])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.coalesce(F.col(w), F.lit(0)).alias("df")) for w in terms])).alias("x")).select("x.*")


@query(
    "format_survey",
    with_views(FILES_SQL, CHUNKS_SQL)
    + """, p AS (SELECT f.type, f.file_id, coalesce(sum(length(c.text)), 0) AS chars, count(c.chunk_id) AS n FROM files f LEFT JOIN chunks c USING (file_id) GROUP BY 1, 2)
SELECT type, count(*) AS files, CAST(sum(n) AS BIGINT) AS chunks, count(*) FILTER (chars < 500) AS thin, count(*) FILTER (chars >= 500 AND chars < 5000) AS middle,
  count(*) FILTER (chars >= 5000) AS long, CAST(floor(median(chars)) AS BIGINT) AS median_chars, CAST(min(chars) AS BIGINT) AS min_chars FROM p GROUP BY type""",
)
def format_survey(spark: SparkSession, d: str) -> DataFrame:  # A16, M24
    per = chunks(spark, d).groupBy("file_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    rows = files(spark, d).select("type", "file_id").join(per, "file_id", "left").fillna(0, ["chars", "n"])
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    chars = F.col("chars")
    return rows.groupBy("type").agg(
        F.count("*").alias("files"), F.sum("n").alias("chunks"), count(chars < 500, "thin"), count((chars >= 500) & (chars < 5000), "middle"), count(chars >= 5000, "long"),
        F.floor(F.percentile("chars", F.lit(0.5))).alias("median_chars"), F.min("chars").alias("min_chars"),
    )


@query(
    "latency_pctl",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value IS NOT NULL),
v AS (SELECT event_type, list(value ORDER BY value) AS v, avg(value) AS a FROM r WHERE rn <= 100 GROUP BY event_type),
p AS (SELECT *, len(v) AS n FROM v)
SELECT event_type, round(a, 2) AS avg, """
    + ", ".join(
        f"round(CASE WHEN n = 1 THEN v[1] ELSE v[greatest(1, least(CAST(floor((n + 1) * {p / 100}) AS INT), n - 1))] + (v[greatest(1, least(CAST(floor((n + 1) * {p / 100}) AS INT), n - 1)) + 1] - v[greatest(1, least(CAST(floor((n + 1) * {p / 100}) AS INT), n - 1))]) * ((n + 1) * {p / 100} - greatest(1, least(CAST(floor((n + 1) * {p / 100}) AS INT), n - 1))) END, 2) AS p{p}"
        for p in (50, 95, 99)
    )
    + ", round(list_max(v), 2) AS max, n FROM p",
)
def latency_pctl(spark: SparkSession, d: str) -> DataFrame:  # A17, W9
    return an.latency_stats(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], "value")


@query(
    "nearest_pctl",
    "SELECT lang, v[1 + least(len(v) - 1, CAST(floor(len(v) * 0.9) AS INT))] AS p90 FROM (SELECT lang, list(n_chars ORDER BY n_chars) AS v FROM documents GROUP BY lang)",
)
def nearest_pctl(spark: SparkSession, d: str) -> DataFrame:  # A18
    # equal values are counted once, so a large group comes to a few rows for each length
    counts = table(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang").orderBy("n_chars"))
    rows = counts.select("lang", "n_chars", upto.alias("upto"), F.sum("c").over(Window.partitionBy("lang")).alias("n"))
    at = 1 + F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))
    return rows.filter(F.col("upto") >= at).groupBy("lang").agg(F.min("n_chars").alias("p90"))


@query(
    "rolling_latency",
    "SELECT event_id, round(sum(value) OVER w, 4) AS sum_100, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)",
)
def rolling_latency(spark: SparkSession, d: str) -> DataFrame:  # W9
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("sum_100"), F.count("value").over(w).alias("n"))


@query(
    "leaderboard",
    """WITH b AS (SELECT doc_id % 12 AS config, doc_id % 5 AS build, avg(n_chars) AS score FROM documents GROUP BY 1, 2)
SELECT config, round(min(score), 6) AS floor, round(avg(score), 6) AS mean, count(*) AS builds FROM b GROUP BY config""",
)
def leaderboard(spark: SparkSession, d: str) -> DataFrame:  # A20, A22
    per = table(spark, d, "documents").groupBy((F.col("doc_id") % 12).alias("config"), (F.col("doc_id") % 5).alias("build")).agg(F.avg("n_chars").alias("score"))
    return per.groupBy("config").agg(F.round(F.min("score"), 6).alias("floor"), F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("builds"))


@query(
    "macro_micro",
    """WITH c AS (SELECT source, avg(coalesce(quality, 0)) AS m, count(*) AS n, sum(coalesce(quality, 0)) AS s FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM c""",
)
def macro_micro(spark: SparkSession, d: str) -> DataFrame:  # A20, A21
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.coalesce("quality", F.lit(0))
    per = rows.groupBy("source").agg(F.avg(q).alias("m"), F.count("*").alias("n"), F.sum(q).alias("s"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("s") / F.sum("n"), 6).alias("micro"))


@query(
    "routing_confusion",
    "SELECT lang, quality, count(*) AS n, CAST(sum(CASE WHEN toxic = quality THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality",
)
def routing_confusion(spark: SparkSession, d: str) -> DataFrame:  # A23
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum((F.col("toxic") == F.col("quality")).cast("long")).alias("ok"))


_SPANS = """WITH s AS (SELECT user_id AS k, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + event_id % 17 AS b FROM events WHERE value IS NOT NULL)
"""


@query(
    "interval_union",
    _SPANS
    + """, g AS (SELECT k, greatest(0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a))) AS gain FROM s WHERE b > a)
SELECT k, CAST(sum(gain) AS BIGINT) AS covered FROM g GROUP BY k""",
)
def interval_union(spark: SparkSession, d: str) -> DataFrame:  # A25, M17
    a = F.floor("value")
    rows = table(spark, d, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("k"), a.alias("a"), (a + F.col("event_id") % 17).alias("b"))
    return an.interval_union(rows, ["k"], "a", "b")


@query(
    "span_overlap",
    with_views(CHUNKS_SQL)
    + """, s AS (SELECT doc_id AS file_id, doc_id * 37 % 900 + 100 * k AS s, doc_id * 37 % 900 + 100 * k + 60 + k * 200 AS e FROM documents, range(0, 4) r(k))
SELECT c.chunk_id, s.s, s.e, CAST(least(c."end", s.e) - greatest(c."start", s.s) AS BIGINT) AS shared FROM chunks c JOIN s ON c.file_id = s.file_id AND c."start" < s.e AND c."end" > s.s""",
)
def span_overlap(spark: SparkSession, d: str) -> DataFrame:  # J13, M6
    k, base = F.col("k"), F.col("doc_id") * 37 % 900
    spans = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    spans = spans.select(F.col("doc_id").alias("file_id"), (base + k * 100).alias("s"), (base + k * 100 + 60 + k * 200).alias("e"))
    hits = an.overlap_join(chunks(spark, d).select("chunk_id", "file_id", "start", "end"), spans, "file_id", 1024)
    return hits.select("chunk_id", "s", "e", (F.least("end", "e") - F.greatest("start", "s")).alias("shared"))


@query(
    "newest_and_largest",
    with_views(FILES_SQL)
    + """SELECT 'newest' AS list, path FROM (SELECT path FROM files WHERE folder_tag = 'src2' ORDER BY modified_s DESC, path LIMIT 5) UNION ALL
SELECT 'largest', path FROM (SELECT path FROM files WHERE folder_tag = 'src2' ORDER BY size DESC, path LIMIT 5)""",
)
def newest_and_largest(spark: SparkSession, d: str) -> DataFrame:  # T4, D8
    f = files(spark, d).filter("folder_tag = 'src2'").select("path", "modified_s", "size")
    a = f.orderBy(F.desc("modified_s"), "path").limit(5).select(F.lit("newest").alias("list"), "path")
    return a.unionByName(f.orderBy(F.desc("size"), "path").limit(5).select(F.lit("largest").alias("list"), "path"))


@query("history_page", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 25")
def history_page(spark: SparkSession, d: str) -> DataFrame:  # T6
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).offset(25).limit(50).select("event_id", "user_id")


@query(
    "history_last10",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10",
)
def history_last10(spark: SparkSession, d: str) -> DataFrame:  # T6
    return an.top_per(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 10).select("conv_id", "turn", "role")


@query(
    "evict_lru",
    """SELECT event_id FROM (SELECT event_id, sum(1 + event_id % 97) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM events)
WHERE total <= 0.9 * (SELECT sum(1 + event_id % 97) FROM events) / 2""",
)
def evict_lru(spark: SparkSession, d: str) -> DataFrame:  # T8
    e = table(spark, d, "events").select("event_id", "ts", (1 + F.col("event_id") % 97).alias("bytes"))
    limit = e.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] * 0.9 / 2
    return tables.evict(e, "bytes", [F.desc("ts"), F.desc("event_id")], limit).select("event_id")


@query(
    "strip_sample",
    with_views(FILES_SQL)
    + """, n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i, count(*) OVER () AS n FROM files)
SELECT path FROM n WHERE i % CAST(ceil(n / 480.0) AS BIGINT) = 0""",
)
def strip_sample(spark: SparkSession, d: str) -> DataFrame:  # A27
    f = files(spark, d).select("path")
    step = max(1, -(-f.count() // 480))
    return tables.numbered(f, [F.asc("path")], "i").filter((F.col("i") - 1) % step == 0).select("path")


@query(
    "distinct_tags_lcase",
    "SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS tag FROM documents) GROUP BY 1",
)
def distinct_tags_lcase(spark: SparkSession, d: str) -> DataFrame:  # T13, A24, X2: case-blind grouping by collation
    tag = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    rows = table(spark, d, "documents").select(F.collate(tag, "UTF8_LCASE").alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n")).select(F.lower(F.collate("tag", "UTF8_BINARY")).alias("tag"), "n")
