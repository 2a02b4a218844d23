"""Evaluation queries: retrieval metrics, rank statistics, cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import metrics as mt
from corpusloom.plans.registry import CRC_SQL, crc32_sql, query
from corpusloom.sources.entities import CHUNKS_SQL, chunks, table, with_views

_RUN = """r AS (SELECT doc_id // 20 AS query, doc_id // 2 AS id, source AS domain, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
g AS (SELECT DISTINCT doc_id // 20 AS query, doc_id // 2 AS id FROM documents WHERE doc_id % 7 < 2)"""


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    q, i = F.floor(F.col("doc_id") / 20), F.floor(F.col("doc_id") / 2)
    w = Window.partitionBy(q).orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.select(q.alias("query"), i.alias("id"), F.col("source").alias("domain"), F.row_number().over(w).alias("pos"))
    return ranked, docs.filter("doc_id % 7 < 2").select(q.alias("query"), i.alias("id")).distinct()


@query(
    "recall_ndcg_mrr",
    f"""WITH {_RUN}, o AS (SELECT query, id, min(pos) AS pos FROM r GROUP BY query, id),
n AS (SELECT o.query, o.id, row_number() OVER (PARTITION BY o.query ORDER BY pos, o.id) AS rn, g.id IS NOT NULL AS hit FROM o LEFT JOIN g ON g.query = o.query AND g.id = o.id),
p AS (SELECT query, sum(CASE WHEN rn <= 10 AND hit THEN 1 ELSE 0 END) AS hits, count(*) FILTER (rn <= 10) AS shown, min(rn) FILTER (hit) AS first, sum(1 / log2(rn + 1)) FILTER (hit AND rn <= 10) AS dcg FROM n GROUP BY query),
w AS (SELECT query, count(*) AS n FROM g GROUP BY query)
SELECT query, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(hits / shown, 0), 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, 1 + least(n, 10)), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM w LEFT JOIN p USING (query)""",
)
def recall_ndcg_mrr(spark: SparkSession, d: str) -> DataFrame:  # M1-M4, M20, T11
    ranked, relevant = _run(spark, d)
    return mt.retrieval_scores(ranked, relevant, 10)


@query(
    "domain_coverage",
    f"""WITH {_RUN}, e AS (SELECT DISTINCT query, domain FROM r WHERE pos % 3 = 0), s AS (SELECT DISTINCT query, domain FROM r WHERE pos <= 5)
SELECT e.query, round(avg(CASE WHEN s.domain IS NULL THEN 0 ELSE 1 END), 6) AS coverage FROM e LEFT JOIN s ON s.query = e.query AND s.domain = e.domain GROUP BY e.query""",
)
def domain_coverage(spark: SparkSession, d: str) -> DataFrame:  # M5
    ranked, _ = _run(spark, d)
    return mt.domain_coverage(ranked, ranked.filter("pos % 3 = 0"), 5)


_ANSWER = with_views(CHUNKS_SQL).rstrip() + """, c AS (SELECT file_id // 40 AS query, file_id AS file, "start" AS a, "end" AS b FROM chunks),
s AS (SELECT doc_id // 40 AS query, doc_id AS file, doc_id * 13 % 700 AS s, doc_id * 13 % 700 + 150 AS e FROM documents)"""


@query(
    "span_scores",
    _ANSWER
    + """, t AS (SELECT c.query, c.file, c.a, c.b, s.s, s.e, greatest(c.a, s.s) AS x, least(c.b, s.e) AS y FROM c JOIN s ON c.query = s.query AND c.file = s.file AND c.a < s.e AND c.b > s.s),
pr AS (SELECT c.query, avg(CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.query = c.query AND t.file = c.file AND t.a = c.a AND t.b = c.b) THEN 1 ELSE 0 END) AS p FROM c GROUP BY c.query),
u AS (SELECT query, file, s, e, greatest(0, y - greatest(x, coalesce(max(y) OVER (PARTITION BY query, file, s, e ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x))) AS g FROM t),
us AS (SELECT query, file, s, e, sum(g) AS g FROM u GROUP BY ALL),
cv AS (SELECT s.query, avg(coalesce(us.g, 0) / (s.e - s.s)) AS cov, sum(coalesce(us.g, 0)) AS shared, sum(s.e - s.s) AS wanted FROM s LEFT JOIN us ON us.query = s.query AND us.file = s.file AND us.s = s.s AND us.e = s.e GROUP BY s.query),
cu AS (SELECT query, sum(greatest(0, b - greatest(a, coalesce(m, a)))) AS shown FROM (SELECT *, max(b) OVER (PARTITION BY query, file ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c) GROUP BY query)
SELECT cv.query, round(coalesce(p, 0), 6) AS precision, round(cov, 6) AS coverage, round(coalesce(shared / shown, 0), 6) AS char_precision, round(shared / (coalesce(shown, 0) + wanted - shared), 6) AS iou
FROM cv LEFT JOIN pr USING (query) LEFT JOIN cu USING (query)""",
)
def span_scores(spark: SparkSession, d: str) -> DataFrame:  # M6-M8
    c = chunks(spark, d).select(F.floor(F.col("file_id") / 40).alias("query"), F.col("file_id").alias("file"), "start", "end")
    base = F.col("doc_id") * 13 % 700
    s = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 40).alias("query"), F.col("doc_id").alias("file"), base.alias("s"), (base + 150).alias("e"))
    return mt.span_scores(c, s)


@query(
    "boundary_margin",
    _ANSWER
    + """ SELECT s.query, s.file, min(least(s.s - c.a, c.b - s.e)) AS margin FROM s JOIN c ON c.query = s.query AND c.file = s.file AND c.a <= s.s AND c.b >= s.e GROUP BY s.query, s.file""",
)
def boundary_margin(spark: SparkSession, d: str) -> DataFrame:  # M11
    c = chunks(spark, d).select(F.floor(F.col("file_id") / 40).alias("query"), F.col("file_id").alias("file"), "start", "end")
    base = F.col("doc_id") * 13 % 700
    s = table(spark, d, "documents").select(F.col("doc_id").alias("file"), base.alias("s"), (base + 150).alias("e"))
    whole = c.join(s, "file").filter((F.col("start") <= F.col("s")) & (F.col("end") >= F.col("e")))
    return whole.groupBy("query", "file").agg(F.min(F.least(F.col("s") - F.col("start"), F.col("end") - F.col("e"))).alias("margin"))


_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


@query(
    "token_f1",
    f"""WITH c AS (SELECT u.conv_id, u.turn, {_TOKENS.format('u.text')} AS a, {_TOKENS.format('v.text')} AS b FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1),
x AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS t FROM c) GROUP BY ALL), y AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS t FROM c) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS s FROM x JOIN y USING (conv_id, turn, t) GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN len(b) = 0 THEN CASE WHEN len(a) = 0 THEN 1 ELSE 0 END ELSE coalesce(s, 0) / len(b) END, 6) AS token_recall,
  round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN coalesce(s, 0) = 0 THEN 0 ELSE 2 * s / (len(a) + len(b)) END, 6) AS f1 FROM c LEFT JOIN s USING (conv_id, turn)""",
)
def token_f1(spark: SparkSession, d: str) -> DataFrame:  # M10, A26, X6, M25
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("answer")).join(nxt, ["conv_id", "turn"])
    return mt.token_f1(pairs, ["conv_id", "turn"], "answer", "truth")


_RUNS = "SELECT {1}, len(w) AS n, i AS at, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT {1}, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {0}), range(1, len(w) - 3) r(i)"


@query(
    "context_coverage",
    f"""WITH a AS ({_RUNS.format("benchmark", "item_id")}), b AS ({_RUNS.format("documents", "doc_id")}),
p AS (SELECT item_id, doc_id, a.n, a.at, a.at - b.at AS shift, a.at - row_number() OVER (PARTITION BY item_id, doc_id, a.at - b.at ORDER BY a.at) AS part FROM a JOIN b USING (run))
SELECT item_id, doc_id, round(max((long + 4) / n), 6) AS share FROM (SELECT item_id, doc_id, any_value(n) AS n, count(*) AS long FROM p GROUP BY item_id, doc_id, shift, part) GROUP BY item_id, doc_id""",
)
def context_coverage(spark: SparkSession, d: str) -> DataFrame:  # M9, M19: the longest run of an item in each document that shares five words with it
    return mt.coverage(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")


_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


@query(
    "answer_coverage",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_WORDS.format("a.text")} AS w, array_to_string({_WORDS.format("b.text")}, ' ') AS c FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'),
r AS (SELECT conv_id, turn, max(j - i + 1) AS long FROM p, range(1, len(w) + 1) s(i), range(i, len(w) + 1) e(j) WHERE contains(c, array_to_string(w[i : j], ' ')) GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 THEN 0 ELSE coalesce(long, 0) / len(w) END, 6) AS share FROM p LEFT JOIN r USING (conv_id, turn)""",
)
def answer_coverage(spark: SparkSession, d: str) -> DataFrame:  # M9: what a reply holds of the message before, as one run of any length
    c = table(spark, d, "conversations")
    reply = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    pairs = c.filter("role = 'user'").select("conv_id", "turn", "text").join(reply, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(mt.longest_run(F.col("text"), F.col("context")), 6).alias("share"))


_STAT = "WITH d AS (SELECT source, CAST(n_chars AS DOUBLE) AS x, CAST(doc_id * 7919 % 1000 AS DOUBLE) AS y FROM documents)"


@query("pearson", _STAT + " SELECT source, round(corr(x, y), 6) AS r FROM d GROUP BY source HAVING count(*) >= 3")
def pearson(spark: SparkSession, d: str) -> DataFrame:  # M12
    y = (F.col("doc_id") * 7919 % 1000).cast("double")
    return table(spark, d, "documents").groupBy("source").agg(mt.pearson(F.col("n_chars").cast("double"), y).alias("r"))


@query(
    "spearman",
    _STAT
    + """, r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY source ORDER BY y) + (count(*) OVER (PARTITION BY source, y) - 1) / 2 AS ry FROM d)
SELECT source, round(corr(rx, ry), 6) AS rho FROM r GROUP BY source""",
)
def spearman(spark: SparkSession, d: str) -> DataFrame:  # M12, W10
    rows = table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("x"), (F.col("doc_id") * 7919 % 1000).cast("double").alias("y"))
    return mt.spearman(rows, ["source"], "x", "y")


@query(
    "kendall",
    """WITH a AS (SELECT doc_id // 30 AS query, doc_id AS id, row_number() OVER (PARTITION BY doc_id // 30 ORDER BY n_chars DESC, doc_id) AS x, row_number() OVER (PARTITION BY doc_id // 30 ORDER BY doc_id * 7919 % 10007, doc_id) AS y FROM documents),
p AS (SELECT query, id, x, y FROM a WHERE x <= 20 AND y <= 20), n AS (SELECT query, count(*) AS n FROM p GROUP BY query)
SELECT n.query, CASE WHEN n >= 2 THEN round(coalesce(sum(sign(r.y - l.y)), 0) / (n * (n - 1) / 2), 6) END AS tau FROM n LEFT JOIN p l ON l.query = n.query LEFT JOIN p r ON r.query = l.query AND r.x > l.x GROUP BY n.query, n""",
)
def kendall(spark: SparkSession, d: str) -> DataFrame:  # M12, M21
    docs = table(spark, d, "documents")
    q, w = F.floor(F.col("doc_id") / 30), Window.partitionBy(F.floor(F.col("doc_id") / 30))
    by = lambda *order: docs.select(q.alias("query"), F.col("doc_id").alias("id"), F.row_number().over(w.orderBy(*order)).alias("pos"))
    return mt.kendall(by(F.desc("n_chars"), "doc_id"), by(F.col("doc_id") * 7919 % 10007, "doc_id"), 20)


@query(
    "cv_fold_best_k",
    f"""WITH {CRC_SQL}, f AS (SELECT doc_id AS id, CAST({crc32_sql("CAST(doc_id AS VARCHAR)")} AS BIGINT) % 5 AS fold FROM documents, crc),
s AS (SELECT fold, k, sum((id * 31 + k * 17) % 101 / 100.0) AS s, count(*) AS n FROM f, range(1, 10) r(k) GROUP BY fold, k),
m AS (SELECT fold, k, round((sum(s) OVER (PARTITION BY k) - s) / (sum(n) OVER (PARTITION BY k) - n), 6) AS train_mean, round(s / n, 6) AS test_mean FROM s)
SELECT fold, CAST(k AS INTEGER) AS k, train_mean, test_mean FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_mean DESC, k) AS rn FROM m) WHERE rn = 1""",
)
def cv_fold_best_k(spark: SparkSession, d: str) -> DataFrame:  # M13, A21, M22: folds by crc32
    ks = F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), ks)
    score = (F.col("id") * 31 + F.col("k") * 17) % 101 / 100.0
    return mt.crossvalidated(rows.select("id", "k", score.alias("score")))


@query(
    "winners",
    """WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) SELECT source, lang FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY n DESC) AS r FROM s) WHERE r = 1""",
)
def winners(spark: SparkSession, d: str) -> DataFrame:  # M14
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.rank().over(Window.partitionBy("source").orderBy(F.desc("n")))).filter("r = 1").select("source", "lang")


@query(
    "verdicts",
    """WITH s AS (SELECT source, avg(n_chars) AS m, min(n_chars) AS f, count(*) AS n FROM documents GROUP BY source)
SELECT source, CASE WHEN n < 3 THEN 'undecided' WHEN f < 5 THEN 'reject' WHEN m > 2500 THEN 'adopt' ELSE 'keep' END AS verdict FROM s""",
)
def verdicts(spark: SparkSession, d: str) -> DataFrame:  # M15, M16, M23
    s = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("m"), F.min("n_chars").alias("f"), F.count("*").alias("n"))
    return s.select("source", F.when(F.col("n") < 3, "undecided").when(F.col("f") < 5, "reject").when(F.col("m") > 2500, "adopt").otherwise("keep").alias("verdict"))


@query(
    "fixture_matches",
    """WITH q AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 6)) AS need FROM benchmark),
w AS (SELECT item_id, unnest(need) AS word, len(need) AS n FROM q), h AS (SELECT DISTINCT item_id AS doc, unnest(string_split(lower(text), ' ')) AS word FROM benchmark),
m AS (SELECT w.item_id, h.doc, any_value(w.n) AS n, count(*) AS c FROM w JOIN h USING (word) GROUP BY w.item_id, h.doc)
SELECT item_id, count(*) AS matches, count(*) = 1 AS single FROM m WHERE c = n GROUP BY item_id""",
)
def fixture_matches(spark: SparkSession, d: str) -> DataFrame:  # M27, M18: items whose words a record holds, by an inverted index
    b = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w"))
    return mt.matching_records(b.withColumn("need", F.array_distinct(F.filter("w", lambda x: F.length(x) > 6))), "item_id", "need", b.select(F.col("item_id").alias("doc"), "w"), "doc", "w")


@query(
    "corpus_sample",
    "SELECT doc_id, n_chars FROM documents ORDER BY md5('7/' || doc_id), doc_id LIMIT 100",
)
def corpus_sample(spark: SparkSession, d: str) -> DataFrame:  # M26: a seeded sample is the feature
    name = F.md5(F.concat(F.lit("7/"), F.col("doc_id").cast("string")).cast("binary"))
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(name, "doc_id").limit(100)


_WEIGHT = " + ".join(f"CAST(h >= {least} AS INTEGER)" for least in mt.POISSON)


@query(
    "bootstrap_ratio",
    f"""WITH b AS (SELECT doc_id % 4 AS config, doc_id % 25 AS build, avg(length(text) + doc_id % 9) / avg(n_chars) AS ratio FROM documents GROUP BY 1, 2),
h AS (SELECT config, CAST(floor(ratio * 1000) AS BIGINT) AS bin, r, CAST('0x' || substr(md5(config || '/' || build || '/' || r), 1, 8) AS BIGINT) AS h FROM b, range(0, 4001) t(r) WHERE ratio IS NOT NULL),
w AS (SELECT config, r, bin, sum(CASE WHEN r = 0 THEN 1 ELSE {_WEIGHT} END) AS w FROM h GROUP BY ALL),
c AS (SELECT config, r, bin, sum(w) OVER (PARTITION BY config, r ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY config, r) AS total FROM w WHERE w > 0),
m AS (SELECT config, r, min(bin) / 1000.0::DOUBLE AS m FROM c WHERE 2 * upto >= total GROUP BY config, r),
k AS (SELECT config, m, row_number() OVER (PARTITION BY config ORDER BY m, r) AS n, count(*) OVER (PARTITION BY config) AS c FROM m WHERE r > 0)
SELECT m.config, any_value(m.m) AS median, max(k.m) FILTER (n = ceil(c * 25 / 1000)) AS low, max(k.m) FILTER (n = ceil(c * 975 / 1000)) AS high FROM m JOIN k USING (config) WHERE m.r = 0 GROUP BY m.config""",
)
def bootstrap_ratio(spark: SparkSession, d: str) -> DataFrame:  # A19: mergeable resampling of the builds of each config
    builds = table(spark, d, "documents").groupBy((F.col("doc_id") % 4).alias("config"), (F.col("doc_id") % 25).alias("build")).agg(F.avg("n_chars").alias("a"), F.avg(F.length("text") + F.col("doc_id") % 9).alias("b"))
    return mt.poisson_medians(builds.select("config", "build", (F.col("b") / F.col("a")).alias("ratio")), "config", "build", "ratio")
