"""Queue and cache state queries, over rows synthesised from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import state as st
from corpusloom.plans.registry import query
from corpusloom.sources.entities import table

NOW = 1_706_600_000
_Q = """q AS (SELECT 'f' || event_id AS file_path, CASE event_id % 6 WHEN 5 THEN '[]' WHEN 4 THEN '[3]' ELSE '[1,2,' || (event_id % 9 + 3) || ']' END AS pages_json, CASE event_id % 6 WHEN 5 THEN 0 WHEN 4 THEN 1 ELSE 3 END AS np,
  event_id % 4 AS pages_done, ['pending', 'running', 'done', 'failed', 'skipped', 'odd'][1 + event_id % 6] AS raw, event_id % 5 AS attempts, 1706500000 + event_id * 37 % 90000 AS enqueued_at, 1706500000 + event_id * 53 % 100000 AS updated_at FROM events),
s AS (SELECT *, CASE WHEN raw = 'odd' THEN 'pending' ELSE raw END AS status FROM q)"""


def _queue(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    pages = F.when(n % 6 == 5, "oops").when(n % 6 == 4, "[3]").otherwise(F.concat(F.lit("[1,2,"), (n % 9 + 3).cast("string"), F.lit("]")))
    status = F.get(F.array(*[F.lit(x) for x in (*st.STATES, "odd")]), (n % 6).cast("int"))
    raw = table(spark, d, "events").select(
        F.concat(F.lit("f"), n.cast("string")).alias("file_path"), pages.alias("pages_json"), F.lit(9).alias("page_count"), (n % 4).cast("int").alias("pages_done"), F.lit("cpu").alias("tier"), status.alias("status"),
        F.lit(False).alias("force"), (n % 5).cast("int").alias("attempts"), F.lit("e").alias("last_error"), (1706500000 + n * 37 % 90000).alias("enqueued_at"), (1706500000 + n * 53 % 100000).alias("updated_at"),
    )
    fields = [f.split()[0] for f in st.QUEUE.split(", ")]
    return st.decoded(raw).select(*fields)


@query("queue_counts", f"WITH {_Q} SELECT status, count(*) AS n, CAST(sum(CASE WHEN status IN ('pending', 'running') THEN greatest(np - pages_done, 0) ELSE 0 END) AS BIGINT) AS owed FROM s GROUP BY status")
def queue_counts(spark: SparkSession, d: str) -> DataFrame:  # A11, Q5
    return st.counts(_queue(spark, d))


@query(
    "queue_claim",
    f"""WITH {_Q}, c AS (SELECT file_path FROM s WHERE (status = 'pending' OR (status = 'running' AND updated_at <= {NOW} - 900)) AND attempts < 3 ORDER BY enqueued_at, file_path LIMIT 25)
SELECT file_path, file_path IN (SELECT file_path FROM c) AS claimed, CASE WHEN file_path IN (SELECT file_path FROM c) THEN 'running' ELSE status END AS status,
  CAST(attempts + CASE WHEN file_path IN (SELECT file_path FROM c) THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM s""",
)
def queue_claim(spark: SparkSession, d: str) -> DataFrame:  # Q2
    return st.claim(_queue(spark, d), NOW, n=25).select("file_path", "claimed", "status", "attempts")


@query(
    "queue_enqueue",
    f"""WITH {_Q}, a AS (SELECT 'f' || (event_id * 3) AS file_path, [event_id % 7, 2, 2] AS p FROM events WHERE event_id % 10 <> 0)
SELECT file_path, array_to_string(list_sort(list_distinct(p)), ',') AS pages, 'pending' AS status, CAST(0 AS INTEGER) AS attempts, coalesce(s.enqueued_at, {NOW}) AS enqueued_at FROM a LEFT JOIN s USING (file_path) UNION ALL
SELECT file_path, CASE WHEN np = 0 THEN '' ELSE replace(trim(pages_json, '[]'), ' ', '') END, status, CAST(attempts AS INTEGER), enqueued_at FROM s WHERE file_path NOT IN (SELECT file_path FROM a)""",
)
def queue_enqueue(spark: SparkSession, d: str) -> DataFrame:  # Q1, P6
    n = F.col("event_id")
    pages = F.when(n % 10 == 0, F.array().cast("array<int>")).otherwise(F.array((n % 7).cast("int"), F.lit(2), F.lit(2)))
    asked = table(spark, d, "events").select(F.concat(F.lit("f"), (n * 3).cast("string")).alias("file_path"), pages.alias("pages"), F.lit(9).alias("page_count"), F.lit("cpu").alias("tier"), F.lit(True).alias("force"), n.alias("seq"))
    out = st.enqueue(_queue(spark, d), asked, NOW)
    return out.select("file_path", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "status", "attempts", "enqueued_at")


@query(
    "queue_verdicts",
    f"""WITH {_Q}, v AS (SELECT file_path, ['progress', 'done', 'failed', 'skipped', 'release', 'requeue', 'failed'][1 + CAST(substr(file_path, 2) AS BIGINT) % 7] AS v, CAST(substr(file_path, 2) AS BIGINT) % 14 = 6 AS t FROM s WHERE CAST(substr(file_path, 2) AS BIGINT) % 3 <> 0),
j AS (SELECT s.*, v, t, v IS NOT NULL AND (status = 'running' OR v = 'requeue') AS hit FROM s LEFT JOIN v USING (file_path))
SELECT file_path, CASE WHEN NOT hit THEN status WHEN v = 'progress' THEN 'running' WHEN v IN ('done', 'skipped') THEN v WHEN v IN ('release', 'requeue') THEN 'pending' WHEN t THEN 'failed' ELSE 'pending' END AS status,
  CAST(CASE WHEN hit AND v = 'progress' THEN greatest(pages_done, 2) WHEN hit AND v = 'done' THEN np ELSE pages_done END AS INTEGER) AS pages_done,
  CAST(CASE WHEN hit AND v = 'release' THEN greatest(0, attempts - 1) WHEN hit AND v = 'requeue' THEN 0 ELSE attempts END AS INTEGER) AS attempts,
  CASE WHEN hit AND v IN ('failed', 'skipped') THEN length(repeat('x', 500)) WHEN hit AND v IN ('done', 'requeue') THEN 0 ELSE 1 END AS error_chars FROM j""",
)
def queue_verdicts(spark: SparkSession, d: str) -> DataFrame:  # Q3, Q4
    q = _queue(spark, d)
    n = F.substring("file_path", 2, 20).cast("long")
    names = F.array(*[F.lit(x) for x in ("progress", "done", "failed", "skipped", "release", "requeue", "failed")])
    v = q.filter(n % 3 != 0).select("file_path", F.get(names, (n % 7).cast("int")).alias("verdict"), F.lit(2).alias("pages_done"), F.repeat(F.lit("x"), 700).alias("error"), (n % 14 == 6).alias("terminal"))
    return st.apply_verdicts(q, v, NOW).select("file_path", "status", "pages_done", "attempts", F.length("last_error").alias("error_chars"))


@query("queue_reset", f"WITH {_Q} SELECT file_path, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' THEN {NOW} ELSE updated_at END AS updated_at FROM s")
def queue_reset(spark: SparkSession, d: str) -> DataFrame:  # Q4
    return st.reset_running(_queue(spark, d), NOW).select("file_path", "status", "updated_at")


@query("queue_page", f"WITH {_Q} SELECT file_path, status FROM s WHERE status = 'pending' ORDER BY updated_at DESC, file_path LIMIT 500 OFFSET 10")
def queue_page(spark: SparkSession, d: str) -> DataFrame:  # Q5, T6
    return _queue(spark, d).filter("status = 'pending'").orderBy(F.desc("updated_at"), "file_path").offset(10).limit(500).select("file_path", "status")


_C = "c AS (SELECT sha256('k' || (event_id % 400)) AS content_key, event_id % 5 AS page_num, min(100 + event_id % 900) AS bytes, max(event_id) AS last_used_at FROM events GROUP BY 1, 2)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    key = F.sha2(F.concat(F.lit("k"), (n % 400).cast("string")).cast("binary"), 256)
    rows = table(spark, d, "events").groupBy(key.alias("content_key"), (n % 5).alias("page_num")).agg(F.min(100 + n % 900).alias("bytes"), F.max("event_id").alias("last_used_at"))
    return rows.select("content_key", "page_num", F.lit("m1").alias("model_version"), F.lit("p1").alias("preproc_hash"), "bytes", "last_used_at")


@query(
    "cache_hits",
    f"WITH {_C}, w AS (SELECT sha256('k' || (event_id % 1000)) AS k, event_id % 3 AS p FROM events) SELECT content_key, page_num, {NOW} AS last_used_at FROM c WHERE EXISTS (SELECT 1 FROM w WHERE k = content_key AND p = page_num)",
)
def cache_hits(spark: SparkSession, d: str) -> DataFrame:  # Q6
    n = F.col("event_id")
    key = F.sha2(F.concat(F.lit("k"), (n % 1000).cast("string")).cast("binary"), 256)
    wanted = table(spark, d, "events").select(key.alias("content_key"), (n % 3).alias("page_num"), F.lit("m1").alias("model_version"), F.lit("p1").alias("preproc_hash"))
    return st.cache_hits(_cache(spark, d), wanted).select("content_key", "page_num", F.lit(NOW).alias("last_used_at"))


@query(
    "cache_write",
    f"""WITH {_C}, n AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'bad' ELSE sha256('k' || c_custkey) END AS content_key, c_custkey % 5 AS page_num, c_custkey AS bytes FROM customer WHERE NOT (c_custkey % 7 = 0 AND c_custkey % 2 = 0)),
o AS (SELECT * FROM n WHERE content_key <> 'bad')
SELECT content_key, page_num, bytes, (SELECT CAST(sum(o.bytes - coalesce(c.bytes, 0)) AS BIGINT) FROM o LEFT JOIN c USING (content_key, page_num)) AS delta FROM (
  SELECT content_key, page_num, bytes FROM o UNION ALL SELECT content_key, page_num, bytes FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.content_key = c.content_key AND o.page_num = c.page_num))""",
)
def cache_write(spark: SparkSession, d: str) -> DataFrame:  # Q7, Q8, A12
    n = F.col("c_custkey")
    key = F.when(n % 9 == 0, "bad").otherwise(F.sha2(F.concat(F.lit("k"), n.cast("string")).cast("binary"), 256))
    new = table(spark, d, "customer").select(
        key.alias("content_key"), (n % 5).alias("page_num"), F.lit("m1").alias("model_version"), F.lit("p1").alias("preproc_hash"), n.alias("bytes"), F.lit(NOW).cast("long").alias("last_used_at"),
        F.when(n % 7 == 0, "timeout").alias("error"), (n % 2).alias("lines"),
    )
    after, delta = st.cache_put(_cache(spark, d), new)
    return after.join(F.broadcast(delta), how="cross").select("content_key", "page_num", "bytes", "delta")  # one row


@query(
    "page_ranges",
    """WITH p AS (SELECT DISTINCT user_id, event_id % 60 AS page FROM events), g AS (SELECT user_id, page, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM p),
r AS (SELECT user_id, min(page) AS a, max(page) AS b FROM g GROUP BY user_id, g), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM r)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) FILTER (rn <= 6) || CASE WHEN any_value(n) > 6 THEN ' (+' || (any_value(n) - 6) || ' more)' ELSE '' END AS ranges FROM n GROUP BY user_id""",
)
def page_ranges(spark: SparkSession, d: str) -> DataFrame:  # W14
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 60).alias("page"))
    return st.page_ranges(rows, "user_id", "page", 6)


@query(
    "line_clusters",
    """WITH b AS (SELECT user_id, event_id, event_id * 31 % 700 AS x, event_id * 17 % 300 AS y, 40 + event_id % 50 AS w, 8 + event_id % 6 AS h FROM events),
l AS (SELECT *, sum(CASE WHEN d > ph * 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY y + h / 2.0, x, event_id ROWS UNBOUNDED PRECEDING) AS line FROM (
  SELECT *, y + h / 2.0 - lag(y + h / 2.0) OVER o AS d, lag(h) OVER o AS ph FROM b WINDOW o AS (PARTITION BY user_id ORDER BY y + h / 2.0, x, event_id)))
SELECT user_id, CAST(max(line) + 1 AS BIGINT) AS n_lines FROM l GROUP BY user_id""",
)
def line_clusters(spark: SparkSession, d: str) -> DataFrame:  # W13
    n = F.col("event_id")
    boxes = table(spark, d, "events").select("user_id", n, (n * 31 % 700).alias("x"), (n * 17 % 300).alias("y"), (40 + n % 50).alias("w"), (8 + n % 6).alias("h"))
    return st.clustered_lines(boxes, "user_id").groupBy("user_id").agg((F.max("line") + 1).alias("n_lines"))


@query(
    "page_text",
    """WITH l AS (SELECT user_id AS doc, event_id // 1000 AS page, event_id, 'w' || event_id AS t, (event_id * 37 % 101) / 101.0 AS c FROM events)
SELECT doc, page, md5(coalesce(string_agg(t, chr(10) ORDER BY event_id) FILTER (c >= 0.5), '')) AS digest, round(avg(c) FILTER (c >= 0.5), 4) AS mean_conf FROM l GROUP BY doc, page""",
)
def page_text(spark: SparkSession, d: str) -> DataFrame:  # C16, C17, A28
    n = F.col("event_id")
    line = F.struct(n.alias("n"), F.concat(F.lit("w"), n.cast("string")).alias("t"), ((n * 37 % 101) / 101.0).alias("c"))
    # a page has a thousand lines at most
    pages = table(spark, d, "events").groupBy(F.col("user_id").alias("doc"), F.floor(n / 1000).alias("page")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return st.page_text(pages, 0.5).select("doc", "page", F.md5(F.col("text").cast("binary")).alias("digest"), "mean_conf")


@query(
    "length_batches",
    """WITH RECURSIVE k AS (SELECT greatest(1, count(*) // 1000) AS parts FROM documents),
r AS (SELECT doc_id % parts AS part, doc_id, length(text) AS n, row_number() OVER (PARTITION BY doc_id % parts ORDER BY length(text), doc_id) AS i FROM documents, k),
b AS (SELECT part, doc_id, n, i, n AS width, 1 AS held, 0 AS batch FROM r WHERE i = 1
  UNION ALL SELECT r.part, r.doc_id, r.n, r.i, CASE WHEN full_ THEN r.n ELSE greatest(width, r.n) END, CASE WHEN full_ THEN 1 ELSE held + 1 END, CASE WHEN full_ THEN batch + 1 ELSE batch END
  FROM (SELECT b.*, q.doc_id AS next_id, (held + 1) * greatest(width, q.n) > 10240 OR held = 64 AS full_ FROM b JOIN r q ON q.part = b.part AND q.i = b.i + 1) x JOIN r ON r.doc_id = x.next_id)
SELECT part, doc_id, CAST(batch AS BIGINT) AS batch FROM b""",
)
def length_batches(spark: SparkSession, d: str) -> DataFrame:  # W8, P3, P4: a batch closes where the next text no longer fits
    import pandas as pd

    def batch(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, width, held, number = rows.sort_values(["n", "doc_id"]), [], 0, 0, 0
        for n in rows["n"]:
            if held and ((held + 1) * max(width, n) > 10240 or held == 64):
                number, width, held = number + 1, 0, 0
            width, held = max(width, n), held + 1
            out.append(number)
        return pd.DataFrame({"part": key[0], "doc_id": rows["doc_id"], "batch": out})

    # parts of a thousand texts or so: a batch never spans parts
    docs = table(spark, d, "documents")
    parts = max(1, docs.count() // 1000)
    rows = docs.select((F.col("doc_id") % parts).alias("part"), "doc_id", F.length("text").alias("n"))
    return rows.groupBy("part").applyInPandas(batch, "part long, doc_id long, batch long")
