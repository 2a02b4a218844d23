"""Text functions, chunkers, summaries and question routing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, routing, scopes, summaries
from corpusloom.plans.registry import query
from corpusloom.sources.entities import CHUNKS_SQL, FILES_SQL, chunks, files, table, with_views


_WORD_SQL = "coalesce(nullif(regexp_extract(lower(text), '[a-z]+'), ''), 'none')"


def _word():
    """The first run of letters of a text."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower("text"), "[a-z]+", 0), F.lit("")), F.lit("none"))


@query("chunk_fixed", with_views(CHUNKS_SQL) + 'SELECT chunk_id, "start", "end", md5(text) AS digest FROM chunks')
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:  # C6
    return chunks(spark, d).select("chunk_id", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


def _last_end(window: str, separator: str) -> str:
    """SQL: where the last occurrence of a separator ends in a window."""
    return f"length(regexp_extract({window}, '(?s)^.*{re.escape(separator)}'))"


def stream_sql(rows: str, key: str) -> str:
    """SQL of the boundary-seeking chunker over ``rows`` (key, text), whose chunks each start where the one before says."""
    size, overlap = chunking.CHUNK_CHARS, chunking.OVERLAP_CHARS
    reach = int(size * chunking.LOOKBACK_SHARE)
    tests = "".join(f" WHEN contains(w, '{x}') THEN {_last_end('w', x)}" for x in chunking.SEPARATORS)
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT {key}, text AS x, length(text) AS n FROM ({rows}) WHERE {key} IS NOT NULL AND length(text) > 0),
s AS (SELECT {key}, 0::BIGINT AS pos, 0::BIGINT AS seq, CASE WHEN n > {size} THEN substr(x, {size - reach} + 1, {reach}) END AS w FROM t
  UNION ALL SELECT {key}, pos, seq, CASE WHEN n - pos > {size} THEN substr(x, pos + {size - reach} + 1, {reach}) END AS w FROM (
    SELECT {key}, pos + greatest(1, {size - reach - overlap} + CASE{tests} ELSE {reach} END) AS pos, seq + 1 AS seq FROM s WHERE w IS NOT NULL) JOIN t USING ({key}))
SELECT {key}, seq, pos AS start, CASE WHEN w IS NULL THEN n ELSE pos + {size - reach} + CASE{tests} ELSE {reach} END END AS "end" FROM s JOIN t USING ({key}) WHERE w IS NOT NULL OR regexp_matches(substr(x, pos + 1), '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]')"""


@query("chunk_stream", stream_sql("SELECT doc_id, text FROM documents", "doc_id"))
def chunk_stream(spark: SparkSession, d: str) -> DataFrame:  # C1: each cut depends on the one before
    return chunking.stream_chunks(table(spark, d, "documents"), "doc_id", "text", with_text=False)


@query("chunk_routed")
def chunk_routed(spark: SparkSession, d: str) -> DataFrame:  # C2-C5, C7
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return chunking.routed_chunks(files(spark, d).select("file_id", "path", "type").join(docs, "file_id"))


_MODULES = f"""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'import os' || chr(10) || 'from a import b' || chr(10) END AS imports, {_WORD_SQL} AS w FROM documents),
m AS (SELECT doc_id, w, imports, '[PY: doc' || doc_id || '.py] ' AS prefix, '# about ' || w || chr(10) || '@mark' || chr(10) || 'def f_' || w || '():' || chr(10) || '    return 1' AS f, 'class C_' || w || ':' || chr(10) || '    pass' AS c FROM w)"""


@query(
    "code_chunks",
    _MODULES
    + """, p AS (SELECT *, imports || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) END || f || chr(10) || c || chr(10) AS text FROM m WHERE doc_id % 3 <> 0)
SELECT doc_id AS file_id, 0 AS seq, length(imports) + 1 AS "start", length(imports) + 1 + length(f) + 1 AS "end", md5(prefix || chr(10) || imports || chr(10) || f) AS digest FROM p
UNION ALL SELECT doc_id, 1, length(imports) + length(f) + 2, length(imports) + length(f) + length(c) + 3, md5(prefix || chr(10) || c) FROM p
UNION ALL SELECT doc_id, 0, 0, 5 + length(f) + length(c), md5(prefix || chr(10) || 'x (' || chr(10) || f || chr(10) || c) FROM m WHERE doc_id % 3 = 0""",
)
def code_chunks(spark: SparkSession, d: str) -> DataFrame:  # C4, C6: a small module made of each document's first word; a third of them don't parse
    docs = table(spark, d, "documents").withColumn("w", _word())
    f = F.concat(F.lit("# about "), "w", F.lit("\n@mark\ndef f_"), "w", F.lit("():\n    return 1"))
    c = F.concat(F.lit("class C_"), "w", F.lit(":\n    pass"))
    whole = F.concat(F.lit("import os\nfrom a import b\n\n"), f, F.lit("\n"), c, F.lit("\n"))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x (\n"), f, F.lit("\n"), c)).otherwise(whole)
    path = F.concat(F.lit("/corpus/doc"), F.col("doc_id").cast("string"), F.lit(".py"))
    found = chunking.code_chunks(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), text.alias("text")))
    return found.select("file_id", F.col("seq").cast("int").alias("seq"), "start", "end", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(
    "sentence_counts",
    """SELECT doc_id, 1 + len(regexp_extract_all(regexp_replace(text, '([A-Z])', chr(1) || '\\1', 'g'), '[.!?]\\s+\\x01')) AS n FROM documents""",
)
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:  # C8, C9
    return table(spark, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n"))


_BARE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_TAGS = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{_BARE}', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:{tx.INLINE_TAGS})(?:\s[^>]*)?>', '', 'g'), '<[^>]+>', ' ', 'g')"
_ENTITIES = f"""replace(replace(replace(replace(replace(replace({_TAGS}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"""


@query("html_text", rf"SELECT page_id, trim(regexp_replace({_ENTITIES}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS text FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:  # X14, S14
    return table(spark, d, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query(
    "squashed_text",
    "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS digest FROM documents",
)
def squashed_text(spark: SparkSession, d: str) -> DataFrame:  # X1
    return table(spark, d, "documents").select("doc_id", F.md5(tx.squashed(F.col("text")).cast("binary")).alias("digest"))


@query(
    "path_parts",
    with_views(FILES_SQL)
    + """SELECT path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS suffix, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem,
  '[' || upper(type) || ': ' || regexp_extract(path, '[^/]*$') || '] ' AS prefix FROM files""",
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:  # X3, R8
    p = F.col("path")
    return files(spark, d).select("path", scopes.basename(p).alias("name"), scopes.suffix(p).alias("suffix"), scopes.stem(p).alias("stem"), tx.context_prefix(p).alias("prefix"))


@query(
    "prefix_round_trip",
    with_views(FILES_SQL) + "SELECT f.file_id, md5(d.text) AS digest FROM files f JOIN documents d ON d.doc_id = f.file_id",
)
def prefix_round_trip(spark: SparkSession, d: str) -> DataFrame:  # R8
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    rows = files(spark, d).select("file_id", "path").join(docs, "file_id")
    stored = F.concat(tx.context_prefix(F.col("path")), F.col("text"))
    return rows.select("file_id", F.md5(tx.without_prefix(stored, F.col("path")).cast("binary")).alias("digest"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query(
    "keywords",
    f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'), lambda w: w NOT IN ({_STOP}) AND length(w) > 2), ' ') AS kw FROM benchmark",
)
def keywords(spark: SparkSession, d: str) -> DataFrame:  # X4, R19
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.keywords(F.col("text")), " ").alias("kw"))


@query(
    "match_terms",
    """SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(text, '(?i)["*^]|\\bAND\\b|\\bOR\\b|\\bNOT\\b|\\bNEAR\\b', ' ', 'g')), '\\s+'), lambda w: length(w) >= 3))), ' OR ') AS expr FROM benchmark""",
)
def match_terms(spark: SparkSession, d: str) -> DataFrame:  # R1
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.match_terms(F.col("text")), " OR ").alias("expr"))


@query(
    "text_hygiene",
    """SELECT doc_id, round(length(regexp_replace(text, '[\\p{L}\\p{N}\\s.,;:!?''"()\\[\\]/%&+-]', '', 'g')) / length(text), 6) AS garbage,
  round(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: length(w) BETWEEN 1 AND 2)) / len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')), 6) AS fragments FROM documents WHERE length(text) > 0""",
)
def text_hygiene(spark: SparkSession, d: str) -> DataFrame:  # X15, X16
    rows = table(spark, d, "documents").filter(F.length("text") > 0)
    return rows.select("doc_id", F.round(tx.garbage_ratio(F.col("text")), 6).alias("garbage"), F.round(tx.fragmentation(F.col("text")), 6).alias("fragments"))


@query(
    "page_class",
    """WITH s AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[\\p{L}\\p{N}\\s.,;:!?''"()\\[\\]/%&+-]', '', 'g')) / greatest(length(text), 1) AS g FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'BLANK' WHEN n < 40 AND doc_id % 2 = 0 THEN 'OCR' WHEN n < 10 THEN 'BLANK' WHEN g > 0.2 THEN 'OCR' ELSE 'NATIVE' END AS class FROM s""",
)
def page_class(spark: SparkSession, d: str) -> DataFrame:  # X17
    rows = table(spark, d, "documents")
    state = routing.page_class(F.col("text"), F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", state.alias("class"))


@query(
    "digests",
    "SELECT doc_id, sha256(text) AS sha, floor(log10(greatest(n_chars, 1))) AS magnitude, CAST(n_chars // 1024 AS VARCHAR) || ' KB' AS human FROM documents",
)
def digests(spark: SparkSession, d: str) -> DataFrame:  # X7, X9, X10
    n = F.col("n_chars")
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.floor(F.log10(F.greatest(n, F.lit(1)))).cast("double").alias("magnitude"), F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB")).alias("human")
    )


@query(
    "log_safe",
    "SELECT doc_id, md5(replace(replace(text, chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n')) AS digest FROM documents",
)
def log_safe(spark: SparkSession, d: str) -> DataFrame:  # X23
    return table(spark, d, "documents").select("doc_id", F.md5(tx.log_safe(F.col("text")).cast("binary")).alias("digest"))


@query(
    "json_fields",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(json_keys(props), ',') AS names, '{"v":' || json_extract_string(props, '$.k') || '}' AS renamed, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events""",
)
def json_fields(spark: SparkSession, d: str) -> DataFrame:  # X11, X12
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        "event_id", k.alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("names"), F.to_json(F.struct(k.alias("v"))).alias("renamed"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp("ts").alias("epoch"),
    )


@query(
    "array_ops",
    """WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), u AS (SELECT item_id, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM w)
SELECT item_id, array_to_string(u[1:5], ' ') AS head, len(u) AS n, list_contains(u, 'the') AS the, array_to_string(list_sort(u), ' ') AS sorted FROM u""",
)
def array_ops(spark: SparkSession, d: str) -> DataFrame:  # X20, X21
    u = F.array_distinct(F.split(F.lower("text"), " "))
    return table(spark, d, "benchmark").select(
        "item_id", F.array_join(F.slice(u, 1, 5), " ").alias("head"), F.size(u).cast("long").alias("n"), F.array_contains(u, "the").alias("the"), F.array_join(F.array_sort(u), " ").alias("sorted")
    )


@query(
    "most_common_words",
    """WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id, string_agg(w || ':' || n, ',' ORDER BY n DESC, w) AS top FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, w) AS r FROM c) WHERE r <= 3 GROUP BY item_id""",
)
def most_common_words(spark: SparkSession, d: str) -> DataFrame:  # X21
    from corpusloom.operators.analytics import top_per

    c = table(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))
    top = top_per(c, ["item_id"], [F.desc("n"), F.asc("w")], 3, "r")
    ordered = F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "w", F.col("n").cast("string")).alias("t"))))
    return top.groupBy("item_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("top"))


_QUESTIONS = """q AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'how many files do i have' WHEN 1 THEN 'what calls parse_config()' WHEN 2 THEN 'show project summary' WHEN 3 THEN 'latest notes on ' || source
  WHEN 4 THEN 'largest file in ' || lang WHEN 5 THEN 'what is in my index about kinetics' WHEN 6 THEN 'impact of caffeine' ELSE substr(text, 1, 60) END AS question FROM documents)"""


@query(
    "routing_intents",
    "WITH "
    + _QUESTIONS
    + ", "
    + f"""i AS (SELECT doc_id, regexp_matches(question, '{tx.LATEST}') AS latest, regexp_matches(question, '{tx.LARGEST}') AS largest, regexp_matches(lower(question), '{tx.PROJECT}') AS project,
  regexp_matches(lower(question), '{tx.METADATA}') AS metadata, regexp_matches(question, '{tx.GRAPH}') AND regexp_matches(question, '{tx.CODE_SIGNAL}') AS graph, contains(lower(question), 'how many files') AS counted FROM q)
SELECT doc_id, latest, largest, project, metadata, graph, latest OR largest OR counted AS inventory FROM i""",
)
def routing_intents(spark: SparkSession, d: str) -> DataFrame:  # R19, X5
    rows = table(spark, d, "documents").select("doc_id", _question().alias("question"))
    return rows.select("doc_id", *routing.intents(F.col("question")))


def _question() -> F.Column:
    n = F.col("doc_id") % 8
    return (
        F.when(n == 0, "how many files do i have").when(n == 1, "what calls parse_config()").when(n == 2, "show project summary").when(n == 3, F.concat(F.lit("latest notes on "), "source"))
        .when(n == 4, F.concat(F.lit("largest file in "), "lang")).when(n == 5, "what is in my index about kinetics").when(n == 6, "impact of caffeine").otherwise(F.substring("text", 1, 60))
    )


@query("routing_modes")
def routing_modes(spark: SparkSession, d: str) -> DataFrame:  # R19: tests compare with labelled questions
    rows = table(spark, d, "documents").select("doc_id", _question().alias("question"))
    return rows.select("doc_id", routing.mode(F.col("question")).alias("mode"))


@query(
    "model_class",
    """WITH m AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'llama-' || (c_custkey % 70) || 'b-chat' WHEN 1 THEN 'qwen2.5-' || (c_custkey % 9) || '.5B' WHEN 2 THEN 'big-mini' WHEN 3 THEN 'x-small-8b' ELSE 'cloud-pro' END AS name FROM customer),
s AS (SELECT *, list_min(list_transform(regexp_extract_all(lower(name), '(\\d+(?:\\.\\d+)?)b', 1), lambda x: CAST(x AS DOUBLE))) AS b FROM m)
SELECT c_custkey, CASE WHEN b < 4 THEN '3b_local' WHEN b IS NOT NULL THEN '7b_local' WHEN regexp_matches(name, 'mini|small') THEN 'small_cloud' ELSE 'large_cloud' END AS class FROM s""",
)
def model_class(spark: SparkSession, d: str) -> DataFrame:  # R24, X19
    key = F.col("c_custkey")
    name = F.when(key % 5 == 0, F.concat(F.lit("llama-"), (key % 70).cast("string"), F.lit("b-chat"))).when(key % 5 == 1, F.concat(F.lit("qwen2.5-"), (key % 9).cast("string"), F.lit(".5B"))).when(key % 5 == 2, "big-mini").when(key % 5 == 3, "x-small-8b").otherwise("cloud-pro")
    return table(spark, d, "customer").select("c_custkey", routing.model_class(name).alias("class"))


@query(
    "markdown_outline",
    """SELECT doc_id, 'Structure: ' || array_to_string(regexp_extract_all('# ' || replace(text, chr(10), chr(10) || '## '), '(?m)^#+[ ]+(.*)', 1)[1:6], ' > ') AS outline FROM documents""",
)
def markdown_outline(spark: SparkSession, d: str) -> DataFrame:  # C12
    as_markdown = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return table(spark, d, "documents").select("doc_id", summaries.outline(as_markdown).alias("outline"))


@query(
    "json_summary",
    "SELECT event_id, 'Keys: ' || array_to_string(json_keys(props)[1:15], ', ') || ' (total ' || len(json_keys(props)) || ')' AS summary FROM events",
)
def json_summary(spark: SparkSession, d: str) -> DataFrame:  # C13, C14
    return table(spark, d, "events").select("event_id", summaries.json_keys(F.col("props")).alias("summary"))


@query(
    "file_summaries",
    with_views(FILES_SQL).rstrip()
    + r""", h AS (SELECT file_id, path, type, substr(text, 1, 2000) AS t FROM files JOIN (SELECT doc_id AS file_id, text FROM documents) USING (file_id)),
f AS (SELECT *, regexp_extract_all(t, '(?m)^\s*(?:class|def|function|fn|struct)\s+(\w+)', 1) AS names FROM h),
s AS (SELECT file_id, path, substr(CASE type WHEN 'md' THEN 'Structure: ' || array_to_string(regexp_extract_all(t, '(?m)^#+[ ]+(.*)', 1)[1 : 6], ' > ')
  WHEN 'py' THEN 'Symbols: ' || array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i)[1 : 15], ', ')
  WHEN 'csv' THEN 'Columns: ' || array_to_string(list_transform(string_split(string_split(t, chr(10))[1], ','), lambda c: trim(c, ' ')), ', ')
  ELSE trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') END, 1, 300) AS summary FROM f),
p AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem,
  trim(regexp_replace(regexp_replace(summary, '^(?:\[[^\]]*\]\s*)?(?:Structure|Keys|Symbols|Columns):\s*', ''), '[>,\s]+', ' ', 'g'), ' ') AS plain FROM s)
SELECT file_id, summary, CASE WHEN contains(lower(plain), lower(stem)) THEN plain ELSE concat_ws(' ', stem, plain) END AS embedding_text FROM p""",
)
def file_summaries(spark: SparkSession, d: str) -> DataFrame:  # C10, C11, C15
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return summaries.summarise(files(spark, d).select("file_id", "path", "type").join(docs, "file_id"))


@query(
    "cleaned_replies",
    """SELECT conv_id, turn, CASE conv_id % 4 WHEN 3 THEN md5('') ELSE md5(trim(replace(text, chr(10), ' '))) END AS digest FROM conversations""",
)
def cleaned_replies(spark: SparkSession, d: str) -> DataFrame:  # C18
    flat, n = F.replace("text", F.lit("\n"), F.lit(" ")), F.col("conv_id") % 4
    reply = F.when(n == 0, F.concat(F.lit("```text\n"), flat, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here is the transcription: "), flat)).when(n == 2, flat).otherwise(F.concat(F.lit("There is no text. "), flat))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.cleaned_reply(reply).cast("binary")).alias("digest"))
