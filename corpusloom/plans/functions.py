"""Queries in SQL over table functions: chunkers, office files and code."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tables as functions
from corpusloom.operators import tables
from corpusloom.plans.registry import query
from corpusloom.plans.texts import stream_sql
from corpusloom.sources.entities import table


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    functions.register(spark)
    return tables.sql(spark, text, {}, **frames)


@query("sql_stream_chunks", f"SELECT doc_id, seq, start, \"end\" FROM ({stream_sql('SELECT doc_id, text FROM documents', 'doc_id')})")
def sql_stream_chunks(spark: SparkSession, d: str) -> DataFrame:  # C1
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _sql(spark, "SELECT d.doc_id, c.seq, c.start, c.`end` FROM {docs} d, LATERAL stream_chunks(d.text) c WHERE d.doc_id IS NOT NULL", docs=docs)


_TALKS = "SELECT conv_id AS file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query("sql_fragment_chunks", stream_sql(_TALKS, "file"))
def sql_fragment_chunks(spark: SparkSession, d: str) -> DataFrame:  # C1, C16: a conversation's chunks from its turns in order
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("fragment"))
    return _sql(spark, "SELECT * FROM fragment_chunks(TABLE(SELECT * FROM {turns}) PARTITION BY file ORDER BY turn)", turns=turns)


_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_SNAP = f"""CASE WHEN w IS NULL THEN n ELSE CASE WHEN regexp_matches(w, '[.!?]{_SPACE}|\\n') THEN pos + 440 + greatest(length(regexp_extract(w, '(?s)^(.*[.!?]){_SPACE}', 1)), length(regexp_extract(w, '(?s)^.*\\n'))) ELSE pos + 600 END END"""


@query(
    "sql_snapped_chunks",
    f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, text AS x, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, 0::BIGINT AS seq, 0::BIGINT AS pos, n, CASE WHEN n > 600 THEN substr(x, 441, 160) END AS w FROM t
  UNION ALL SELECT doc_id, seq, e AS pos, t.n, CASE WHEN t.n - e > 600 THEN substr(x, e + 441, 160) END AS w FROM (SELECT doc_id, seq + 1 AS seq, {_SNAP} AS e FROM s) JOIN t USING (doc_id) WHERE e < t.n)
SELECT doc_id, seq, pos AS start, {_SNAP} AS "end" FROM s""",
)
def sql_snapped_chunks(spark: SparkSession, d: str) -> DataFrame:  # C2
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _sql(spark, "SELECT d.doc_id, c.seq, c.start, c.`end` FROM {docs} d, LATERAL snapped_chunks(d.text, 600) c", docs=docs)


@query(
    "sql_definitions",
    """WITH n AS (SELECT doc_id, 'w' || doc_id AS a, '// ' || replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), chr(10) || '// ') || chr(10) AS head, doc_id % 2 = 0 AS js FROM documents),
p AS (SELECT *, CASE WHEN js THEN 'export function ' || a || '() {}' ELSE 'pub fn ' || a || '() {}' END || chr(10) AS f, CASE WHEN js THEN 'class T {}' ELSE 'struct T;' END || chr(10) AS c FROM n)
SELECT doc_id, unnest([{'name': '<preamble>', 'start': 0, 'end': length(head)}, {'name': a, 'start': length(head), 'end': length(head) + length(f)},
  {'name': 'T', 'start': length(head) + length(f), 'end': length(head) + length(f) + length(c)}], recursive := true) FROM p""",
)
def sql_definitions(spark: SparkSession, d: str) -> DataFrame:  # C5: programs under each document's text as a comment
    head = F.concat(F.lit("// "), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit("\n// ")), F.lit("\n"))
    name, js = F.concat(F.lit("w"), F.col("doc_id").cast("string")), F.col("doc_id") % 2 == 0
    body = F.when(js, F.concat(F.lit("export function "), name, F.lit("() {}\nclass T {}\n"))).otherwise(F.concat(F.lit("pub fn "), name, F.lit("() {}\nstruct T;\n")))
    code = table(spark, d, "documents").select("doc_id", F.when(js, "js").otherwise("rs").alias("language"), F.concat(head, body).alias("text"))
    return _sql(spark, "SELECT f.doc_id, c.* FROM {code} f, LATERAL definition_chunks(f.text, f.language) c", code=code)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _p(text: str, style: str = "") -> str:
    return f'<p><pPr><pStyle val="{style}"/></pPr><r><t>{text}</t></r></p>'


def _docx(i: int, text: str) -> bytes:
    return _zipped({"word/document.xml": f"<d><body>{_p(f'Document {i}', 'Heading2')}{_p(text)}<tbl><tr><tc>{_p('id')}</tc><tc>{_p(str(i))}</tc></tr></tbl></body></d>"})


def _xlsx(i: int, text: str) -> bytes:
    sheet = f'<w><sheetData><row><c t="s"><v>0</v></c><c><v>{i}</v></c></row></sheetData></w>'
    return _zipped({"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": f"<sst><si><t>{text}</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})


def _pptx(i: int, text: str) -> bytes:
    return _zipped({"ppt/slides/slide1.xml": f"<s>{_p(f'Document {i}')}{_p(text)}</s>", "ppt/notesSlides/notesSlide1.xml": f"<s>{_p(f'note {i}')}</s>"})


def _epub(i: int, text: str) -> bytes:
    package = '<package><manifest><item id="b" href="two.html"/><item id="a" href="one.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    pages = {"o/one.html": f"<html><script>no</script><body><p>{text}</p></body></html>", "o/two.html": f"<p>short {i}</p>"}
    return _zipped({"META-INF/container.xml": '<c><rootfile full-path="o/content.opf"/></c>', "o/content.opf": package, **pages})


_OFFICE = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "epub": _epub}


def _office_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A file for each document, its type by the id."""
    kinds = list(_OFFICE)
    for rows in batches:
        if len(rows):
            names = [kinds[i % 4] for i in rows["doc_id"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "type": names, "content": [_OFFICE[k](i, t) for k, i, t in zip(names, rows["doc_id"], rows["text"], strict=True)]})


@query(
    "office_text",
    """WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9.,]+', ' ', 'g')) AS t, chr(10) AS l FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, ['docx', 'xlsx', 'pptx', 'epub'][doc_id % 4 + 1] AS type, CASE doc_id % 4
  WHEN 0 THEN '## Document ' || doc_id || l || CASE WHEN t = '' THEN '' ELSE t || l END || 'id | ' || doc_id
  WHEN 1 THEN '--- Sheet: S ---' || l || t || ' | ' || doc_id
  WHEN 2 THEN '--- Slide 1 ---' || l || 'Document ' || doc_id || l || CASE WHEN t = '' THEN '' ELSE t || l END || '[Notes]' || l || 'note ' || doc_id
  ELSE CASE WHEN length(t) > 50 THEN t ELSE '' END END AS text FROM t)
SELECT doc_id, type, length(text) AS chars, md5(text) AS digest FROM x""",
)
def office_text(spark: SparkSession, d: str) -> DataFrame:  # S11-S14, S17: office files made of the documents, and their text
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9.,]+", " "))
    made = table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", plain.alias("text"))
    made = made.mapInPandas(_office_files, "doc_id long, type string, content binary")
    return _sql(spark, "SELECT f.doc_id, f.type, length(t.text) AS chars, md5(t.text) AS digest FROM {files} f, LATERAL extracted(f.type, f.content) t", files=made)
