"""Secret scans with corpus-wide ownership frequency.

Candidate spans come from patterns; their values are hashed and counted over the
corpus by distinct repositories and owners.  A value that many owners share, or many
repositories of one owner, is a copied example; one that stays with a single owner
looks live, unless the value itself is a placeholder.  Every span gets its class.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, checkpointed, slices, table, texts_to_python

#: Kinds in the order of the output; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "url", "jwt")
BASE = 3
_ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
_WORD = re.compile("passw(?:or)?d|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"[0-9a-f]{32,}+")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
_URL = re.compile(r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]{1,80}:([^\s/:@]{3,200})@")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
#: A value that so many distinct owners, or repositories of fewer owners, hold is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
#: What a value made up for show says, and the bits a character below which it is too plain to be a secret.
PLACEHOLDER = "example|sample|dummy|changeme|change_me|placeholder|your|test|xxxx|000000|123456|abcdef"
_PLACEHOLDER = re.compile(PLACEHOLDER)
LEAST_ENTROPY = 2.45
#: example: widely copied; shared: held by two owners; placeholder and live: by one, by the look of the value.
CLASSES = ("live", "shared", "example", "placeholder")
#: Values (about 100 bytes each) up to so many are broadcast; more are joined by shuffle.
BROADCAST_VALUES = 200_000


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all spans, by start and then kind; code points, end exclusive."""
    if not text:
        return []
    out = []
    # case folding can only lengthen a text; it serves as a test for the words
    if _WORD.search(text.lower()):
        out += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 3, m.end(), m[0]) for m in _PEM.finditer(text)]
    if "://" in text:
        out += [(m.start(), 4, m.end(), m[1]) for m in _URL.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 5, m.end(), m[0]) for m in _JWT.finditer(text)]
    return sorted(out)


def placeholder(value: str) -> bool:
    """Whether a value looks made up: telling words, or few distinct characters."""
    shares = [value.count(c) / len(value) for c in set(value)]
    return bool(_PLACEHOLDER.search(value.lower())) or -sum(p * math.log2(p) for p in shares) < LEAST_ENTROPY


_FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, `values` array<string>, plain array<boolean>"


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, counts, digests, ``values``, the hash of each span's value, and ``plain``, whether it looks made up; row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            found = [find(t) for t in batch.column(at).to_pylist()]
            shown = [[f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans] for spans in found]
            base = [",".join(x for x, span in zip(xs, spans, strict=True) if span[1] < BASE) for xs, spans in zip(shown, found, strict=True)]
            columns = {
                **{f"n_{KINDS[i]}": pa.array([sum(s[1] == i for s in spans) for spans in found], pa.int64()) for i in range(BASE)},
                "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([",".join(x) for x in shown], pa.string()),
                "values": pa.array([[hashlib.sha256(v.encode()).hexdigest() for *_, v in spans] for spans in found], pa.list_(pa.string())),
                "plain": pa.array([[placeholder(v) for *_, v in spans] for spans in found], pa.list_(pa.bool_())),
            }
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch(
                [*(batch.column(i) for i in rest), *columns.values()], [*(batch.schema.names[i] for i in rest), *columns]
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return texts_to_python(rows).mapInArrow(run, f"{types}, {_FIELDS}")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, owners, repositories): distinct ones of each value; pre-aggregated, so a hot value is cheap."""
    by_repository = candidates.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row of ``docs``: doc_id, counts, base_sha256, spans, the class of each span and the number of each class.

    ``classes`` names them in the order of ``spans``.  A value held by EXAMPLE_OWNERS
    distinct owners or EXAMPLE_REPOSITORIES distinct repositories is an ``example``, one
    held by two owners is ``shared``; with one owner it is a ``placeholder`` if it looks
    made up and else ``live``.  Null texts count as empty; a null owner or repository is one
    of its own; repeated rows are the same repository; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    known = docs.select("doc_id", owner.alias("owner"), repository.alias("repository"), "text")
    # stable from here on: the id is made before the rows are written
    rows = checkpointed(scan(known, ["doc_id", "owner", "repository"]).withColumn("row", F.monotonically_increasing_id()))
    spans = rows.select("row", "owner", "repository", F.posexplode(F.arrays_zip("values", "plain")).alias("at", "s"))
    spans = spans.select("row", "owner", "repository", "at", F.col("s.values").alias("value"), F.col("s.plain").alias("plain"))
    missing = F.lit("\0")
    counted = ownership(spans.select("value", F.coalesce("owner", missing).alias("owner"), F.coalesce("repository", missing).alias("repository")))
    judged = spans.join(broadcast_if_small(checkpointed(counted), BROADCAST_VALUES), "value")
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    of = F.when(copied, "example").when(F.col("owners") > 1, "shared").when(F.col("plain"), "placeholder").otherwise("live")
    judged = judged.select("row", "at", of.alias("class"))
    per_row = judged.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "class"))), lambda x: x["class"]), ",").alias("classes"),  # one text's spans
        *[F.sum((F.col("class") == c).cast("long")).alias(f"n_{c}") for c in CLASSES],
    )
    out = rows.drop("owner", "repository", "values", "plain").join(per_row, "row", "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({f"n_{c}": F.coalesce(f"n_{c}", zero) for c in CLASSES} | {"classes": F.coalesce("classes", F.lit(""))}).drop("row")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a document's source owns it, the document is the repository."""
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, F.col("source").cast("string"), F.col("doc_id").cast("string"))


def oracle() -> str:
    words = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    patterns = {
        "assign": (f"({words})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2),
        "access": ("AKIA[A-Z0-9]+", 0),
        "hex": ("[0-9a-f]{32,}", 0),
        "pem": ("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0),
        "url": ("[a-z][a-z0-9+.-]{0,20}://[^\\s/:@]{1,80}:([^\\s/:@]{3,200})@", 1),
        "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0),
    }
    least = {"assign": 8, "access": 16}
    each = " UNION ALL ".join(
        f"""
  SELECT id, {list(patterns).index(kind)} AS k, '{kind}' AS kind, i, matched, value, length(piece) AS gap
  FROM (SELECT id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS matched, unnest(v) AS value, unnest(p[1 : len(m)]) AS piece
        FROM (SELECT id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS v, regexp_split_to_array(text, '{p}') AS p FROM d))"""
        for kind, (p, g) in patterns.items()
    )
    keep = " AND ".join(f"(kind <> '{k}' OR length(value) >= {n})" for k, n in least.items())
    shown = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
c AS ({each}),
s AS (
  SELECT *, stop - length(matched) AS start FROM (
    SELECT *, CAST(sum(gap + length(matched)) OVER (PARTITION BY id, k ORDER BY i) AS BIGINT) AS stop FROM c)
  WHERE {keep}),
o AS (
  SELECT value, count(DISTINCT o) AS owners, count(DISTINCT (o, r)) AS repositories
  FROM (SELECT value, coalesce(CAST(source AS VARCHAR), chr(1)) AS o, coalesce(CAST(doc_id AS VARCHAR), chr(1)) AS r FROM s JOIN d USING (id)) GROUP BY value),
j AS (
  SELECT s.*, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} THEN 'example' WHEN owners > 1 THEN 'shared'
    WHEN regexp_matches(lower(value), '{PLACEHOLDER}') OR list_aggregate(string_split(value, ''), 'entropy') < {LEAST_ENTROPY} THEN 'placeholder' ELSE 'live' END AS class
  FROM s JOIN o USING (value)),
r AS (
  SELECT id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    sha256(coalesce({shown} FILTER (k < {BASE}), '')) AS base_sha256, {shown} AS spans,
    string_agg(class, ',' ORDER BY start, k) AS classes, {", ".join(f"count(*) FILTER (class = '{c}') AS n_{c}" for c in CLASSES)}
  FROM j GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_assign", "n_access", "n_hex", *(f"n_{c}" for c in CLASSES)))},
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(classes, '') AS classes
FROM d LEFT JOIN r USING (id)"""
