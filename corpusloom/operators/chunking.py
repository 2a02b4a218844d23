"""Chunkers: text in, offset-addressed chunks out (offsets are code points, end exclusive)."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundary strings in order of preference, the share of a chunk that is
# searched for one, chunk size and overlap.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", ".\n", "!\n", "?\n", "; ", ", ", " ")
LOOKBACK_SHARE = 0.25
CHUNK_CHARS, OVERLAP_CHARS = 1024, 102
CODE_LIMIT = 1_000_000
#: Marks of lines outside definitions.
IMPORT, LOOSE = -1, -2


def fixed_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last; none for an empty text."""
    step = size - overlap
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / step).cast("long")
    some = df.filter(F.length(text) > 0)
    rows = some.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("seq") * step
    return rows.withColumns(
        {
            "start": start,
            "end": F.least(start + size, F.length(text).cast("long")),
            "chunk": F.substr(F.col(text), (start + 1).cast("int"), F.lit(size)),
        }
    )


def boundary(text: str, at: int, reach: int) -> int:
    """The cut at or before ``at``: after the last occurrence of the best separator within reach."""
    window = text[max(0, at - reach) : at]
    best = next((s for s in SEPARATORS if s in window), None)
    return at if best is None else at - len(window) + window.rindex(best) + len(best)


def stream_spans(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """Spans that a reader of the text in fragments of any size would emit too."""
    overlap, reach = min(max(0, overlap), size // 2), min(size, max(1, int(size * LOOKBACK_SHARE)))
    spans, at = [], 0
    while len(text) - at > size:
        cut = boundary(text, at + size, reach)
        spans.append((at, cut))
        at += max(1, cut - at - overlap)
    if text[at:].strip():
        spans.append((at, len(text)))
    return spans


class FragmentChunker:
    """The same spans from fragments: only the text since the last chunk's start is held."""

    def __init__(self, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> None:
        self.size, self.overlap = size, min(max(0, overlap), size // 2)
        self.reach, self.held, self.base = min(size, max(1, int(size * LOOKBACK_SHARE))), "", 0

    def feed(self, fragment: str) -> list[tuple[int, int]]:
        self.held += fragment
        out, at = [], 0
        while len(self.held) - at > self.size:
            cut = max(at + 1, boundary(self.held, at + self.size, self.reach))
            out.append((self.base + at, self.base + cut))
            at += max(1, cut - at - self.overlap)
        self.held, self.base = self.held[at:], self.base + at
        return out

    def finish(self) -> list[tuple[int, int]]:
        return [(self.base, self.base + len(self.held))] if self.held.strip() else []


def markdown_spans(text: str, size: int) -> list[tuple[int, int]]:
    """Sections at headings of levels 1 to 3, packed up to the budget; blank edges are trimmed."""
    cuts = [0, *(m.start() for m in re.finditer(r"^#{1,3}\s", text, re.M) if m.start()), len(text)]
    packed: list[list[int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if packed and b - packed[-1][0] <= size:
            packed[-1][1] = b
        else:
            packed.append([a, b])
    out = []
    for a, b in packed:
        parts = [(a + s, a + e) for s, e in sentence_snapped(text[a:b], size)] if b - a > size else [(a, b)]
        for s, e in parts:
            body = text[s:e]
            lead = len(body) - len(body.lstrip())
            if body.strip():
                out.append((s + lead, s + lead + len(body.strip())))
    return out


def sentence_snapped(text: str, size: int, reach: int = 160) -> list[tuple[int, int]]:
    """Fixed-size spans whose ends move back to a sentence end within reach."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            ends = [m.end() for m in re.finditer(r"[.!?](?=\s)|\n", text[max(at, end - reach) : end])]
            end = max(at, end - reach) + ends[-1] if ends else end
        out.append((at, end))
        at = end
    return out


_DEFINITION = {
    "js": re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|const)\s+([A-Za-z_$][\w$]*)", re.M),
    "rs": re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|mod)\s+([A-Za-z_]\w*)", re.M),
}


def definition_spans(text: str, language: str) -> list[tuple[str, int, int]]:
    """Preamble, then a span from each definition to the next; blank spans are left out."""
    found = list(_DEFINITION[language].finditer(text))
    cuts = [("<preamble>", 0), *((m[1], m.start()) for m in found), ("", len(text))]
    return [(n, a, b) for (n, a), (_, b) in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]


def _flat(batch: pa.RecordBatch, keep: list[str], found: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """One row for each tuple of ``found``, beside the kept columns of the row it came from."""
    rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
    columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * len(fields)
    known = [batch.column(batch.schema.get_field_index(k)).take(rows) for k in keep]
    return pa.record_batch([*known, *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], [*keep, *(n for n, _ in fields)])


def stream_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, with_text: bool = True) -> DataFrame:
    """key, seq, start, end and, if asked for, chunk: the boundary-seeking chunker on every text."""
    fields = [("seq", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), *([("chunk", pa.string())] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1).to_pylist():
                spans = stream_spans(t or "", size, overlap)
                found.append([(i, a, b, *((t[a:b],) if with_text else ())) for i, (a, b) in enumerate(spans)])
            yield _flat(batch, [key], found, fields)

    rows = df.select(key, text).filter(F.col(key).isNotNull())
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, seq long, start long, end long{', chunk string' if with_text else ''}")


def routed_chunks(df: DataFrame) -> DataFrame:
    """file_id, symbol, start, end: each file (file_id, path, type, text) by the chunker of its extension.

    Python files of up to CODE_LIMIT characters go by ``python_chunks``, other code by definitions,
    Markdown by sections, the rest by boundaries; what a code chunker can't split falls back to boundaries.
    """

    def one(kind: str, text: str, name: str) -> list[tuple[str, int, int]]:
        spans: list[tuple[str, int, int]] = []
        if kind == "py" and len(text) <= CODE_LIMIT:
            spans = [("", a, b) for a, b, _ in python_chunks(text, f"[PY: {name}] ")]
        elif kind in ("js", "ts", "jsx", "tsx") and len(text) <= CODE_LIMIT:
            spans = definition_spans(text, "js")
        elif kind == "rs" and len(text) <= CODE_LIMIT:
            spans = definition_spans(text, "rs")
        elif kind == "md":
            spans = [("", a, b) for a, b in markdown_spans(text, CHUNK_CHARS)]
        return spans or [("", a, b) for a, b in stream_spans(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts, names = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found = [one(k or "", t or "", n or "") for k, t, n in zip(kinds, texts, names, strict=True)]
            yield _flat(batch, ["file_id"], found, [("symbol", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    rows = df.select("file_id", "type", "text", F.element_at(F.split("path", "/"), -1).alias("name"))
    return rows.mapInArrow(run, "file_id long, symbol string, start long, end long")


def line_starts(text: str) -> list[int]:
    """Where each line begins, as Python's parser counts lines: they end at a line feed, a carriage return or both."""
    return [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]


def line_marks(body: list[ast.stmt], lines: list[str]) -> list[list[int]]:
    """What each line of a module belongs to: IMPORT, LOOSE or the numbers of definitions; nothing for blank lines and free comments.

    A definition takes its decorators; a comment line belongs to what stands right below it, imports aside.
    """
    marks: list[list[int]] = [[] for _ in lines]
    for number, node in enumerate(body):
        mark = number if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else IMPORT if isinstance(node, (ast.Import, ast.ImportFrom)) else LOOSE
        for i in range(min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1, min(node.end_lineno or node.lineno, len(lines))):
            marks[i].append(mark)
    for i in range(len(lines) - 2, -1, -1):
        if not marks[i] and lines[i].lstrip().startswith("#"):
            marks[i] = [m for m in marks[i + 1] if m != IMPORT]
    return marks


def python_chunks(text: str, prefix: str, most: int = 4 * 512) -> list[tuple[int, int, str]]:
    """(start, end, chunk) of a module: what stands outside definitions first, then each top-level definition.

    The module's imports go before the first chunk only.  A chunk over ``most`` characters is cut
    blindly; so is a module without code, or one that doesn't parse (too deep a nesting ends the
    parser with a MemoryError).
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return blind_chunks(text, prefix, most)
    starts = line_starts(text)
    lines = [text[a:b].rstrip("\r\n") for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    held: dict[int, list[int]] = {}
    for i, marks in enumerate(line_marks(body, lines)):
        for mark in marks:
            held.setdefault(mark, []).append(i)
    imports = "".join(f"{lines[i]}\n" for i in held.pop(IMPORT, []))
    loose = sorted(set(held.pop(LOOSE, [])))
    module = "\n".join(lines[i] for i in loose)
    parts = []
    if module.strip():
        # gathered from separate lines: it starts at the first of them and is as long as what it holds
        parts.append((starts[loose[0]], min(len(text), starts[loose[0]] + len(module)), module))
    for own in (held[number] for number in sorted(held)):
        end = starts[own[-1] + 1] if own[-1] + 1 < len(starts) else len(text)
        parts.append((starts[own[0]], end, "\n".join(lines[own[0] : own[-1] + 1])))
    out: list[tuple[int, int, str]] = []
    for start, end, code in parts:
        lead = prefix + (f"\n{imports}" if imports and not out else "")
        whole = f"{lead}\n{code}"
        out += [(start, end, whole)] if len(whole) <= most else blind_chunks(code, lead, most, start)
    return out or blind_chunks(text, prefix, most)


def blind_chunks(text: str, prefix: str, most: int, base: int = 0) -> list[tuple[int, int, str]]:
    """Windows of what the prefix leaves of ``most``, stepping 50 characters less; a prefix that leaves under 100 isn't counted."""
    room = most - len(prefix) - 5
    room = room if room >= 100 else most
    return [(base + a, base + min(len(text), a + room), f"{prefix}\n{text[a : a + room]}") for a in range(0, len(text), max(1, room - 50))]


def code_chunks(df: DataFrame, most: int = 4 * 512) -> DataFrame:
    """file_id, seq, start, end, chunk of Python files (columns file_id, path, text), each chunk under its file's context prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = (batch.column(i).to_pylist() for i in (1, 2))
            found = [[(i, *c) for i, c in enumerate(python_chunks(t or "", f"[PY: {n}] ", most))] for n, t in zip(names, texts, strict=True)]
            yield _flat(batch, ["file_id"], found, [("seq", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("chunk", pa.string())])

    rows = df.select("file_id", F.element_at(F.split("path", "/"), -1).alias("name"), "text")
    return rows.mapInArrow(run, "file_id long, seq long, start long, end long, chunk string")
