"""Chunkers, extractors and the code graph as table functions, by name in SQL once ``register`` ran.

    SELECT d.doc_id, c.* FROM docs d, LATERAL stream_chunks(d.text) c
    SELECT * FROM fragment_chunks(TABLE(pages) PARTITION BY file ORDER BY page)

Texts that are null have no chunks.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from corpusloom.operators import chunking, graph
from corpusloom.sources import readers

SPANS = "seq long, start long, end long, chunk string"


def _rows(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple]:
    for seq, (a, b) in enumerate(spans):
        yield seq, a, b, text[a:b]


class StreamChunks:  # C1
    """stream_chunks(text): chunks of 1024 characters at most that end at a boundary and overlap."""

    def eval(self, text: str):
        yield from _rows(text or "", chunking.stream_spans(text or ""))


class FragmentChunks:  # C1, C16
    """fragment_chunks(TABLE(rows) PARTITION BY file ORDER BY place): a text's chunks from its fragments in order.

    rows: file, fragment, and what they are ordered by.  Only the text since the last chunk's start is held.
    """

    def __init__(self) -> None:
        self.reader, self.file, self.seq = chunking.FragmentChunker(), None, 0

    def _numbered(self, spans: list[tuple[int, int]]) -> Iterator[tuple]:
        for a, b in spans:
            yield self.file, self.seq, a, b
            self.seq += 1

    def eval(self, row: Row):
        self.file = row["file"]
        yield from self._numbered(self.reader.feed(row["fragment"] or ""))

    def terminate(self):
        yield from self._numbered(self.reader.finish())


class SnappedChunks:  # C2
    """snapped_chunks(text, size): spans of a size whose ends move back to a sentence end."""

    def eval(self, text: str, size: int):
        yield from _rows(text or "", chunking.sentence_snapped(text or "", size))


class MarkdownChunks:  # C3
    """markdown_chunks(text, size): sections packed up to a size."""

    def eval(self, text: str, size: int):
        yield from _rows(text or "", chunking.markdown_spans(text or "", size))


class PythonChunks:  # C4, C6
    """python_chunks(text, prefix): a module's chunks, each under the prefix."""

    def eval(self, text: str, prefix: str):
        for seq, (a, b, chunk) in enumerate(chunking.python_chunks(text or "", prefix or "")):
            yield seq, a, b, chunk


class DefinitionChunks:  # C5
    """definition_chunks(text, language): what stands before the first definition, then each; languages js and rs."""

    def eval(self, text: str, language: str):
        for name, a, b in chunking.definition_spans(text or "", language):
            yield name, a, b


class CodeGraph:  # G5, G6
    """code_nodes(type, text): nodes and edges of a code file."""

    def eval(self, kind: str, text: str):
        yield from graph.code_rows(kind, text or "")


class Extracted:  # S7, S9-S14
    """extracted(type, content): a file's text, or a stub that names why there is none."""

    def eval(self, kind: str, content: bytes):
        if content is not None:
            yield (readers.text_of(kind, bytes(content)),)


FUNCTIONS = {
    "stream_chunks": (StreamChunks, SPANS),
    "fragment_chunks": (FragmentChunks, "file long, seq long, start long, end long"),
    "snapped_chunks": (SnappedChunks, SPANS),
    "markdown_chunks": (MarkdownChunks, SPANS),
    "python_chunks": (PythonChunks, SPANS),
    "definition_chunks": (DefinitionChunks, "name string, start long, end long"),
    "code_nodes": (CodeGraph, "kind string, source string, target string, line long"),
    "extracted": (Extracted, "text string"),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to a session."""
    for name, (function, columns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=columns))
