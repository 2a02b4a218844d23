"""Very large text files, cut into chunks by blocks: one file is the work of many tasks, and none holds all of it.

Where a chunk ends depends on where it starts, and so on all of the file before it.  A block therefore
tells, for every place its first chunk could start at, where the first chunk of the next block would start.  These
maps are put together by groups of blocks, and groups of groups; then every block knows its own start and is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.chunking import CHUNK_CHARS, LOOKBACK_SHARE, OVERLAP_CHARS, boundary
from corpusloom.operators.tables import cut
from corpusloom.sources.folders import opened
from corpusloom.sources.readers import _BOMS, SNIFFED, extract, looks_binary

#: Bytes of a block, blocks of a task, blocks of a group whose maps are put together.
BLOCK, DEALT, GROUP = 4 << 20, 4, 64
#: Text files of up to so many bytes are read whole by one task.
WHOLE = 50_000_000
#: Start of the next block's first chunk where the text is cut to its end.
DONE = -1


def _belongs_before(data: bytes, codec: str) -> int:
    """Bytes at the start of a block that complete the last character of the one before."""
    if codec == "utf-8":
        return next((i for i in range(min(3, len(data))) if data[i] & 0xC0 != 0x80), min(3, len(data)))
    if codec.startswith("utf-16") and len(data) > 1:
        return 2 if data[codec.endswith("le")] & 0xFC == 0xDC else 0
    return 0


def read_block(path: str, block: int, size: int, ahead: int) -> tuple[str, str] | None:
    """A block's own text and up to ``ahead`` characters of what follows; null for a binary file.

    A character belongs to the block that its first byte lies in.  What doesn't decode is replaced as in the whole file.
    """
    store, inside, _ = opened(path)
    with store.open_input_file(inside) as f:
        head = f.read(SNIFFED)
        if looks_binary(head):
            return None
        mark, codec = next(((len(bom), codec) for bom, codec in _BOMS if head.startswith(bom)), (0, "utf-8"))
        f.seek(mark + block * size)
        data = f.read(size + 4 * (ahead + 2))
    first = _belongs_before(data, codec) if block else 0
    last = size + _belongs_before(data[size:], codec)
    return data[first:last].decode(codec, "replace"), data[last:].decode(codec, "replace")[:ahead]


def _reach(size: int) -> int:
    return min(size, max(1, int(size * LOOKBACK_SHARE)))


def _steps(text: str, at: int, upto: int, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, next start) of the chunks that start in the first ``upto`` characters, from one at ``at``; DONE after the last."""
    while at < upto:
        if len(text) - at <= size:
            yield at, len(text), DONE
            return
        end = boundary(text, at + size, _reach(size))
        yield at, end, at + max(1, end - at - overlap)
        at += max(1, end - at - overlap)


def exits(text: str, ahead: str, size: int, overlap: int) -> list[int]:
    """For each place below ``size`` that a block's first chunk may start at: where the next block's does.

    Ways that meet go on together, so no place of the block is looked at twice.
    """
    both, n, known = text + ahead, len(text), {}
    for entry in range(size):
        way, to = [], entry - n  # an entry beyond a short block is one of the next
        for at, _, after in _steps(both, entry, n, size, overlap):
            if at in known:
                to = known[at]
                break
            way.append(at)
            to = DONE if after == DONE else after - n
        known.update(dict.fromkeys(way, to))
        known[entry] = to
    return [known[entry] for entry in range(size)]


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """path and block (0, 1, ...) of files (path, size in bytes), dealt evenly to tasks; an empty file has none."""
    each = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / size) - 1, F.lit(0)).cast("long"))).alias("block"), "size")
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / size)), F.lit(0))).first()[0]
    return each.filter("size > 0").select("path", "block").repartition(int(min(max(n / DEALT, 1), 100_000)), "path", "block")


def _composed(a: Column, b: Column) -> Column:
    """The map of ``a``, then ``b``, and the characters of both."""
    through = F.transform(a["exits"], lambda e: F.when(e == DONE, DONE).otherwise(F.get(b["exits"], e)))
    return F.struct(through.alias("exits"), (a["chars"] + b["chars"]).alias("chars"))


def starts(maps: DataFrame) -> DataFrame:
    """path, block, entry and base of every block of maps (path, block, exits, chars): the place in the block where its first
    chunk starts (DONE: none does) and the characters of the file before the block.

    Maps go together by groups of GROUP, whose maps go together in turn, so a task holds one group, however long a file is.
    """
    level, groups = maps.select("path", F.col("block").alias("at"), F.struct("exits", "chars").alias("map")), []
    deepest = maps.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    while deepest > 0:
        members = level.groupBy("path", F.floor(F.col("at") / GROUP).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("members"))
        groups.append(members)
        whole = F.reduce(F.slice("members", 2, GROUP), F.get("members", F.lit(0))["map"], lambda held, m: _composed(held, m["map"]).cast("struct<exits:array<int>,chars:bigint>"))
        level, deepest = cut(members.select("path", F.col("up").alias("at"), whole.alias("map"))), deepest // GROUP
    placed = level.select("path", "at", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("base"))
    shape = "struct<entry:int,base:bigint,out:array<struct<at:bigint,entry:int,base:bigint>>>"
    for members in reversed(groups):
        both = members.join(placed.withColumnRenamed("at", "up"), ["path", "up"])
        begin = F.struct("entry", "base", F.array().alias("out")).cast(shape)

        def placing(held: Column, m: Column) -> Column:
            own = F.struct(m["at"].alias("at"), held["entry"].alias("entry"), held["base"].alias("base"))
            after = F.when(held["entry"] == DONE, DONE).otherwise(F.get(m["map"]["exits"], held["entry"]))
            return F.struct(after.alias("entry"), (held["base"] + m["map"]["chars"]).alias("base"), F.array_append(held["out"], own).alias("out")).cast(shape)

        each = both.select("path", F.explode(F.reduce("members", begin, placing)["out"]).alias("x"))
        placed = each.select("path", "x.*")
    return placed.withColumnRenamed("at", "block")


def block_chunks(files: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, block: int = BLOCK) -> DataFrame:  # C1, S8
    """path, start, end, chunk of text files (path, size in bytes) of any length: the spans that ``stream_spans`` gives for the whole text.

    Each block is read twice, for its map and for its chunks.  Binary and empty files have no rows; an unreadable one fails its task.
    """
    overlap, block = min(max(0, overlap), size // 2), max(4, block - block % 4)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, number in rows.itertuples(index=False):
                if (found := read_block(path, number, block, size + 1)) is not None:
                    yield pd.DataFrame({"path": [path], "block": [number], "exits": [exits(*found, size, overlap)], "chars": [len(found[0])]})

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, number, entry, base in rows.itertuples(index=False):
                text, ahead = read_block(path, number, block, size + 1) or ("", "")
                both = text + ahead
                spans = [(a, b) for a, b, after in _steps(both, entry, len(text), size, overlap) if after != DONE or both[a:b].strip()]
                if spans:
                    yield pd.DataFrame({"path": path, "start": [base + a for a, _ in spans], "end": [base + b for _, b in spans], "chunk": [both[a:b] for a, b in spans]})

    some = blocks(files, block)
    maps = cut(some.mapInPandas(mapped, "path string, block long, exits array<int>, chars long"))
    todo = starts(maps).filter(F.col("entry") != DONE).select("path", "block", "entry", "base")
    tasks = some.rdd.getNumPartitions()
    return todo.repartition(tasks, "path", "block").mapInPandas(chunked, "path string, start long, end long, chunk string")


def read_lines(path: str, block: int, size: int) -> list[str]:
    """The lines that begin in a block, each to its end; one for a binary file.  ``size`` is a multiple of four."""
    store, inside, _ = opened(path)
    with store.open_input_file(inside) as f:
        head = f.read(SNIFFED)
        if looks_binary(head):
            return [] if block else [f"[BINARY: {f.size()} bytes]"]
        mark, codec = next(((len(bom), codec) for bom, codec in _BOMS if head.startswith(bom)), (0, "utf-8"))
        end = "\n".encode(codec)
        width = len(end)

        def after(data: bytes) -> int:
            """Bytes up to and with the first line end; 0 without one."""
            at = data.find(end)
            while at >= 0 and at % width:
                at = data.find(end, at + 1)
            return at + width if at >= 0 else 0

        before = width if block else 0  # the last character of the block before tells whether a line begins right here
        f.seek(mark + block * size - before)
        data = f.read(size + before)
        if block:
            data = data[after(data) :] if after(data) else b""
        parts, ended = [data], not data or data[-width:] == end
        while not ended and (more := f.read(SNIFFED)):
            n = after(more)
            parts.append(more[:n] if n else more)
            ended = n > 0
    lines = b"".join(parts).decode(codec, "replace").split("\n")
    return lines if lines[-1] else lines[:-1]


def text_lines(files: DataFrame, largest: int = WHOLE, block: int = BLOCK) -> DataFrame:  # S7, S8
    """path and line of plain text files (path, type, size, content) of any size, as split at line feeds, but for empty lines.

    Files of over ``largest`` bytes are read by blocks, so no task holds one; a binary file has one line that says so.
    """
    block = max(4, block - block % 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, number in rows.itertuples(index=False):
                if lines := read_lines(path, number, block):
                    yield pd.DataFrame({"path": path, "line": lines})

    small = extract(files.filter(F.col("size") <= largest).withColumn("type", F.lit("")))
    small = small.select("path", F.explode(F.split("text", "\n")).alias("line"))
    large = blocks(files.filter(F.col("size") > largest), block)
    return small.unionByName(large.mapInPandas(run, "path string, line string")).filter("line <> ''")
