"""Chunks of large files by blocks equal those of the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.plans import streams
from corpusloom.sources import blocks, readers


def text_of(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["word", "é", "漢字", "😀", ". ", "\n", "\n\n", ", ", " ", "! ", "\r\n", "longerword"]) for _ in range(n))


def expected(data, size, overlap):
    whole = readers.decode(data)
    return [(a, b, whole[a:b]) for a, b in chunking.stream_spans(whole, size, overlap)]


CASES = {
    "prose.txt": text_of(9000, 1).encode(),
    "marked.txt": b"\xef\xbb\xbf" + text_of(3000, 2).encode(),
    "wide.txt": b"\xff\xfe" + text_of(3000, 3).encode("utf-16-le"),
    "big_endian.txt": b"\xfe\xff" + text_of(2000, 4).encode("utf-16-be"),
    "widest.txt": b"\xff\xfe\x00\x00" + text_of(2000, 5).encode("utf-32-le"),
    "no_cut.txt": b"x" * 20_000,
    "blank_end.txt": b"some words. " * 200 + b" " * 3000,
    "blank.txt": b" \n" * 2000,
    "short.txt": b"a few words",
    "broken.txt": b"".join(random.Random(6).choices([b"ab ", b"\xc3\xa9", b"\x80", b"\xe6\xbc", b"\xf0\x9f\x98\x80", b". "], k=5000)),
    "empty.txt": b"",
    "binary.txt": b"PK\x00\x01" * 3000,
}


@pytest.mark.parametrize(("size", "overlap", "block"), [(100, 10, 512), (64, 40, 64), (1024, 102, 4096)])
def test_blocks_equal_the_whole_text(spark, tmp_path, size, overlap, block):
    for name, data in CASES.items():
        (tmp_path / name).write_bytes(data)
    files = readers.discover(spark, [str(tmp_path)], ["txt"])
    got = {}
    for row in blocks.block_chunks(files, size, overlap, block).collect():
        got.setdefault(row["path"].rpartition("/")[2], []).append((row["start"], row["end"], row["chunk"]))
    for name, data in CASES.items():
        wanted = [] if readers.looks_binary(data) else expected(data, size, overlap)
        assert sorted(got.get(name, [])) == wanted, name


def test_groups_of_groups(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blocks, "GROUP", 3)
    data = text_of(4000, 8).encode()
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(data[:700])
    files = readers.discover(spark, [str(tmp_path)], ["txt"])
    rows = blocks.block_chunks(files, 80, 8, 256).collect()
    for name, wanted in (("a.txt", expected(data, 80, 8)), ("b.txt", expected(data[:700], 80, 8))):
        assert sorted((r["start"], r["end"], r["chunk"]) for r in rows if r["path"].endswith(name)) == wanted


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, size long")
    assert blocks.block_chunks(none).count() == 0


@pytest.mark.parametrize(("largest", "block"), [(0, 64), (0, 4096), (5000, 512)])
def test_lines_of_files_of_any_size(spark, tmp_path, largest, block):
    more = {"ends.txt": b"a\n\nbb\n" * 40, "odd.txt": b"\xff\xfe" + "\u0a41\u410a\n\u0a0ax\n".encode("utf-16-le") * 50}
    for name, data in (CASES | more).items():
        (tmp_path / name).write_bytes(data[:6000])
    got = {}
    for row in blocks.text_lines(readers.discover(spark, [str(tmp_path)], ["txt"], content=True), largest, block).collect():
        got.setdefault(row["path"].rpartition("/")[2], []).append(row["line"])
    for name, data in (CASES | more).items():
        assert sorted(got.get(name, [])) == sorted(x for x in readers.plain_text(data[:6000]).split("\n") if x), name


def test_documents_in_files_of_over_50_mb_come_back_whole(spark, tmp_path):
    text = F.repeat(F.lit("word "), 200_000)
    spark.range(60).select(F.lit("en").alias("lang"), F.concat(text, F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in streams.file_text_round_trip(spark, str(tmp_path)).collect()] == [("en", 60, 60 * 1_000_000 + 10 + 50 * 2)]
