"""Files as text: discovery, decoding and one extractor for each format, run where the files are read.

Files come through Spark's binaryFile source, so any store that Spark reads will do.
Each extractor turns one file's bytes into text; a file that can't be read gives a
stub that names why, never a failed job.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.scopes import suffix

# Bytes looked at for binary content, the size above which JSON stays as it is,
# and the bounds of an archive.
SNIFFED, JSON_PRETTY, ARCHIVE_BYTES, ARCHIVE_RATIO = 8192, 500_000, 100 * 1024 * 1024, 200
_BOMS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def discover(spark: SparkSession, roots: list[str], extensions: list[str], content: bool = False) -> DataFrame:  # S1-S3
    """Files below the roots with one of the extensions (all, if none is given), hidden names skipped.

    path, size, modified_at, type; with ``content`` the bytes too (column pruning keeps
    Spark from reading them otherwise).
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    kind = suffix(F.col("path"))
    wanted = [e.lower().lstrip(".") for e in extensions]
    if wanted:
        rows = rows.filter(kind.isin(*wanted))
    rows = rows.filter(~F.col("path").rlike(r"/\.[^/]"))
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), kind.alias("type"), *(["content"] if content else []))


def looks_binary(data: bytes) -> bool:
    """A zero byte without a byte-order mark, or over 30 % control bytes, in the first 8 KB."""
    head = data[:SNIFFED]
    if any(head.startswith(bom) for bom, _ in _BOMS):
        return False
    odd = sum(b < 32 and b not in (9, 10, 13) for b in head)
    return b"\0" in head or odd > 0.3 * max(1, len(head))


def decode(data: bytes) -> str:
    for bom, codec in _BOMS:
        if data.startswith(bom):
            return data[len(bom) :].decode(codec, "replace")
    return data.decode("utf-8", "replace")


def plain_text(data: bytes) -> str:
    return f"[BINARY: {len(data)} bytes]" if looks_binary(data) else decode(data)


def csv_text(data: bytes) -> str:  # S9
    """A "header: value, ..." line for each row, blank cells left out."""
    rows = csv.reader(io.StringIO(decode(data), newline=""))
    head = next(rows, [])
    return "\n".join(", ".join(f"{h}: {v}" for h, v in zip(head, row, strict=False) if v.strip()) for row in rows if any(v.strip() for v in row))


def json_text(data: bytes) -> str:  # S10
    text = decode(data)
    if len(data) > JSON_PRETTY:
        return text
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def archive(data: bytes) -> zipfile.ZipFile:  # S16
    """The archive, unless what it declares is too large or too dense."""
    z = zipfile.ZipFile(io.BytesIO(data))
    declared = sum(i.file_size for i in z.infolist())
    if declared > ARCHIVE_BYTES or declared > ARCHIVE_RATIO * max(1, len(data)):
        raise ValueError("archive declares too much")
    return z


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _own_text(e: ElementTree.Element, leaf: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == leaf)


def xlsx_text(data: bytes) -> str:  # S11
    """"--- Sheet: name ---" and "a | b" rows of each sheet."""
    z = archive(data)
    shared = [_own_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
    out = []
    for i, part in enumerate(_parts(z, r"xl/worksheets/sheet(\d+)\.xml")):
        out.append(f"--- Sheet: {names[i] if i < len(names) else i + 1} ---")
        for row in ElementTree.fromstring(z.read(part)).iter():
            if _tag(row) == "row":
                cells = []
                for c in row:
                    value = _own_text(c, "v") or _own_text(c)
                    cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                if any(cells):
                    out.append(" | ".join(cells))
    return "\n".join(out)


def docx_text(data: bytes) -> str:  # S12
    """Paragraphs and tables in order, headings marked by level."""
    z, out = archive(data), []

    def block(e: ElementTree.Element) -> None:
        for child in e:
            if _tag(child) == "p":
                style = next((v for s in child.iter() if _tag(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
                m = re.fullmatch(r"[Hh]eading ?(\d+)", style)
                if text := _own_text(child).strip():
                    out.append("#" * min(int(m[1]), 6) + " " + text if m else text)
            elif _tag(child) == "tbl":
                for row in (r for r in child.iter() if _tag(r) == "tr"):
                    out.append(" | ".join(_own_text(c).strip() for c in row if _tag(c) == "tc"))
            else:
                block(child)

    for name in ("word/document.xml", *_parts(z, r"word/header(\d+)\.xml"), *_parts(z, r"word/footer(\d+)\.xml"), "word/footnotes.xml"):
        if name in z.namelist():
            block(ElementTree.fromstring(z.read(name)))
    return "\n".join(out)


def pptx_text(data: bytes) -> str:  # S13
    """"--- Slide n ---", its shapes' lines, and its notes."""
    z, out = archive(data), []
    for i, part in enumerate(_parts(z, r"ppt/slides/slide(\d+)\.xml"), 1):
        out.append(f"--- Slide {i} ---")
        out += [t for p in ElementTree.fromstring(z.read(part)).iter() if _tag(p) == "p" and (t := _own_text(p).strip())]
        notes = f"ppt/notesSlides/notesSlide{i}.xml"
        if notes in z.namelist():
            lines = [t for p in ElementTree.fromstring(z.read(notes)).iter() if _tag(p) == "p" and (t := _own_text(p).strip())]
            out += ["[Notes]", *lines] if lines else []
    return "\n".join(out)


def stripped(html: str) -> str:
    import html as entities

    text = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ", html)
    text = re.sub(r"(?i)</?(?:a|abbr|b|cite|code|em|i|kbd|mark|q|s|small|span|strong|sub|sup|u)(?:\s[^>]*)?>", "", text)
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", " ", text)).split())


def epub_text(data: bytes) -> str:  # S14
    """Chapters of over 50 characters in the order of the spine."""
    z = archive(data)
    root = ElementTree.fromstring(z.read("META-INF/container.xml"))
    package = next(r.get("full-path", "") for r in root.iter() if _tag(r) == "rootfile")
    base, opf = package.rpartition("/")[0], ElementTree.fromstring(z.read(package))
    where = {i.get("id"): i.get("href", "") for i in opf.iter() if _tag(i) == "item"}
    parts = [where[r.get("idref")] for r in opf.iter() if _tag(r) == "itemref" and r.get("idref") in where]
    texts = [stripped(decode(z.read(n))) for p in parts if (n := f"{base}/{p}".lstrip("/")) in z.namelist()]
    return "\n\n".join(t for t in texts if len(t) > 50)


def pdf_text(read_pages: Callable[[bytes], list[str | None] | None], few: int = 40, blank: int = 10, most_odd: float = 0.2) -> Callable[[bytes], str]:  # S15
    """An extractor for PDF files from an injected page reader, as no PDF library comes with the engine.

    ``read_pages`` gives the text of each page, null where a page fails, or null for an
    encrypted file.  Pages that need recognition (too little text for a page that isn't
    blank, or too many odd characters) are left out and named in a last line,
    ``[PAGES: n native, n blank, ocr 1-3,7]``; an encrypted file gives a stub.
    """

    def odd(text: str) -> float:
        return sum(not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()[]/%&+-") for c in text) / max(1, len(text))

    def extract(data: bytes) -> str:
        pages = read_pages(data)
        if pages is None:
            return "[ENCRYPTED PDF]"
        texts = [(p or "").strip() for p in pages]
        weak = [i for i, t in enumerate(texts, 1) if t and (len(t) < few or odd(t) > most_odd) or pages[i - 1] is None]
        weak = [i for i in weak if len(texts[i - 1]) >= blank or pages[i - 1] is None]
        native = [t for i, t in enumerate(texts, 1) if len(t) >= blank and i not in weak]
        runs: list[list[int]] = []
        for i in weak:
            runs = [*runs[:-1], [runs[-1][0], i]] if runs and runs[-1][1] == i - 1 else [*runs, [i, i]]
        ocr = ",".join(str(a) if a == b else f"{a}-{b}" for a, b in runs) or "none"
        return "\n\n".join([*native, f"[PAGES: {len(native)} native, {len(pages) - len(native) - len(weak)} blank, ocr {ocr}]"])

    return extract


#: Extractors by extension; PDF takes an injected one (``pdf_text``), and gives a stub without it.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "csv": csv_text, "tsv": csv_text, "json": json_text, "xlsx": xlsx_text, "docx": docx_text, "pptx": pptx_text, "epub": epub_text,
    "html": lambda b: stripped(decode(b)), "htm": lambda b: stripped(decode(b)),
}


def text_of(kind: str, data: bytes, table: dict[str, Callable[[bytes], str]] = EXTRACTORS) -> str:  # S17
    """A file's text by its type, plain text for types without an extractor; a stub if it can't be read."""
    try:
        return table.get(kind, plain_text)(data)
    except Exception as e:  # noqa: BLE001  a broken file must not end the job
        return f"[UNREADABLE: {type(e).__name__}]"


def extract(files: DataFrame, more: dict[str, Callable[[bytes], str]] | None = None, largest: int = 50_000_000) -> DataFrame:  # S7, S8, S15, S17
    """path, type, sha256 and text of files read with their bytes.

    Extractors of ``more`` come first; other files are plain text.  Failures and files of
    over ``largest`` bytes give an [UNREADABLE: ...] stub; of the latter no byte is read,
    so their sha256 is null.  ``blocks.block_chunks`` reads and cuts such text files, whatever their size.
    """
    table = {**EXTRACTORS, **(more or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [text_of(k, bytes(b), table) for k, b in zip(rows["type"], rows["content"], strict=True)]
            yield rows[["path", "type", "sha256"]].assign(text=texts)

    # the filter on size goes down to the reader, and the stubs' side reads no content
    small = files.filter(F.col("size") <= largest).select("path", "type", F.sha2("content", 256).alias("sha256"), "content")
    stub = F.concat(F.lit("[UNREADABLE: "), F.col("size").cast("string"), F.lit(" bytes]"))
    large = files.filter(F.col("size") > largest).select("path", "type", F.lit(None).cast("string").alias("sha256"), stub.alias("text"))
    return small.mapInPandas(run, "path string, type string, sha256 string, text string").unionByName(large)


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:  # S18
    """Well-formed lines of page results; negative pages are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("page >= 0")


def judgments(spark: SparkSession, path: str) -> DataFrame:  # S19
    """query, id and grade of a tab-separated relevance file with a header; grades over 0."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("query string, id string, grade int").csv(path)
    return rows.filter("grade > 0")
