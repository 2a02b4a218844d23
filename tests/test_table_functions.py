"""Table functions by name in SQL, against the operators they stand for."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import chunking, graph


@pytest.fixture(scope="module")
def named(spark):
    tables.register(spark)
    return spark


def prose(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["word", "é", ". ", "\n", "\n\n", ", ", " ", "! ", "longerword"]) for _ in range(n))


TEXTS = [(0, prose(900, 1)), (1, ""), (2, None), (3, "   "), (4, "x" * 3000), (5, prose(300, 2))]


def lateral(named, call, rows=TEXTS, schema="id long, text string"):
    df = named.createDataFrame(rows, schema)
    got = {}
    for row in named.sql(f"SELECT t.id, c.* FROM {{df}} t, LATERAL {call} c", df=df).collect():
        got.setdefault(row[0], []).append(tuple(row[1:]))
    return got


@pytest.mark.parametrize(
    ("call", "spans"),
    [
        ("stream_chunks(t.text)", chunking.stream_spans),
        ("snapped_chunks(t.text, 200)", lambda t: chunking.sentence_snapped(t, 200)),
        ("markdown_chunks(t.text, 200)", lambda t: chunking.markdown_spans(t, 200)),
    ],
)
def test_spans(named, call, spans):
    got = lateral(named, call)
    for key, text in TEXTS:
        assert got.get(key, []) == [(i, a, b, text[a:b]) for i, (a, b) in enumerate(spans(text or ""))]


def test_fragments_of_files(named):
    whole = {1: prose(1200, 3), 2: prose(40, 4), 3: ""}
    rows = [(k, at, t[at : at + 37]) for k, t in whole.items() for at in range(0, max(1, len(t)), 37)] + [(2, 10**6, None)]
    random.Random(5).shuffle(rows)
    df = named.createDataFrame(rows, "file long, place long, fragment string").repartition(3)
    got = {}
    for r in named.sql("SELECT * FROM fragment_chunks(TABLE(SELECT * FROM {df}) PARTITION BY file ORDER BY place)", df=df).collect():
        got.setdefault(r["file"], []).append((r["seq"], r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, a, b) for i, (a, b) in enumerate(chunking.stream_spans(t))] for k, t in whole.items() if t}


def test_code(named):
    module = "import os\n\ndef f():\n    return g()\n\nclass A(B):\n    pass\n"
    rows = [(0, "py", module), (1, "ts", "// hi\nexport function go() {}\nclass B {}\n"), (2, "py", "def ("), (3, "md", "# a"), (4, "py", None), (5, None, "x")]
    got = lateral(named, "code_nodes(t.type, t.text)", rows, "id long, type string, text string")
    df = named.createDataFrame(rows, "file_id long, type string, text string")
    wanted = {}
    for row in graph.code_graph(df.filter(F.col("type").isNotNull())).collect():
        wanted.setdefault(row[0], []).append(tuple(row[1:]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()} and set(got) == {0, 1}
    chunks = lateral(named, "python_chunks(t.text, '[PY: a.py] ')", rows, "id long, type string, text string")
    assert chunks[0] == [(i, *c) for i, c in enumerate(chunking.python_chunks(module, "[PY: a.py] "))] and 4 not in chunks
    assert [c[0] for c in lateral(named, "definition_chunks(t.text, 'js')", rows[1:2], "id long, type string, text string")[1]] == ["<preamble>", "go", "B"]


def test_extracted(named):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<d><body><p><r><t>hello</t></r></p></body></d>")
    rows = [(0, "csv", b"a,b\n1,2\n"), (1, "docx", out.getvalue()), (2, "docx", b"no archive"), (3, None, b"plain"), (4, "txt", None), (5, "txt", b""), (6, "bin", b"\0\1")]
    got = lateral(named, "extracted(t.type, t.content)", rows, "id long, type string, content binary")
    assert got == {0: [("a: 1, b: 2",)], 1: [("hello",)], 2: [("[UNREADABLE: BadZipFile]",)], 3: [("plain",)], 5: [("",)], 6: [("[BINARY: 2 bytes]",)]}
