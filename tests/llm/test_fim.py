"""Fill-in-the-middle against a plain version, and exact round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fim

from .conftest import ODD


def plain(doc_id, text, plain_share=10, spm_share=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_share:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_share:
        return len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    *ODD, "\x01\x02\x03\x04", "\x02\x03 \x01a\x02b\x04\x01\x01", "a\x01b" * 500, "<P", "<S><", "x <M> y", "< P>a<S", "<<P", "ab<", ">P>", "\n\r\n\x85 x ",
    "a\U0001f600b́c\U00010000", "\x00a\x00", "$1 \\1 ${x}", "Zürich naïve ſ K", "<P" * 40 + "<S" * 40 + "<M" * 40,
]


def check(spark, rows, **shares):
    df = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), **({"plain": shares["p"], "spm": shares["s"]} if shares else {}))
    df = df.withColumn("again", fim.restored(F.col("fim.output"), F.col("fim.form")))
    for r in df.collect():
        n, form, p, m, output = plain(r["doc_id"], r["text"], *shares.values())
        assert (r["fim"]["n"], r["fim"]["form"], r["fim"]["prefix"], r["fim"]["middle"], r["fim"]["output"]) == (n, form, p, m, output)
        assert r["again"] == (r["text"] or "")


def test_odd_texts_under_many_keys(spark):
    check(spark, [(i * 31 + j, t) for i, t in enumerate(TEXTS) for j in range(25)] + [(None, t) for t in TEXTS])


def test_forms_by_shares(spark):
    rows = [(i, "one two, three") for i in range(400)]
    check(spark, rows, p=0, s=100)
    check(spark, rows, p=50, s=0)
    check(spark, rows, p=100, s=0)


def test_a_long_text(spark):
    check(spark, [(i, "a b1" * 300_000 + "é") for i in range(3)])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ\x01\x02\x03\x04<>PSM é\n😀"), max_size=25), min_size=1, max_size=60))
def test_any_text_comes_back(spark, texts):
    check(spark, list(enumerate(texts)))


def test_a_column_named_fim_is_replaced_and_others_stay(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, fim string, prefix string")
    row = fim.fill_in_middle(df).first()
    assert row["prefix"] == "y" and row["fim"]["n"] == 5
