"""Fill-in-the-middle texts by escaped marker injection.

A delimiter is escaped in the text, ``regexp_replace`` appends it after every unit, its
occurrences count the units, ``substring_index`` takes the parts before the ranked cuts,
and the parts are unescaped and assembled.  Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter; the escape; what follows the escape for the escape itself and for the delimiter.  None is a letter.
CUT, ESC, OWN, FOR_CUT = "\x01", "\x02", "\x03", "\x04"
#: A unit of an escaped text: a word of ASCII letters, an escaped character or any other code point.
UNIT = f"[A-Za-z]+|{ESC}[{OWN}{FOR_CUT}]|[^A-Za-z]"


def escaped(text: Column) -> Column:
    """``text`` without CUT: reversible, and what stands for one character is one unit."""
    return F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + OWN)), F.lit(CUT), F.lit(ESC + FOR_CUT))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + FOR_CUT), F.lit(CUT)), F.lit(ESC + OWN), F.lit(ESC))


def marked(text: Column) -> Column:
    """The escaped text with CUT after every unit."""
    return F.regexp_replace(escaped(text), f"({UNIT})", f"$1{CUT}")


def count_of(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, char, ""))).cast("long")


def first_units(of: Column, n: Column) -> Column:
    """The plain text of the first ``n`` units of a marked text."""
    return unescaped(F.translate(F.call_function("substring_index", of, F.lit(CUT), n.cast("int")), CUT, ""))


def draws(key: Column, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the SHA-256 of ``1:`` and the key as text; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with a struct ``fim``: n, form, prefix, middle, suffix (null if plain) and output.

    ``plain`` percent of the texts stay as they are, and ``spm`` percent of the others put the
    suffix first; both cuts are drawn from the key, so a repeated row gives the same output.
    A null text is empty; empty texts and texts that hold a marker are plain.  Any text,
    control characters included, comes back unchanged from ``restored``.  An existing column
    named fim is replaced; other columns pass through.
    """
    h1, h2, h3, h4 = draws(F.col(key))
    work = docs.withColumn("fim", F.coalesce(F.col(text).cast("string"), F.lit("")))
    holds = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains(F.col("fim"), F.lit(mark))
    # one step a projection: what is used twice is made once
    work = work.withColumn("fim", F.struct(F.col("fim").alias("text"), marked(F.col("fim")).alias("marked"), ((F.col("fim") == "") | holds | (h3 % 100 >= 100 - plain)).alias("plain")))
    work = work.withColumn("fim", F.struct("fim.*", count_of(F.col("fim.marked"), CUT).alias("n")))
    one, two = h1 % (F.col("fim.n") + 1), h2 % (F.col("fim.n") + 1)
    before = lambda at: F.when(~F.col("fim.plain"), first_units(F.col("fim.marked"), at))
    work = work.withColumn(
        "fim",
        F.struct("fim.text", "fim.n", "fim.plain", before(F.least(one, two)).alias("prefix"), before(F.greatest(one, two)).alias("head")),
    )
    after = lambda long, short: F.expr(f"substring({long}, length({short}) + 1)")
    work = work.withColumn("fim", F.struct("fim.*", after("fim.head", "fim.prefix").alias("middle"), after("fim.text", "fim.head").alias("suffix")))
    form = F.when(F.col("fim.plain"), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    work = work.withColumn("fim", F.struct("fim.*", form.alias("form")))
    p, m, s = (F.col(f"fim.{part}") for part in ("prefix", "middle", "suffix"))
    output = (
        F.when(F.col("fim.form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .when(F.col("fim.form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
        .otherwise(F.col("fim.text"))
    )
    return work.withColumn("fim", F.struct("fim.n", "fim.form", "fim.prefix", "fim.middle", "fim.suffix", output.alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from nothing but output and form.

    Parts hold no marker, and none can arise where a part meets one, so the first of each
    kind is the template's.
    """
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    first, rest = F.split_part(body, second, F.lit(1)), F.split_part(body, second, F.lit(2))
    other, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, other)).otherwise(F.concat(other, middle, first))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the fill-in-the-middle output of every whole document.

    A null text is empty, hence plain with n 0; a null doc_id draws as the empty key;
    repeated rows stay, with equal results; very long texts are cut like any other; an empty
    table gives no rows; extra columns are not read.
    """
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id",
        F.col("fim.n").alias("n"),
        F.col("fim.form").alias("form"),
        F.length("fim.prefix").cast("long").alias("prefix_chars"),
        F.length("fim.middle").cast("long").alias("middle_chars"),
        sha(F.col("fim.output")).alias("output_sha256"),
        sha(restored(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


def oracle() -> str:
    h = lambda i: f"CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
