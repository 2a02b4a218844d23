"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window's fingerprint is the least of the nine 5-gram hashes in its 13 words, so two
texts that share 13 words share a fingerprint.  Document and benchmark fingerprints are
joined; in the texts that match, each hit is extended to the windows that hold it, and
these are compared as a whole by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import broadcast_if_small, checkpointed, table, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What isn't part of a word, character by character: such a class is one table lookup, one of ranges is a chain of tests.
_BETWEEN = "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum())
WINDOW, GRAM = 13, 5
#: Fingerprints, windows and verdicts (fixed-width rows of 8 to 130 bytes) up to so many rows are broadcast.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """The words of a text with A-Z in lower case; null has none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{_BETWEEN}]+", -1), "")
    ascii_only = lambda w: F.length(w) == F.octet_length(w)
    return F.transform(words, lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def n_words_of(text: Column) -> Column:
    """How many words a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{_BETWEEN}]+")).cast("long")


def _zipped(left: Column, right: Column, by: int, of) -> Column:
    """``of`` applied to each element of ``left`` and the one ``by`` places on in ``right``; linear, unlike a slice for each place."""
    return F.zip_with(left, F.slice(right, by + 1, F.greatest(F.size(right), F.lit(1))), of)


def _both(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _trimmed(places: Column, size: int) -> Column:
    """Without the places at which no whole run of ``size`` words starts."""
    return F.slice(places, 1, F.greatest(F.size("words") - (size - 1), F.lit(0)))


def _doubled(df: DataFrame, names: list[str], of) -> DataFrame:
    """From ``<name>1``, a value of each place, those of runs of 2, 4 and 8 places as ``<name>2`` and so on."""
    for held in (1, 2, 4):
        df = df.withColumns({f"{n}{held * 2}": _zipped(F.col(f"{n}{held}"), F.col(f"{n}{held}"), held, of) for n in names})
    return df


def _runs(name: str, size: int) -> Column:
    """A hash of each run of ``size`` words, joined from those of 8, 4, 2 and 1."""
    whole, length = None, 0
    for held in (1, 2, 4, 8):
        if size & held:
            part = F.col(f"{name}{held}")
            whole, length = part if whole is None else _zipped(whole, part, length, _both), length + held
    return _trimmed(whole, size)


def _sized(size: int):
    return lambda h: F.xxhash64(h, F.lit(size))


def _with_fingerprints(df: DataFrame, sizes: list[int]) -> DataFrame:
    """``m13``, the fingerprint of each window of 13 words, and ``m1`` to ``m12``, those of the runs that are a short item's windows."""
    df = _doubled(df.withColumn("first1", F.transform("words", lambda w: F.xxhash64(w))), ["first"], _both)
    df = _doubled(df.withColumn("low1", _runs("first", GRAM)), ["low"], _least)
    marks = {f"m{size}": F.transform(_runs("first", size), _sized(size)) for size in sizes if size < WINDOW}
    lows = _zipped(F.col("low8"), F.col("low1"), WINDOW - GRAM, _least)
    return df.withColumns({f"m{WINDOW}": _trimmed(lows, WINDOW), **marks}).drop(*[f"low{held}" for held in (1, 2, 4, 8)])


def _window(size: int):
    return lambda w, i: F.struct(
        i.alias("start"), F.lit(size).alias("size"), w[f"m{size}"].alias("mark"), w[f"a{size}"].alias("a"), w[f"b{size}"].alias("b")
    )


def _with_windows(df: DataFrame, sizes: list[int]) -> DataFrame:
    """``windows``: start, size, mark (the fingerprint) and 128 bits a, b of every run of these sizes."""
    df = _with_fingerprints(df, sizes).withColumn("second1", F.transform("words", lambda w: F.xxhash64(F.lit(7), w)))
    df = _doubled(df, ["second"], _both)
    df = df.withColumns({f"{x}{size}": _runs(name, size) for size in sizes for x, name in (("a", "first"), ("b", "second"))})
    each = [F.transform(F.arrays_zip(f"m{size}", f"a{size}", f"b{size}"), _window(size)) for size in sizes]
    return df.withColumn("windows", F.concat(*each))


def _each(array) -> Column:
    """One row per element.  A plain explode would have the optimiser push a test of the array's size, and with it all of its expression, below."""
    return F.explode_outer(array)


SPAN = ["size", "mark", "a", "b"]


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key1, key2, n_hit, n_items, items_sha256 of every distinct text that holds a benchmark window.

    Texts go by their 128-bit key, so repeated rows and null ids need no care.  Null,
    empty and word-free texts and items have no windows; without documents or items
    there are no rows.  A null item_id counts as the empty id; items that repeat an id
    are one item.  Copies of a matched text are compared once.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    own = F.least(F.size("words"), F.lit(WINDOW)).alias("own")
    items = checkpointed(items.select("item", "words", own).filter("own > 0"))
    sizes = sorted({WINDOW, *(r[0] for r in items.select("own").distinct().collect())})  # 13 at most
    windows = _with_windows(items, sizes).select("item", "own", _each("windows").alias("w"))
    windows = checkpointed(windows.filter("w.size = own").select("item", *[f"w.{c}" for c in SPAN]).distinct())
    spans = checkpointed(windows.select(*SPAN).distinct())
    marks = spans.select("mark").distinct()

    seen = _with_fingerprints(docs.select(*text_key("text"), words_of(F.col("text")).alias("words")), sizes)
    every = F.array_distinct(F.concat(*[F.col(f"m{size}") for size in sizes]))
    seen = seen.select("key1", "key2", _each(every).alias("mark"))
    matched = seen.join(broadcast_if_small(marks, BROADCAST_ROWS), "mark").select("key1", "key2").distinct()
    matched = checkpointed(matched)

    texts = docs.select(*text_key("text"), "text").join(broadcast_if_small(matched, BROADCAST_ROWS), ["key1", "key2"], "left_semi")
    texts = texts.groupBy("key1", "key2").agg(F.first("text").alias("text"))
    near = _with_windows(texts.select("key1", "key2", words_of(F.col("text")).alias("words")), sizes)
    near = near.select("key1", "key2", _each("windows").alias("w")).select("key1", "key2", "w.*")
    hits = checkpointed(near.join(broadcast_if_small(spans, BROADCAST_ROWS), SPAN))

    before = Window.partitionBy("key1", "key2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    longest = hits.groupBy("key1", "key2", "start").agg(F.max("size").alias("size"))
    end = F.col("start") + F.col("size")
    fresh = end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = longest.select("key1", "key2", F.greatest(fresh, F.lit(0)).alias("fresh"))
    covered = covered.groupBy("key1", "key2").agg(F.sum("fresh").cast("long").alias("n_hit"))
    held = hits.select("key1", "key2", *SPAN).distinct().join(windows, SPAN)
    ids = F.array_sort(F.collect_set("item"))  # the benchmark's ids at most
    held = held.groupBy("key1", "key2").agg(
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
    )
    return covered.join(held, ["key1", "key2"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and aren't contaminated; repeated rows are judged
    alike; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = checkpointed(contaminated_texts(docs.select("text"), benchmark))
    counted = docs.select("doc_id", *text_key("text"), n_words_of(F.col("text")).alias("n_words"))
    judged = counted.join(broadcast_if_small(found, BROADCAST_ROWS), ["key1", "key2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return judged.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which less than a twentieth of the words is benchmark text, with all their columns."""
    found = checkpointed(contaminated_texts(docs.select("text"), benchmark))
    found = found.select(*[F.col(c).alias(f"__found_{c}") for c in ("key1", "key2", "n_hit")])
    named = docs.withColumns(dict(zip(("__own_key1", "__own_key2"), text_key("text"), strict=True)))
    same = (F.col("__own_key1") == F.col("__found_key1")) & (F.col("__own_key2") == F.col("__found_key2"))
    judged = named.join(broadcast_if_small(found, BROADCAST_ROWS), same, "left")
    clean = F.when(F.col("__found_n_hit").isNull(), True).otherwise(F.col("__found_n_hit") * 20 < n_words_of(F.col("text")))
    return judged.filter(clean).select(*docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words, items and the verdict for every document."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item_id, least(n, {WINDOW}) AS size, array_to_string(w[s : s + least(n, {WINDOW}) - 1], ' ') AS run
  FROM i, range(1, n - least(n, {WINDOW}) + 2) r(s)),
d AS (SELECT row_number() OVER () AS id, doc_id, w, len(w) AS n FROM (SELECT doc_id, {words} AS w FROM documents)),
h AS (
  SELECT id, s, z.size, item_id
  FROM (SELECT id, s, size, array_to_string(w[s : s + size - 1], ' ') AS run
        FROM d, (SELECT DISTINCT size FROM iw) x(size), range(1, n - size + 2) r(s) WHERE n >= size) z
  JOIN iw ON iw.size = z.size AND iw.run = z.run),
c AS (SELECT id, count(DISTINCT p) AS n_hit FROM h, range(s, s + size) r(p) GROUP BY id),
t AS (SELECT id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS items_sha256 FROM h GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM d LEFT JOIN c USING (id) LEFT JOIN t USING (id)"""
