"""Exact Jaccard join over sets of word n-grams by PartEnum signatures.

Sets go in classes of similar size.  Two sets of a class that are similar enough differ in at
most ``k`` elements.  The hashed domain of the elements is cut into n1 parts, each into n2
smaller ones, so that some part holds at most k2 differing elements and some choice of
n2 - k2 of its smaller parts holds none: a signature is a class, a part and a choice, with all the
elements in it, and similar sets share one.  Sets of a bucket (that is, of one signature) are
candidates; their size and an odd sketch (parities of element counts in cells, which differ in
no more cells than the sets do in elements) leave out most; the rest are compared in full.

Equal sets are one node.  In a bucket all sets are first compared with a hub, that is one of them
that shares most signatures; of buckets that aren't one component after that, only pairs
across components are compared.  So a large group of near copies costs as many comparisons as it has members,
while no link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, checkpointed, slices, table, text_key, texts_to_python
from corpusloom.llm.components import connected_components

SHINGLE, SEED = 3, 42
#: Two sets link when den * (size of their intersection) >= num * (size of their union).
NUM, DEN = 9, 10
#: Up to so many differing elements signatures take two of the three smaller parts of each part; beyond, parts are whole.
FINE = 16
#: Sets of so many rows are joined to them by broadcast, as there are few; tables up to so many rows are broadcast.
HOT_COPIES, BROADCAST_ROWS = 1000, 500_000
#: A further signature, one for about three elements, costs as much as some thirty looks at two sketches to write and shuffle.
#: Where more pairs than this for each element are left across components, buckets are parted by further signatures first.
PAIRS_AN_ELEMENT = 10
#: All ones of a 64-bit word.
WORD = 0xFFFFFFFFFFFFFFFF

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of all word n-grams; of the whole sequence if shorter; nothing without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda at, size: at + size + 1))
    starts = [0, *(e + 1 for e in ends[:-n])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :], strict=True)), np.uint64, len(starts)))


def size_classes(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(class, k) of the classes that a set of this size takes part in; k: most elements in which two similar sets of it differ.

    Class c holds the sizes from its first to ``top``, half as much again; the set also counts to
    the class before if it can be similar to one of its larger sets.
    """
    out, first, c = [], 1, 0
    while first <= size:
        top = first * 3 // 2
        beyond = top * den // num  # the largest set that is similar to one of the class
        k = 2 * beyond * (den - num) // (den + num)
        if size <= beyond and k:
            out.append((c, k))
        first, c = top + 1, c + 1
    return out


def partition_of(k: int) -> tuple[int, int, int]:
    """n1, n2 and k2 for sets that differ in at most ``k`` elements: n1 * (k2 + 1) > k."""
    return (k // 2 + 1, 3, 1) if k <= FINE else (k + 1, 1, 0)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & WORD)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def signatures(elements: np.ndarray, num: int, den: int, salt: int = 0) -> np.ndarray:
    """The 64-bit names of all signatures of a set."""
    out = []
    spread = _mixed(elements, salt + 1)
    for c, k in size_classes(len(elements), num, den):
        n1, n2, k2 = partition_of(k)
        cell = (spread >> np.uint64(32)) % np.uint64(n1) * np.uint64(n2) + (spread & np.uint64(0xFFFFFFFF)) % np.uint64(n2)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell.astype(np.int64), elements)
        sums = sums.reshape(n1, n2)
        for i, chosen in enumerate(combinations(range(n2), n2 - k2)):
            held = _mixed(sums[:, chosen[0]], 11)
            for j in chosen[1:]:
                held = _mixed(held + sums[:, j], 12)
            place = np.arange(n1, dtype=np.uint64) + np.uint64((((salt << 20) + c) * 8 + i) << 24 & WORD)
            out.append(_mixed(held + _mixed(place, 13), 14))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the elements in each of n / 2 to n cells (a power of two, 256 at least), 64 to a word.

    Words a multiple of w apart, added up without carry, are the sketch of w words.
    """
    cells = max(256, 1 << max(len(elements), 1).bit_length() - 1)
    odd = np.bincount((_mixed(elements, 5) & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def small_sketch(odd: np.ndarray) -> np.ndarray:
    """The sketch of 256 cells."""
    return np.bitwise_xor.reduce(odd.reshape(-1, 4), axis=0)


def _sets(docs: DataFrame, keep: list[str], num: int, den: int) -> DataFrame:
    """``keep`` columns, the size ``n`` of the set, its 128-bit name, sketches and signatures.

    A task writes the signatures and sketches of a set once, null with further copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            n, high, low, odd, few, signed = [], [], [], [], [], []
            for text in batch.column(at).to_pylist():
                found = shingles(text)
                name = xxhash.xxh3_128_intdigest(found.tobytes())
                name = (name >> 64) - (1 << 63), (name & WORD) - (1 << 63)
                n.append(len(found))
                high.append(name[0])
                low.append(name[1])
                first = len(found) > 0 and name not in seen
                odd.append(sketch(found) if first else None)
                few.append(small_sketch(odd[-1]) if first else None)
                signed.append(signatures(found, num, den).view(np.int64) if first else None)
                if first:
                    seen.add(name)
            rest = [i for i in range(batch.num_columns) if i != at]
            longs = pa.list_(pa.int64())
            columns = [pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(odd, longs), pa.array(few, longs), pa.array(signed, longs)]
            yield pa.record_batch([*(batch.column(i) for i in rest), *columns], [*(batch.schema.names[i] for i in rest), "n", "high", "low", "odd", "few", "signed"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("__text").schema)
    return texts_to_python(rows).mapInArrow(run, f"{types}, n long, high long, low long, odd array<long>, few array<long>, signed array<long>")


def _with_sets(sets: DataFrame | None, nodes: DataFrame, keys: DataFrame, docs: DataFrame) -> DataFrame:
    """``sets`` (node, elements) and those of ``nodes`` that it lacks, read from ``docs`` again; of equal texts one is read.

    ``keys``: (node, key1, key2), the text of each node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "elements"])

    new = nodes.distinct() if sets is None else nodes.distinct().join(sets.select("node"), "node", "left_anti")
    new = checkpointed(new)
    if sets is not None and new.isEmpty():
        return sets
    wanted = broadcast_if_small(checkpointed(keys.join(new, "node")), BROADCAST_ROWS)
    texts = docs.select(*text_key("text"), F.col("text").cast("string").alias("text")).join(wanted, ["key1", "key2"])
    texts = texts_to_python(texts.groupBy("node").agg(F.first("text").alias("text")))
    found = checkpointed(texts.mapInArrow(run, "node long, elements array<long>"))
    return found if sets is None else sets.unionByName(found)


def _resigned(sets: DataFrame, num: int, den: int, salt: int) -> DataFrame:
    """(node, second): the signatures of an independent partition of the domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [signatures(np.array(e, np.int64).view(np.uint64), num, den, salt).view(np.int64) for e in batch.column("elements").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(signed, pa.list_(pa.int64()))], ["node", "signed"])

    return sets.mapInArrow(run, "node long, signed array<long>").select("node", F.explode("signed").alias("second"))


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    known = broadcast_if_small(pairs, BROADCAST_ROWS)
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("one")).join(known, "a")
    ends = broadcast_if_small(pairs.select("b").distinct(), BROADCAST_ROWS)
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("two")).join(ends, "b", "left_semi")
    common = F.size(F.array_intersect("one", "two"))
    both = one.join(two, "b").select("a", "b", common.alias("common"), (F.size("one") + F.size("two")).alias("sizes"))
    return both.filter(F.col("common") * den >= (F.col("sizes") - F.col("common")) * num).select("a", "b")


def _folded(odd: Column, words: Column) -> Column:
    """A sketch of fewer words."""
    times = (F.size(odd) / words).cast("int")
    part = lambda i: F.slice(odd, i * words + 1, words)
    more = F.aggregate(F.sequence(F.lit(1), times - 1), part(F.lit(0)), lambda a, i: F.zip_with(a, part(i), lambda x, y: x.bitwiseXOR(y)))
    return F.when(times == 1, odd).otherwise(more)


def _differing(one: Column, two: Column) -> Column:
    """Cells in which two sketches of the same number of words differ."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)


def _pairs(left: DataFrame, right: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a < b) of one bucket, but not of one component, that their sizes and sketches allow to link.

    Sets that link differ in (den - num) / (den + num) of their sizes at most; small sketches go
    with the buckets, whole ones decide once a pair is found.
    """
    n, m, x, y = F.col("x.n"), F.col("y.n"), F.col("x.few"), F.col("y.few")
    cells = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(4)), F.lit(0))
    other = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.component") != F.col("y.component"))
    other = other & (n * den >= m * num) & (m * den >= n * num) & (cells * (den + num) <= (n + m) * (den - num))
    found = left.alias("x").join(right.alias("y"), other)
    found = found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), (n + m).alias("sizes")).distinct()
    for end in ("a", "b"):
        found = found.join(sketches.select(F.col("node").alias(end), F.col("odd").alias(f"odd_{end}")), end)
    words = F.least(F.size("odd_a"), F.size("odd_b"))
    cells = _differing(_folded(F.col("odd_a"), words), _folded(F.col("odd_b"), words))
    return found.filter(cells * (den + num) <= F.col("sizes") * (den - num)).select("a", "b")


def _hubs(members: DataFrame, order: Column) -> DataFrame:
    """Of each bucket the set that comes last in ``order``."""
    best = members.groupBy("sig").agg(F.max_by(F.struct("node", "n", "few", "component"), F.struct(order, "node")).alias("hub"))
    return checkpointed(best.select("sig", "hub.*"))


def _one_of_equal(members: DataFrame) -> DataFrame:
    """The rows of one bucket of those that hold the same sets, by 128 bits that name what a bucket holds."""
    node = F.col("node")
    held = members.groupBy("sig").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64(node)).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), node)).alias("y"))
    kept = held.groupBy("size", "x", "y").agg(F.min("sig").alias("sig")).filter("size > 1").select("sig")
    return members.join(broadcast_if_small(checkpointed(kept), BROADCAST_ROWS), "sig")


def _mixed_only(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component; ``most`` is the component with most sets of its bucket, ``left`` the pairs across."""
    parts = members.groupBy("sig", "component").agg(F.count("*").alias("size"))
    buckets = parts.groupBy("sig").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max_by("component", "size").alias("most"), F.max("size").alias("top"))
    buckets = checkpointed(buckets.filter("parts > 1").select("sig", "most", ((F.col("all") - F.col("top")) * F.col("all")).alias("left")))
    return checkpointed(members.join(broadcast_if_small(buckets, BROADCAST_ROWS), "sig"))


def _in_components(members: DataFrame, links: DataFrame) -> DataFrame:
    found = broadcast_if_small(checkpointed(connected_components(links)), BROADCAST_ROWS)
    rows = members.drop("component", "most", "left").join(found, "node", "left")
    return rows.withColumn("component", F.coalesce("component", "node"))


def links(members: DataFrame, nodes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect all linked sets of ``members`` (sig, node, n, few, shared; ``shared``: in how many buckets a set is).

    ``nodes``: (node, odd, key1, key2); ``docs``: the texts.

    Two rounds of hubs, then all pairs across the components that are left in a bucket.  Where
    these are many, the sets of such buckets are first parted by a signature from another
    partition of the domain, which similar sets share as well.
    """
    members, found, sets = members.withColumn("component", F.col("node")), None, None
    keys, sketches = nodes.select("node", "key1", "key2"), nodes.select("node", "odd")
    for step in range(5):
        if step < 2:
            left = _hubs(members, F.col("shared") if step == 0 else F.xxhash64("node"))
        else:
            rows, words = members.agg(F.count("*"), F.sum("n")).first()
            if not rows:
                break
            across = members.select("sig", "left").distinct().agg(F.sum("left")).first()[0]
            if step < 4 and across > PAIRS_AN_ELEMENT * words:
                some = checkpointed(members.select("node").distinct())
                sets = _with_sets(sets, some, keys, docs)
                second = _resigned(sets.join(broadcast_if_small(some, BROADCAST_ROWS), "node", "left_semi"), num, den, step)
                members = members.drop("most", "left").join(second, "node").withColumn("sig", F.xxhash64("sig", "second")).drop("second")
                members = _mixed_only(checkpointed(_one_of_equal(checkpointed(members))))
                continue
            left = members.filter("component <> most")
        pairs = checkpointed(_pairs(left, members, sketches, num, den))
        sets = _with_sets(sets, pairs.select(F.explode(F.array("a", "b")).alias("node")), keys, docs)
        linked = checkpointed(_compared(pairs, sets, num, den))
        found = linked if found is None else checkpointed(found.unionByName(linked).distinct())
        if step >= 2:
            break
        members = _mixed_only(_in_components(members, found))
    return found


def jaccard_components(docs: DataFrame, keep: list[str], num: int = NUM, den: int = DEN) -> DataFrame:
    """``keep`` columns, ``n``, the size of each text's set of 3-word shingles, and ``component_id``, the smallest doc_id reachable over links.

    Texts link when den * intersection >= num * union of their sets.  Null, empty and word-free
    texts have no set and link with nothing; component_id is then their own doc_id.  Equal
    texts are one node whatever their number.  A null doc_id names no component but one that
    holds no other.  Repeated rows stay; an empty table gives no rows.
    """
    names = ["high", "low"]
    rows = checkpointed(_sets(docs.select(*keep, *text_key("text"), "text"), [*keep, "key1", "key2"], num, den))
    signed = rows.filter("signed IS NOT NULL").select(F.explode("signed").alias("sig"), *names)
    # names of different sets differ in their first half but for one in 2 ** 64
    shared = signed.groupBy("sig").agg(F.min("high").alias("a"), F.max("high").alias("b")).filter("a <> b").select("sig")
    members = checkpointed(signed.join(shared, "sig").distinct())
    some = members.groupBy(*names).agg(F.count("*").alias("shared"))
    first = rows.filter("signed IS NOT NULL").groupBy(*names).agg(*[F.first(c).alias(c) for c in ("n", "odd", "few")], F.min(F.struct("key1", "key2")).alias("key"))
    nodes = checkpointed(first.join(some, names).withColumn("node", F.monotonically_increasing_id()).select("*", "key.*").drop("key"))
    named = nodes.select(*names, "node", "n", "few", "shared")
    members = members.join(broadcast_if_small(named.select(*names, "node"), BROADCAST_ROWS), names).drop(*names)
    members = _one_of_equal(checkpointed(members)).join(broadcast_if_small(named.drop(*names), BROADCAST_ROWS), "node")
    components = connected_components(links(checkpointed(members), nodes, docs, num, den))
    named = nodes.join(components, "node").select(*names, "component")
    sizes = rows.groupBy(*names).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n")).filter("n > 0").drop("n")
    named = checkpointed(sizes.join(named, names, "left"))
    smallest = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component", "left").select(*names, "copies", F.coalesce("component_id", "least").alias("component_id"))
    named = checkpointed(named)
    # a set of very many rows would be one task's work in a shuffle
    hot = broadcast_if_small(named.filter(F.col("copies") >= HOT_COPIES).drop("copies"), BROADCAST_ROWS)
    rest = named.filter(F.col("copies") < HOT_COPIES).drop("copies")
    own, rows = rows.filter("n = 0").withColumn("component_id", F.col("doc_id")), rows.filter("n > 0").select(*keep, "n", *names)
    found = rows.join(hot, names).unionByName(rows.join(hot.select(*names), names, "left_anti").join(rest, names))
    return found.select(*keep, "n", "component_id").unionByName(own.select(*keep, "n", "component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at a Jaccard similarity of 0.9 of 3-word shingles.

    See ``jaccard_components`` for nulls, empty and repeated texts, ids and empty tables; very
    long texts have as many signatures as a tenth to a quarter of their words.
    """
    found = jaccard_components(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def oracle() -> str:
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
s AS MATERIALIZED (SELECT r, len(g) AS n, unnest(g) AS t FROM g),
l AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.r, b.r HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, c.component_id
FROM g JOIN (SELECT reach.a, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a) c ON c.a = g.r"""
