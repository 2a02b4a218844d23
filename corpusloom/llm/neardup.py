"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most two bits share a variant that
differs from each in at most one.  Every distinct fingerprint emits its 65
variants; sorted by variant, neighbours are linked, verified and joined up
to components.  All fingerprints of one variant lie within two bits of each
other, so linking neighbours keeps every component whole, and at most 65
fingerprints can share a variant.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import broadcast_if_small, checkpointed, slices, table, text_key, texts_to_python
from corpusloom.llm.components import connected_components

SHINGLE, SEED, CHUNK = 3, 42, 1 << 16
#: Fingerprints of so many rows are joined to them by broadcast, as there are few.
HOT_COPIES = 1000
#: Ids and fingerprints up to so many (about 40 bytes each) are broadcast; more go through a shuffle.
BROADCAST_IDS = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, CHUNK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[shingle - 1 + at :], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


#: A-Z to a-z; other bytes stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``fp``, the signed 64 bits of each whole text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            fps = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch(
                [*(batch.column(i) for i in rest), pa.array(fps)], [*(batch.schema.names[i] for i in rest), "fp"]
            )

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return texts_to_python(rows).mapInArrow(run, f"{types}, fp long")


def linked_pairs(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links within ``bits`` (even; variants within half of it) that connect all linked fingerprints."""
    if bits < 0 or bits % 2:
        raise ValueError("variants are emitted for an even radius")
    masks = [sum(1 << i for i in places) for n in range(bits // 2 + 1) for places in combinations(range(64), n)]
    flips = F.lit(np.array(masks, np.uint64).view(np.int64))
    # by the number of rows: each makes dozens, and adaptive execution would only see their size before
    fps = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", before.alias("b")).filter("b IS NOT NULL AND b <> fp")
    pairs = pairs.select(F.col("fp").alias("a"), "b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def near_duplicates(docs: DataFrame, keep: list[str], bits: int = 2) -> DataFrame:
    """``keep`` columns, ``fp``, ``component`` and ``component_id``, the smallest doc_id reachable over links.

    ``component`` is a fingerprint of the component, never null and of no other one; doc_ids may be
    null or repeated, so component_id need not tell components apart.
    Works on distinct fingerprints, so a group of copies of any size is one node.
    Null, empty and word-free texts have fingerprint 0 and are linked like any other.
    Null doc_ids never name a component unless it holds no other (then null).
    Repeated rows stay; an empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, keep))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    components = connected_components(linked_pairs(nodes.select("fp"), bits))
    named = nodes.join(components, nodes["fp"] == components["node"], "left")
    named = named.select("fp", "rep", "copies", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = checkpointed(named.join(least, "component").select("fp", "component", "component_id", "copies"))
    # a fingerprint of very many rows would be one task's work in a shuffle
    hot = broadcast_if_small(named.filter(F.col("copies") >= HOT_COPIES).drop("copies"), BROADCAST_IDS)
    rest = named.filter(F.col("copies") < HOT_COPIES).drop("copies")
    return rows.join(hot, "fp").unionByName(rows.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component stays: its smallest doc_id.

    Of rows that share that doc_id the first by text key stays, once.
    """
    found = near_duplicates(docs.select("doc_id", *text_key("text"), "text"), ["doc_id", "key1", "key2"], bits)
    ids = ["doc_id", "key1", "key2"]
    rows = found.groupBy("component", *ids).agg(F.count("*").alias("copies"))
    best = rows.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), *ids)).alias("best")
    )
    judged = rows.join(best, "component")
    stays = F.struct(*ids).eqNullSafe(F.struct(*[F.col("best")[c].alias(c) for c in ids]))
    judged = judged.select(*ids, "copies", stays.alias("stays"))
    judged = checkpointed(judged)
    gone = judged.filter("NOT stays").select(*[F.col(c).alias(f"__gone_{c}") for c in ids])
    named = docs.withColumns(dict(zip(("__own_key1", "__own_key2"), text_key("text"), strict=True)))
    same = F.col("doc_id").eqNullSafe(F.col("__gone_doc_id"))
    for c in ("key1", "key2"):
        same = same & (F.col(f"__own_{c}") == F.col(f"__gone_{c}"))
    kept = named.join(broadcast_if_small(gone, BROADCAST_IDS), same, "left_anti")
    repeated = judged.filter("stays AND copies > 1").select(*[F.col(c).alias(f"__gone_{c}") for c in ids])
    if not repeated.isEmpty():
        single = kept.join(broadcast_if_small(repeated, BROADCAST_IDS), same, "left_anti")
        once = kept.join(broadcast_if_small(repeated, BROADCAST_IDS), same, "left_semi")
        kept = single.unionByName(once.dropDuplicates(["doc_id", "__own_key1", "__own_key2"]))
    return kept.select(*docs.columns)
