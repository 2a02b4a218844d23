"""Hierarchical weighted hash tree: region, rack, shard.

A row descends the tree.  At each level every child draws ``-ln(u) / weight``
with ``u`` hashed from the child's name and the row's key, and the smallest draw
wins, so a child gets rows in proportion to its weight.  A changed weight alters
only that child's own draw: rows move into or out of its subtree and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import broadcast_if_small, table

#: Sub-buckets within a shard, so that numbering a shard is not one task's work: so many at least, and one for so many rows of the table.
SLOT_BUCKETS, BUCKET_ROWS = 256, 1_600_000
#: Groups of a shard and a bucket up to so many are broadcast with their first slots.
BROADCAST_GROUPS = 500_000


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf has a shard number and its own weight."""

    name: str
    shard: int | None = None
    own_weight: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(regions: int = 4, racks: int = 2, shards: int = 2) -> Node:
    """A root with equal regions, racks and shards, numbered from 0 in tree order."""
    number = iter(range(regions * racks * shards))
    return Node(
        "root",
        children=tuple(
            Node(
                f"r{i}",
                children=tuple(
                    Node(f"r{i}k{j}", children=tuple(Node(f"r{i}k{j}s{k}", next(number)) for k in range(shards)))
                    for j in range(racks)
                ),
            )
            for i in range(regions)
        ),
    )


def grown(tree: Node, weight: float = 1.0) -> Node:
    """One more shard, as a region of its own: rows move only into that shard.

    (A shard added to an existing rack would also raise the weights of the rack
    and the region above it, and rows drawn to those could land beside it.)
    """
    regions, number = len(tree.children), len(leaves(tree))
    shard = Node(f"r{regions}k0s0", number, weight)
    region = Node(f"r{regions}", children=(Node(f"r{regions}k0", children=(shard,)),))
    return Node(tree.name, children=(*tree.children, region))


def leaves(tree: Node) -> list[Node]:
    return [x for c in tree.children for x in leaves(c)] if tree.children else [tree]


def _draw(name: Column, weight: Column, key: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit("/"), key).cast("binary")), 1, 13), 16, 10)
    u = (bits.cast("double") + 0.5) / float(16**13)
    return -F.log(u) / weight


def _listed(nodes: tuple[Node, ...]) -> Column:
    """The children as a constant array that the draws run over."""
    return F.array(
        *[
            F.struct(
                F.lit(n.name).alias("name"),
                F.lit(float(n.weight)).alias("weight"),
                F.lit(i).alias("at"),
                F.lit(-1 if n.shard is None else n.shard).alias("shard"),
            )
            for i, n in enumerate(nodes)
        ]
    )


def _choose(children: Column, key: Column) -> Column:
    """The child with the smallest draw, as (draw, at, shard); equal draws go to the first."""
    return F.array_min(
        F.transform(
            children,
            lambda c: F.struct(
                _draw(c["name"], c["weight"], key).alias("draw"), c["at"].alias("at"), c["shard"].alias("shard")
            ),
        )
    )


def place(df: DataFrame, key: Column, tree: Node, out: str) -> DataFrame:
    """Add ``out``, the shard of each row; the three levels are three projections."""
    region, rack, k = f"__{out}_region", f"__{out}_rack", f"__{out}_key"
    racks = F.array(*[_listed(r.children) for r in tree.children])
    shards = F.array(*[F.array(*[_listed(x.children) for x in r.children]) for r in tree.children])
    df = df.withColumn(k, key)
    df = df.withColumn(region, _choose(_listed(tree.children), F.col(k))["at"])
    df = df.withColumn(rack, _choose(racks[F.col(region)], F.col(k))["at"])
    df = df.withColumn(out, _choose(shards[F.col(region)][F.col(rack)], F.col(k))["shard"])
    return df.drop(region, rack, k)


def assign_shards(docs: DataFrame, tree: Node, buckets: int | None = None) -> DataFrame:
    """Shard, slot within the shard and the shard after one shard more, of every row.

    Nulls: a null doc_id is the key ``null``; a null text has size 1 and the crc of
    the empty text.  Repeated rows land in one shard with a slot each.  Slots run
    from 0 without gaps in each shard, in order of (bucket, doc_id, crc, size).
    Only id, size and crc are shuffled, to ``shards * buckets`` groups, by id and text, so
    that rows which repeat an id or lack one spread too; the group counts (one row for
    BUCKET_ROWS rows of a shard) give each group's first slot.  Columns of the
    input other than doc_id and text are ignored; an empty table gives no rows.
    """
    buckets = buckets or max(SLOT_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = place(place(rows, key, tree, "shard"), key, grown(tree), "grown_shard")
    rows = rows.withColumn("__bucket", F.pmod(F.crc32(F.concat_ws("/", key, F.col("text_crc32").cast("string")).cast("binary")), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("__rn", F.row_number().over(within))
    # shards * buckets rows at most: 16 bytes for BUCKET_ROWS rows of a shard
    numbered = numbered.join(broadcast_if_small(first, BROADCAST_GROUPS), ["shard", "__bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("__first") + F.col("__rn") - 1).cast("long").alias("slot"),
        "grown_shard",
    )


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the law ``key``."""
    return assign_shards(table(spark, sf_dir, "documents"), even_tree())


def _sql_choice(nodes: tuple[Node, ...]) -> str:
    draws = [
        f"{{'d': -ln((('0x' || substr(md5('{n.name}/' || k), 1, 13))::BIGINT + 0.5) / {float(16**13)}) / {float(n.weight)}, 'i': {i}}}"
        for i, n in enumerate(nodes)
    ]
    return "0" if len(nodes) == 1 else f"list_min([{', '.join(draws)}]).i"


def _sql_levels(tree: Node, name: str) -> tuple[str, str, str]:
    racks = " ".join(f"WHEN {i} THEN {_sql_choice(r.children)}" for i, r in enumerate(tree.children))
    shards = " ".join(
        f"WHEN {i * 100 + j} THEN [{', '.join(str(x.shard) for x in k.children)}][1 + {_sql_choice(k.children)}]"
        for i, r in enumerate(tree.children)
        for j, k in enumerate(r.children)
    )
    return (
        f"{_sql_choice(tree.children)} AS {name}_region",
        f"CASE {name}_region {racks} END AS {name}_rack",
        f"CAST(CASE {name}_region * 100 + {name}_rack {shards} END AS INTEGER) AS {name}",
    )


def _crc_sql(of: str) -> str:
    """crc32 of a text as a fold over its UTF-8 bytes with the reflected polynomial's table."""
    byte = f"('0x' || substr(hex(encode({of})), 2 * i - 1, 2))::BIGINT"
    step = "xor(a >> 8, t[1 + (xor(a, b) & 255)])"
    bytes_ = f"list_transform(range(1, strlen({of}) + 1), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda a, b: {step}), 4294967295)"


def oracle() -> str:
    tree = even_tree()
    levels = list(zip(_sql_levels(tree, "shard"), _sql_levels(grown(tree), "grown_shard"), strict=True))
    polynomial = 0xEDB88320
    return f"""
WITH crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {polynomial}) ELSE a >> 1 END) AS v
    FROM range(256) r(n))),
d AS (SELECT doc_id, t, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents, crc),
a AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST({_crc_sql("text")} AS BIGINT) AS text_crc32,
  t, k, {", ".join(levels[0])} FROM d),
n AS (SELECT greatest({SLOT_BUCKETS}, CAST(ceil(count(*) / {BUCKET_ROWS}) AS BIGINT)) AS buckets FROM documents),
b AS (SELECT *, CAST({_crc_sql("(k || '/' || text_crc32)")} AS BIGINT) % buckets AS bucket, {", ".join(levels[1])} FROM a, n),
c AS (SELECT *, {", ".join(levels[2])} FROM b)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM c"""
