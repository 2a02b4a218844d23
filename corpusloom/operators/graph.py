"""Property-graph operators over node (id, label, ...) and edge (source, target, relation, ...) tables."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tables import cut

# Fixed value: how an unresolved target is written.
PENDING = "PENDING::"


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once: neighbour joins are then equalities."""
    one = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth): every node within ``depth`` hops of a seed, with its least distance.

    A level at a time; only nodes not seen before are expanded.
    """
    both = undirected(edges)
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(both, front["id"] == both["a"]).select(F.col("b").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


def simple_paths(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(start, hops, path): directed paths without repeats, as "label id -[relation]-> label id"."""
    named = nodes.select("id", F.concat_ws(" ", "label", "id").alias("name"))
    step = edges.join(named.select(F.col("id").alias("target"), F.col("name").alias("to")), "target").select("source", "target", "relation", "to")
    begin = seeds.select("id").distinct().join(named, "id")
    paths = begin.select(F.col("id").alias("start"), F.col("id").alias("last"), F.array("id").alias("visited"), F.col("name").alias("path"))
    out = None
    for hops in range(1, depth + 1):
        nxt = paths.join(step, paths["last"] == step["source"]).filter(~F.array_contains("visited", F.col("target")))
        paths = nxt.select("start", F.col("target").alias("last"), F.array_append("visited", F.col("target")).alias("visited"), F.concat("path", F.lit(" -["), "relation", F.lit("]-> "), "to").alias("path"))
        level = paths.select("start", F.lit(hops).alias("hops"), "path")
        out = level if out is None else out.unionByName(level)
    return out


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The edges between nodes within ``depth`` hops of the seeds."""
    near = within(edges, seeds, depth).select("id")
    inside = edges.join(near.select(F.col("id").alias("source")), "source", "left_semi")
    return inside.join(near.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns).distinct()


def resolve_pending(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pending targets become the least node id of that label; edges whose label no node has are dropped."""
    by_label = nodes.groupBy("label").agg(F.min("id").alias("__id"))
    label = F.when(F.startswith("target", F.lit(PENDING)), F.substring("target", len(PENDING) + 1, 1 << 30))
    rows = edges.withColumn("__label", label).join(by_label.withColumnRenamed("label", "__label"), "__label", "left")
    rows = rows.filter("__label IS NULL OR __id IS NOT NULL")
    return rows.withColumn("target", F.coalesce("__id", "target")).select(*edges.columns).distinct()


def drop_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after nodes are deleted: outgoing ones go, inbound CALLS and INHERITS become pending again, other inbound go."""
    left = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti")
    rows = left.join(gone.select(F.col("id").alias("target"), F.col("label").alias("__label")), "target", "left")
    kept = rows.filter(F.col("__label").isNull() | F.col("relation").isin("CALLS", "INHERITS"))
    target = F.when(F.col("__label").isNotNull(), F.concat(F.lit(PENDING), "__label")).otherwise(F.col("target"))
    return kept.withColumn("target", target).select(*edges.columns)


def expand_seeds(seeds: DataFrame, edges: DataFrame, depth: int, k: int) -> DataFrame:
    """id, score: seeds keep theirs, nodes reached get half of the least seed score; k at most, best first."""
    low = seeds.agg(F.min("score").alias("__low"))
    reached = within(edges, seeds, depth).filter("depth > 0").join(F.broadcast(low), how="cross")  # one row
    both = seeds.select("id", "score", F.lit(0).alias("depth")).unionByName(reached.select("id", F.round(F.col("__low") * 0.5, 4).alias("score"), "depth"))
    return both.orderBy(F.desc("score"), "depth", "id").limit(k).select("id", "score")


def _python_graph(text: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, source, target, line): nodes (class, function) and edges (CONTAINS, INHERITS, CALLS)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, owner = stack.pop()
        inside = owner
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            inside = f"{owner}.{node.name}" if owner else node.name
            yield ("class" if isinstance(node, ast.ClassDef) else "function", inside, "", node.lineno)
            if owner:
                yield ("CONTAINS", owner, inside, node.lineno)
            for base in getattr(node, "bases", []):
                if isinstance(base, (ast.Name, ast.Attribute)):
                    yield ("INHERITS", inside, PENDING + (base.id if isinstance(base, ast.Name) else base.attr), node.lineno)
        elif isinstance(node, ast.Call) and owner and isinstance(node.func, (ast.Name, ast.Attribute)):
            yield ("CALLS", owner, PENDING + (node.func.id if isinstance(node.func, ast.Name) else node.func.attr), node.lineno)
        stack += [(child, inside) for child in ast.iter_child_nodes(node)]


_NAMES = {
    "js": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+([A-Za-z_$][\w$]*)", re.M),
    "rs": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait)\s+([A-Za-z_]\w*)", re.M),
}


def code_rows(kind: str, text: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, source, target, line) of one code file; nothing for other types."""
    if kind == "py":
        yield from _python_graph(text)
    elif kind in ("js", "ts", "jsx", "tsx", "rs"):
        for m in _NAMES["rs" if kind == "rs" else "js"].finditer(text):
            yield ("class" if m[1] in ("class", "struct", "enum", "trait") else "function", m[2], "", text.count("\n", 0, m.start(2)) + 1)


def code_graph(files: DataFrame) -> DataFrame:
    """file_id, kind, source, target, line of the code files (file_id, type, text): Python by its syntax tree, others by definition lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, *x) for i, kind, text in zip(rows["file_id"], rows["type"], rows["text"], strict=True) for x in code_rows(kind, text or "")]
            yield pd.DataFrame(out, columns=["file_id", "kind", "source", "target", "line"])

    return files.select("file_id", "type", "text").mapInPandas(run, "file_id long, kind string, source string, target string, line long")
