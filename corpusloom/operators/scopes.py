"""Predicates and projections over paths, tags and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# States of a digest that never count as "unchanged".
DIGEST_STATES = ("", "ERROR", "CANCELLED", "NOCONTENT")
#: Prefixes of stub texts and the state each stands for.
STUBS = {"[BINARY:": "binary", "[UNREADABLE:": "unreadable", "[ENCRYPTED": "encrypted"}


def under(path: Column, folder: str) -> Column:
    """Equal to the folder or inside it; the name is literal, so no wildcard in it matches."""
    base = folder.rstrip("/\\")
    return (path == base) | path.startswith(base + "/") | path.startswith(base + "\\")


def same_folder_text(path: Column, fragment: str) -> Column:
    """Case-blind containment with separators levelled; wildcards in the fragment are literal."""
    plain = fragment.replace("\\", "/").lower()
    quoted = plain.replace("!", "!!").replace("%", "!%").replace("_", "!_")
    return F.like(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit(f"%{quoted}%"), F.lit("!"))


def having(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters that are given, all of them."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def suffix(path: Column) -> Column:
    """The extension in lower case without the dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def change_state(old: DataFrame, seen: DataFrame) -> DataFrame:
    """path and state (new, changed, unchanged, unreadable) of every file seen, against the rows known.

    Unchanged: same modification time and a digest that isn't one of DIGEST_STATES.
    """
    known = old.select("path", F.col("modified_s").alias("__m"), F.col("sha256").alias("__sha"), F.lit(True).alias("__known"))
    same = (F.col("modified_s") == F.col("__m")) & ~F.coalesce("__sha", F.lit("")).isin(*DIGEST_STATES)
    state = (
        F.when(F.col("modified_s").isNull(), "unreadable")
        .when(F.col("__known").isNull(), "new")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return seen.join(known, "path", "left").select("path", state.alias("state"))


def stub_state(text: Column) -> Column:
    out = F.lit("")
    for prefix, state in STUBS.items():
        out = F.when(text.startswith(prefix), state).otherwise(out)
    return out


def usable_summary(summary: Column) -> Column:
    return (F.coalesce(summary, F.lit("")) != "") & ~summary.startswith("[ERROR:")


def first_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the tag and path of the first root (by ``at``) that holds it; Unknown without one.

    Roots become an equality join on the ancestors of each file's path, so neither side is
    compared with all of the other.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.select("path", F.explode(ancestors).alias("root"))
    hits = each.join(roots.select("root", "tag", "at"), "root")
    first = hits.groupBy("path").agg(F.min_by(F.struct("tag", "root"), "at").alias("hit"))
    return files.join(first, "path", "left").select(
        "path", F.coalesce("hit.tag", F.lit("Unknown")).alias("tag"), F.coalesce("hit.root", F.lit("")).alias("root")
    )


def outermost(roots: DataFrame) -> DataFrame:
    """The folders that lie inside no other folder of the set."""
    parts = F.split("root", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = roots.filter(F.size(parts) > 1).select("root", F.explode(above).alias("up"))
    nested = inside.join(roots.select(F.col("root").alias("up")), "up").select("root").distinct()
    return roots.select("root").distinct().join(nested, "root", "left_anti")


def relevant(df: DataFrame, floor: float = -2.0, share: float = 0.5) -> DataFrame:
    """Cut a ranked list (columns query, pos, score, rerank_score).

    All rows reranked: those at or over the floor, else the first.  None reranked and
    a positive top: those at or over its share.  Otherwise all.
    """
    w = Window.partitionBy("query")
    df = df.withColumns({"__n": F.count("*").over(w), "__r": F.count("rerank_score").over(w), "__top": F.max(F.when(F.col("pos") == 1, F.col("score"))).over(w)})
    good = F.col("rerank_score") >= floor
    df = df.withColumn("__some", F.max(good.cast("int")).over(w))
    every = (F.col("__r") == F.col("__n")) & F.when(F.col("__some") == 1, good).otherwise(F.col("pos") == 1)
    none = (F.col("__r") == 0) & ((F.col("__top") <= 0) | (F.col("score") >= F.col("__top") * share))
    mixed = (F.col("__r") > 0) & (F.col("__r") < F.col("__n"))
    return df.filter(F.coalesce(every, F.lit(False)) | F.coalesce(none, F.lit(False)) | mixed).drop("__n", "__r", "__top", "__some")
