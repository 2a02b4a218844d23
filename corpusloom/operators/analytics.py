"""Aggregations: histograms, roll-ups, intervals, percentiles and project detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.scopes import basename, suffix

# Project types and what must be present for each, first match wins.
PROJECT_SIGNATURES = (
    ("Unity", (("dir", "Assets"), ("ext", ".unity"))),
    ("Unity", (("ext", ".unity"),)),
    ("Godot", (("file", "project.godot"),)),
    ("React", (("file", "package.json"), ("dir", "src"))),
    ("Node.js", (("file", "package.json"),)),
    ("Python", (("file", "pyproject.toml"),)),
    ("Python", (("file", "setup.py"),)),
    ("Python", (("file", "requirements.txt"),)),
    ("Rust", (("file", "Cargo.toml"),)),
    ("Go", (("file", "go.mod"),)),
    ("Java/Maven", (("file", "pom.xml"),)),
    ("Java/Gradle", (("file", "build.gradle"),)),
    (".NET/C#", (("ext", ".csproj"),)),
    ("C/C++", (("file", "CMakeLists.txt"),)),
    ("C/C++", (("file", "Makefile"),)),
    ("LaTeX", (("ext", ".tex"),)),
)
# Names and extensions of files that a profile shows.
KEY_NAMES = (
    "readme.md readme.txt readme package.json pyproject.toml setup.py requirements.txt cargo.toml go.mod pom.xml "
    "build.gradle cmakelists.txt makefile .gitignore dockerfile docker-compose.yml"
).split()
KEY_SUFFIXES = ("sln", "csproj", "unity")


def tagged_counts(files: DataFrame) -> DataFrame:
    """(src, label, cnt, bytes): by type and by folder in one scan, by grouping sets."""
    sets = files.groupingSets([["type"], ["folder_tag"]], "type", "folder_tag").agg(
        F.grouping("type").alias("__g"), F.count("*").alias("cnt"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )
    by_type = F.col("__g") == 0
    return sets.select(F.when(by_type, "type").otherwise("folder").alias("src"), F.when(by_type, F.col("type")).otherwise(F.col("folder_tag")).alias("label"), "cnt", "bytes")


def cold_and_large(files: DataFrame, large: int, cold: int) -> DataFrame:
    """(list, rank, path): the largest files, and those used least (ties: largest first)."""
    big = files.orderBy(F.desc("size"), "path").limit(large)
    old = files.orderBy("usage_count", F.desc("size"), "path").limit(cold)
    rank = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("long").alias("rank")  # noqa: E731  over the top-k only
    a = big.select(F.lit("large").alias("list"), rank(F.desc("size"), "path"), "path")
    return a.unionByName(old.select(F.lit("cold").alias("list"), rank("usage_count", F.desc("size"), "path"), "path"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark cuts each partition's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).filter(F.col(name) <= n)


def folder_profiles(files: DataFrame) -> DataFrame:
    """root_path, file_count, total_size, top_extensions ("ext: n, ..." of eight), key_files (15), project."""
    by_ext = files.groupBy("root_path", "type").agg(F.count("*").alias("n"))
    top = top_per(by_ext, ["root_path"], [F.desc("n"), F.asc("type")], 8)
    shown = top.groupBy("root_path").agg(F.array_sort(F.collect_list(F.struct("rank", "type", "n"))).alias("x"))
    shown = shown.select("root_path", F.array_join(F.transform("x", lambda e: F.concat(e["type"], F.lit(": "), e["n"].cast("string"))), ", ").alias("top_extensions"))
    name = F.lower(basename(F.col("path")))
    keys = files.filter(name.isin(*KEY_NAMES) | suffix(F.col("path")).isin(*KEY_SUFFIXES))
    keys = top_per(keys, ["root_path"], [F.asc("path")], 15).groupBy("root_path").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("key_files"))
    totals = files.groupBy("root_path").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))
    return totals.join(shown, "root_path", "left").join(keys, "root_path", "left").withColumn("key_files", F.coalesce("key_files", F.lit("")))


def project_types(files: DataFrame) -> DataFrame:
    """root_path and project: the first signature that the root's names meet, else its commonest extension.

    File names and extensions are matched in lower case, folders as they are.
    """
    name, ext = F.lower(basename(F.col("path"))), suffix(F.col("path"))
    inner = F.substr(F.col("path"), F.length("root_path") + 2)
    folder = F.when(F.contains(inner, F.lit("/")), F.split(inner, "/")[0])
    tests = {}
    for _, needs in PROJECT_SIGNATURES:
        for kind, what in needs:
            at = {"ext": ext == what.lower().lstrip("."), "file": name == what.lower(), "dir": folder == what}[kind]
            tests[kind, what] = F.max(F.coalesce(at, F.lit(False)))
    names = {need: f"__t{i}" for i, need in enumerate(tests)}
    seen = files.groupBy("root_path").agg(*[t.alias(names[need]) for need, t in tests.items()])
    commonest = top_per(files.filter(ext != "").groupBy("root_path", ext.alias("ext")).agg(F.count("*").alias("n")), ["root_path"], [F.desc("n"), F.asc("ext")], 1)
    project = F.concat(F.lit("."), F.col("ext"), F.lit(" files"))
    project = F.coalesce(project, F.lit("unknown"))
    for label, needs in reversed(PROJECT_SIGNATURES):
        met = F.lit(True)
        for need in needs:
            met = met & F.col(names[need])
        project = F.when(met, label).otherwise(project)
    return seen.join(commonest.select("root_path", "ext"), "root_path", "left").select("root_path", project.alias("project"))


def ancestor_rollup(files: DataFrame) -> DataFrame:
    """folder, n_files, size, usage over everything below each folder."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.filter(F.size(parts) > 2).select(F.explode(above).alias("folder"), "size", "usage_count")
    return each.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"), F.sum("usage_count").alias("usage"))


def collapsed_chains(rollup: DataFrame, files: DataFrame) -> DataFrame:
    """Folders with one child folder and no own file give way to that child, whose ``name`` then names the whole chain.

    A folder is such a link when exactly one folder lies directly below it and no file
    does.  A kept folder takes the names of the links right above it, as ``a / b / c``.
    """
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    children = rollup.select(parent(F.col("folder")).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))
    own = files.select(parent(F.col("path")).alias("folder")).distinct()
    links = children.filter("n = 1").join(own, "folder", "left_anti").select("folder")
    kept = rollup.join(links, "folder", "left_anti")
    # every kept folder with those above it; after the last of these that is no link, the names are its own
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))
    each = kept.filter(F.size(parts) > 2).select("folder", F.explode(above).alias("a")).select("folder", "a.i", "a.up")
    last = each.join(links.select(F.col("folder").alias("up")), "up", "left_anti").groupBy("folder").agg(F.max("i").alias("last"))
    named = kept.join(last, "folder", "left")
    return named.withColumn("name", F.array_join(F.slice(parts, F.coalesce("last", F.lit(1)) + 1, F.size(parts)), " / ")).drop("last")


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys and covered: the length of the union of each key's half-open intervals."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(end).over(w), F.col(start))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), reach))
    rows = df.filter(F.col(end) > F.col(start)).withColumn("__gain", gain)
    return rows.groupBy(*keys).agg(F.sum("__gain").alias("covered"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of one key whose half-open spans (start, end / s, e) overlap, each once.

    Spans meet in the buckets of offsets they touch; a pair is taken in the first one
    they share, so the join is an equality on (key, bucket).
    """
    def spread(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.filter(F.col(b) > F.col(a)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket))))

    both = spread(left, "start", "end").join(spread(right, "s", "e"), [key, "__b"])
    first = F.col("__b") == F.floor(F.greatest("start", "s") / bucket)
    return both.filter((F.col("start") < F.col("e")) & (F.col("end") > F.col("s")) & first).drop("__b")


def exclusive_percentile(values: Column, p: float) -> Column:
    """Percentile at (n + 1) p of a sorted array, interpolated; the only value where there is one."""
    n = F.size(values)
    at = (n + 1) * F.lit(p)
    # beyond both ends the nearest two values are carried on
    j = F.greatest(F.lit(1), F.least(F.floor(at).cast("int"), n - 1))
    x, y = F.get(values, j - 1), F.get(values, j)
    return F.when(n == 1, F.get(values, F.lit(0))).otherwise(x + (y - x) * (at - j))


def latency_stats(df: DataFrame, key: str, order: list[Column], value: str, last: int = 100) -> DataFrame:
    """avg, p50, p95, p99, max, n over the last values of each key, to two places."""
    rows = top_per(df.filter(F.col(value).isNotNull()), [key], order, last)
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("v"), F.avg(value).alias("a"))  # ``last`` values at most
    two = lambda c, name: F.round(c, 2).alias(name)
    return held.select(
        key, two(F.col("a"), "avg"), *[two(exclusive_percentile(F.col("v"), p / 100), f"p{p}") for p in (50, 95, 99)],
        two(F.array_max("v"), "max"), F.size("v").cast("long").alias("n"),
    )


def nearest_percentile(values: Column, q: float) -> Column:
    """The sorted array's value at min(n - 1, floor(n q))."""
    n = F.size(values)
    return F.get(values, F.least(n - 1, F.floor(n * F.lit(q)).cast("int")))


def sections(df: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """group, order, line: the lines of each section in their order, empty ones left out; the first carries the heading.

    A section stays a set of rows, so one of any length is no single value in one task.
    """
    rows = df.filter(F.length(line) > 0).select(group, order, line)
    first = rows.groupBy(group).agg(F.min(order).alias("__first"))
    head = F.when(F.col(order) == F.col("__first"), F.concat(F.lit("## "), group, F.lit("\n\n"), line)).otherwise(F.col(line))
    return rows.join(first, group).select(group, order, head.alias(line))


def expanded(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """A row for each combination of the values in texts like ``k=10,20 w=0.4``, one column a name, in place of the text.

    Words without ``=`` and names that aren't asked for are ignored; a row that lacks a name has no combination.
    """
    pairs = F.filter(F.split(text, r"\s+"), lambda p: F.contains(p, F.lit("=")))
    held = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.split(F.split_part(p, F.lit("="), F.lit(2)), ",").alias("values")))
    rows = df.withColumn("__held", held)

    def values(name: str) -> Column:
        own = F.filter("__held", lambda h: h["name"] == name)
        return F.flatten(F.transform(own, lambda h: h["values"]))

    for name in names:
        rows = rows.withColumn(name, F.explode(values(name)))
    return rows.drop("__held", text)


def paths_from_parents(nodes: DataFrame) -> DataFrame:
    """id, path, depth from an adjacency list (id, parent, name); roots have parent 0.

    By pointer doubling: in each round a node joins the node that it points to, takes over where that
    one points and sets its path before its own, so a tree of any depth takes as many rounds as the depth
    has binary digits.  Nodes that no root is above (a parent that isn't there, a circle) have no row.
    """
    from corpusloom.operators.tables import cut

    up = F.when(F.col("parent") != 0, F.col("parent"))
    rows = cut(nodes.filter("id IS NOT NULL AND parent IS NOT NULL").select("id", up.alias("up"), F.concat(F.lit("/"), "name").alias("path"), F.lit(1).cast("long").alias("depth")))
    before = None
    while True:
        going = rows.filter("up IS NOT NULL")
        left = going.count()
        if left in (0, before):  # each round ends some node of a tree, so those that remain go in circles
            break
        before = left
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("over"), F.col("depth").alias("more"))
        moved = going.join(above, "up").select("id", F.col("next").alias("up"), F.concat("over", "path").alias("path"), (F.col("depth") + F.col("more")).alias("depth"))
        rows = cut(rows.filter("up IS NULL").unionByName(moved))
    return rows.filter("up IS NULL").select("id", "path", F.col("depth").cast("int").alias("depth"))
