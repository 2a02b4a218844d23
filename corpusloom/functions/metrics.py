"""Retrieval-quality metrics and rank statistics over tables of ranked results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query, recall, precision, mrr, ndcg of the first k distinct ids (ranked: query, id, pos; relevant: query, id).

    Queries of ``relevant`` without results score 0.  Precision divides by the results
    there are, the ideal of ndcg by min(relevant, k).
    """
    once = ranked.groupBy("query", "id").agg(F.min("pos").alias("pos"))
    rn = F.row_number().over(Window.partitionBy("query").orderBy("pos", "id"))
    rows = once.withColumn("rn", rn).join(relevant.select("query", "id").distinct().withColumn("hit", F.lit(1)), ["query", "id"], "left")
    rows = rows.join(relevant.select("query").distinct(), "query", "left_semi")
    per = rows.groupBy("query").agg(
        F.sum(F.when(F.col("rn") <= k, F.coalesce("hit", F.lit(0)))).alias("hits"),
        F.sum((F.col("rn") <= k).cast("long")).alias("shown"),
        F.min(F.when(F.col("hit") == 1, F.col("rn"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & (F.col("rn") <= k), 1 / F.log2(F.col("rn") + 1))).alias("dcg"),
    )
    need = relevant.select("query", "id").distinct().groupBy("query").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = need.join(per, "query", "left")
    six = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return out.select(
        "query", six(F.col("hits") / F.col("n"), "recall"), six(F.col("hits") / F.col("shown"), "precision"), six(1 / F.col("first"), "mrr"), six(F.col("dcg") / ideal, "ndcg")
    )


def domain_coverage(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query and coverage: the share of expected domains among the first k results (1 when none is expected)."""
    seen = ranked.filter(F.col("pos") <= k).select("query", "domain").distinct().withColumn("hit", F.lit(1))
    rows = expected.select("query", "domain").distinct().join(seen, ["query", "domain"], "left")
    return rows.groupBy("query").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("coverage"))


def span_scores(chunks: DataFrame, spans: DataFrame, bucket: int = 1024) -> DataFrame:
    """query, precision, coverage, char_precision, iou of retrieved chunks against answer spans.

    chunks: query, file, start, end (a row for each retrieved chunk); spans: query, file, s, e.
    precision: chunks that touch a span; coverage: mean covered share of each span;
    char_precision and iou: over characters, overlaps counted once.
    """
    from corpusloom.operators.analytics import interval_union, overlap_join

    keyed = lambda df: df.withColumn("k", F.concat_ws("|", "query", "file"))
    shown_rows = keyed(chunks).select("query", "k", "start", "end")
    touched = overlap_join(shown_rows, keyed(spans).select("k", "s", "e"), "k", bucket)
    clipped = touched.select("query", "k", "s", "e", "start", "end", F.greatest("start", "s").alias("a"), F.least("end", "e").alias("b"))
    hits = clipped.select("query", "k", "start", "end").distinct()
    precision = shown_rows.join(hits.withColumn("hit", F.lit(1)), ["query", "k", "start", "end"], "left")
    precision = precision.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("precision"))
    per_span = interval_union(clipped, ["query", "k", "s", "e"], "a", "b")
    every = keyed(spans).select("query", "k", "s", "e").distinct()
    share = every.join(per_span, ["query", "k", "s", "e"], "left").withColumn("share", F.coalesce("covered", F.lit(0)) / (F.col("e") - F.col("s")))
    coverage = share.groupBy("query").agg(F.avg("share").alias("coverage"))
    both = interval_union(clipped, ["query", "k"], "a", "b").groupBy("query").agg(F.sum("covered").alias("shared"))
    shown = interval_union(keyed(chunks), ["query", "k"], "start", "end").groupBy("query").agg(F.sum("covered").alias("shown"))
    wanted = interval_union(every.withColumnsRenamed({"s": "a", "e": "b"}), ["query", "k"], "a", "b").groupBy("query").agg(F.sum("covered").alias("wanted"))
    out = coverage.join(precision, "query", "left").join(both, "query", "left").join(shown, "query", "left").join(wanted, "query", "left")
    shared = F.coalesce("shared", F.lit(0))
    six = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return out.select(
        "query", six(F.col("precision"), "precision"), six(F.col("coverage"), "coverage"), six(shared / F.col("shown"), "char_precision"),
        six(shared / (F.coalesce("shown", F.lit(0)) + F.col("wanted") - shared), "iou"),
    )


def token_f1(df: DataFrame, keys: list[str], answer: str, truth: str) -> DataFrame:
    """keys, token_recall, f1: multiset overlap of normalised tokens; two empty answers agree."""
    from corpusloom.functions.text import answer_tokens

    def counted(column: str, name: str) -> DataFrame:
        return df.select(*keys, F.explode(answer_tokens(F.col(column))).alias("t")).groupBy(*keys, "t").agg(F.count("*").alias(name))

    shared = counted(answer, "a").join(counted(truth, "b"), [*keys, "t"]).groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("shared"))
    sizes = df.select(*keys, F.size(answer_tokens(F.col(answer))).alias("na"), F.size(answer_tokens(F.col(truth))).alias("nb"))
    rows = sizes.join(shared, keys, "left")
    s = F.coalesce("shared", F.lit(0))
    empty = (F.col("na") == 0) & (F.col("nb") == 0)
    recall = F.when(F.col("nb") == 0, F.when(empty, 1.0).otherwise(0.0)).otherwise(s / F.col("nb"))
    f1 = F.when(empty, 1.0).when(s == 0, 0.0).otherwise(2 * s / (F.col("na") + F.col("nb")))
    return rows.select(*keys, F.round(recall, 6).alias("token_recall"), F.round(f1, 6).alias("f1"))


#: White space of any script.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def longest_run(answer: Column, context: Column) -> Column:
    """Share of the answer's words in its longest contiguous run that stands in the context, white space counting as one space.

    A run may begin and end within a word of the context, and case counts.  A fold goes along the answer with the longest run
    so far: a longer one from the same word makes it grow, else the next word is tried, so runs of any
    length are found with two looks at the context for each word.  Null or blank answers give 0, as do null contexts.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda x: x != "")

    def fold(both: Column) -> Column:
        n = F.size(both["w"])
        state = lambda at, best: F.struct(at.cast("int").alias("at"), best.cast("int").alias("best"))

        def step(now: Column, _: Column) -> Column:
            longer = F.array_join(F.slice(both["w"], now["at"] + 1, now["best"] + 1), " ")
            held = (now["at"] + now["best"] < n) & F.contains(both["c"], longer)
            return F.when(held, state(now["at"], now["best"] + 1)).otherwise(state(now["at"] + 1, now["best"]))

        return F.when(n == 0, 0.0).otherwise(F.reduce(F.sequence(F.lit(1), 2 * n), state(F.lit(0), F.lit(0)), step)["best"] / n)

    # the words and the text are made once for a row, outside the fold
    both = F.struct(words(answer).alias("w"), F.array_join(words(context), " ").alias("c"))
    return F.get(F.transform(F.array(both), fold), F.lit(0))


def _word_runs(df: DataFrame, key: str, size: int) -> DataFrame:
    """key, n (words), at, run: every run of ``size`` words and where it starts."""
    words = df.select(key, F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "").alias("w"))
    run = F.col("w")
    for i in range(1, size):
        run = F.zip_with(run, F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    words = words.select(key, F.size("w").alias("n"), run.alias("r"))
    return words.select(key, "n", F.posexplode_outer("r").alias("at", "run")).filter("run IS NOT NULL")


def coverage(items: DataFrame, contexts: DataFrame, item: str, context: str, size: int = 5) -> DataFrame:
    """item, context, share: of the item's words, those in the longest run that the context holds as it is.

    Runs of ``size`` words meet by equality; runs that go on along both texts are one.
    Pairs that share no run of that length have no row.
    """
    both = _word_runs(items, item, size).join(_word_runs(contexts, context, size).select(context, F.col("at").alias("there"), "run"), "run")
    both = both.withColumn("shift", F.col("at") - F.col("there"))
    along = Window.partitionBy(item, context, "shift").orderBy("at")
    parts = both.withColumn("part", F.col("at") - F.row_number().over(along))
    runs = parts.groupBy(item, context, "shift", "part").agg(F.count("*").alias("long"), F.first("n").alias("n"))
    longest = runs.groupBy(item, context).agg(F.max((F.col("long") + size - 1) / F.col("n")).alias("share"))
    return longest.withColumn("share", F.round("share", 6))


def matching_records(items: DataFrame, item: str, need: str, records: DataFrame, record: str, held: str) -> DataFrame:
    """item, matches, single: the records that hold all words an item needs, for items that need some and are held by some.

    Records are looked for by the item's rarest word alone, and then compared with all of its words.
    """
    words = records.select(record, F.explode(F.array_distinct(held)).alias("__word"))
    known = words.groupBy("__word").agg(F.count("*").alias("__n"))
    wanted = items.select(item, need, F.explode(need).alias("__word")).join(known, "__word", "left")
    # a word that no record holds is the rarest: the item finds nothing
    rarest = wanted.groupBy(item, need).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__word")).alias("__least"))
    found = rarest.select(item, need, F.col("__least.__word").alias("__word")).join(words, "__word").drop("__word")
    found = found.join(records.select(record, held), record).filter(F.size(F.array_except(need, held)) == 0)
    return found.groupBy(item).agg(F.count("*").alias("matches"), (F.count("*") == 1).alias("single"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 within keys; ties share their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than three rows or no variance."""
    return F.when((F.count("*") >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.round(F.corr(x, y), 6))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    rows = average_rank(average_rank(df, keys, x, "__rx"), keys, y, "__ry")
    return rows.groupBy(*keys).agg(pearson(F.col("__rx"), F.col("__ry")).alias("rho"))


def kendall(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """query and tau over the ids that two rankings share (query, id, pos; positions up to ``width``).

    Each query's shared list, bounded by the width of a ranking, is compared in place:
    no table of pairs is made.
    """
    both = a.filter(F.col("pos") <= width).select("query", "id", F.col("pos").alias("x")).join(b.filter(F.col("pos") <= width).select("query", "id", F.col("pos").alias("y")), ["query", "id"])
    lists = both.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    ys = F.transform("p", lambda e: e["y"])
    lists = lists.withColumn("ys", ys).withColumn("n", F.size("ys"))
    later = F.transform("ys", lambda y, i: F.aggregate(F.slice("ys", i + 2, F.col("n")), F.lit(0), lambda s, z: s + F.signum((z - y).cast("double")).cast("int")))
    total = F.aggregate(later, F.lit(0), lambda s, v: s + v)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return lists.select("query", F.when(F.col("n") >= 2, F.round(total / pairs, 6)).alias("tau"))


def crossvalidated(scores: DataFrame, folds: int = 5) -> DataFrame:
    """fold, k, train_mean, test_mean: the best k on the other folds (ties: the smallest) and its mean on the fold.

    scores: id, k, score.
    """
    fold = (F.crc32(F.col("id").cast("string").cast("binary")) % folds).alias("fold")
    per = scores.select(fold, "k", "score").groupBy("fold", "k").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    total = per.groupBy("k").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rows = per.join(F.broadcast(total), "k")  # a row for each k
    train = F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 6)
    w = Window.partitionBy("fold").orderBy(F.desc("train_mean"), "k")
    best = rows.select("fold", "k", train.alias("train_mean"), F.round(F.col("s") / F.col("n"), 6).alias("test_mean"))
    return best.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


#: Poisson(1): of 2 ** 32 draws so many are below 0, 1, 2 ... that is the least hash that gets each weight from 1 on.
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(i) for i in range(n)) * 2**32) for n in range(1, 9))


def poisson_medians(df: DataFrame, group: str, unit: str, value: str, replicates: int = 4000, bins: int = 1000) -> DataFrame:
    """group, median, low, high: the median of a value and its 95 % interval by a Poisson bootstrap.

    In replicate r a row counts as often as a hash of (unit, r) says: Poisson with mean 1.  Rows add up by
    replicate and bin (``bins`` to a unit of the value) before they are shuffled, and medians come from
    the bins, so no group of all rows is made and results don't depend on partitions.  A median is the lower
    edge of the least bin up to which half of the weight lies.  Nulls are left out.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(unit).cast("string").alias("__u"), F.floor(F.col(value) * bins).alias("__b"))
    # replicate 0 is the sample itself
    each = rows.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("__g").cast("string"), "__u", F.col("__r").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    weight = sum(((drawn >= least).cast("int") for least in POISSON), F.lit(0))
    each = each.withColumn("__w", F.when(F.col("__r") == 0, 1).otherwise(weight)).filter("__w > 0")
    held = each.groupBy("__g", "__r", "__b").agg(F.sum("__w").alias("__w"))
    of = Window.partitionBy("__g", "__r")
    run = held.withColumn("__upto", F.sum("__w").over(of.orderBy("__b"))).withColumn("__all", F.sum("__w").over(of))
    medians = run.filter(2 * F.col("__upto") >= F.col("__all")).groupBy("__g", "__r").agg((F.min("__b") / bins).alias("__m"))
    ranked = medians.filter("__r > 0").withColumn("__n", F.row_number().over(Window.partitionBy("__g").orderBy("__m", "__r"))).withColumn("__c", F.count("*").over(Window.partitionBy("__g")))
    at = lambda q: F.max(F.when(F.col("__n") == F.ceil(F.col("__c") * F.lit(q) / 1000), F.col("__m")))
    ends = ranked.groupBy("__g").agg(at(25).alias("low"), at(975).alias("high"))
    own = medians.filter("__r = 0").select("__g", F.col("__m").alias("median"))
    return own.join(ends, "__g").select(F.col("__g").alias(group), "median", "low", "high")
