"""Work queue and page cache as state tables: each operator gives the table's new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The states of a queued document and the length an error is cut to.
STATES = ("pending", "running", "done", "failed", "skipped")
ERROR_CHARS = 500

QUEUE = (
    "file_path string, pages array<int>, page_count int, pages_done int, tier string, status string, force boolean, "
    "attempts int, last_error string, enqueued_at long, updated_at long"
)


def enqueue(queue: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Upsert by path: pages sorted and distinct; progress, attempts and error reset; the first enqueue time stays.

    Requests without pages change nothing; of several for a path the last (seq) counts.
    """
    pages = F.array_sort(F.array_distinct(F.filter("pages", lambda p: p.isNotNull())))
    rows = asked.withColumn("pages", pages).filter(F.size("pages") > 0)
    w = Window.partitionBy("file_path").orderBy(F.desc("seq"))
    rows = rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
    old = queue.select("file_path", F.col("enqueued_at").alias("__since"))
    fresh = rows.join(old, "file_path", "left").select(
        "file_path", "pages", F.col("page_count").cast("int").alias("page_count"), F.lit(0).alias("pages_done"), "tier", F.lit("pending").alias("status"), "force",
        F.lit(0).alias("attempts"), F.lit("").alias("last_error"), F.coalesce("__since", F.lit(now)).alias("enqueued_at"), F.lit(now).cast("long").alias("updated_at"),
    )
    return queue.join(fresh.select("file_path"), "file_path", "left_anti").unionByName(fresh)


def claimable(now: int, stale_after: int, max_attempts: int) -> Column:
    waiting = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("updated_at") <= now - stale_after))
    return waiting & (F.col("attempts") < max_attempts)


def claim(queue: DataFrame, now: int, stale_after: int = 900, max_attempts: int = 3, n: int = 1) -> DataFrame:
    """The table after the oldest ``n`` claimable documents were taken (``claimed`` tells which)."""
    taken = queue.filter(claimable(now, stale_after, max_attempts)).orderBy("enqueued_at", "file_path").limit(n).select("file_path", F.lit(True).alias("claimed"))
    rows = queue.join(F.broadcast(taken), "file_path", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))  # n rows
    got = F.col("claimed")
    return rows.withColumns(
        {
            "status": F.when(got, "running").otherwise(F.col("status")),
            "attempts": F.when(got, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "updated_at": F.when(got, F.lit(now).cast("long")).otherwise(F.col("updated_at")),
        }
    )


def apply_verdicts(queue: DataFrame, verdicts: DataFrame, now: int) -> DataFrame:
    """Apply one verdict for each path (file_path, verdict, pages_done, error, terminal).

    progress, done, failed, skipped and release only touch running rows; requeue any.
    failed goes back to pending unless terminal; release refunds the attempt.
    """
    v = verdicts.select("file_path", F.col("verdict").alias("__v"), F.col("pages_done").alias("__p"), F.col("error").alias("__e"), F.col("terminal").alias("__t"))
    rows = queue.join(v, "file_path", "left")
    asked, running = F.col("__v"), F.col("status") == "running"
    hit = asked.isNotNull() & (running | (asked == "requeue"))
    status = (
        F.when(~hit, F.col("status")).when(asked == "progress", "running").when(asked == "done", "done").when(asked == "skipped", "skipped")
        .when(asked.isin("release", "requeue"), "pending").when((asked == "failed") & F.col("__t"), "failed").when(asked == "failed", "pending").otherwise(F.col("status"))
    )
    error = F.when(hit & asked.isin("failed", "skipped"), F.substring(F.coalesce("__e", F.lit("")), 1, ERROR_CHARS)).when(hit & asked.isin("done", "requeue"), "").otherwise(F.col("last_error"))
    done = F.when(hit & (asked == "progress"), F.greatest("pages_done", "__p")).when(hit & (asked == "done"), F.size("pages")).otherwise(F.col("pages_done"))
    attempts = F.when(hit & (asked == "release"), F.greatest(F.lit(0), F.col("attempts") - 1)).when(hit & (asked == "requeue"), 0).otherwise(F.col("attempts"))
    return rows.select(
        "file_path", "pages", "page_count", done.alias("pages_done"), "tier", status.alias("status"), "force", attempts.alias("attempts"),
        error.alias("last_error"), "enqueued_at", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def reset_running(queue: DataFrame, now: int) -> DataFrame:
    stuck = F.col("status") == "running"
    return queue.withColumns({"updated_at": F.when(stuck, F.lit(now).cast("long")).otherwise(F.col("updated_at")), "status": F.when(stuck, "pending").otherwise(F.col("status"))})


def counts(queue: DataFrame) -> DataFrame:
    """status, n and owed, the pages still to do of pending and running documents."""
    owed = F.when(F.col("status").isin("pending", "running"), F.greatest(F.coalesce(F.size("pages"), F.lit(0)) - F.col("pages_done"), F.lit(0))).otherwise(0)
    return queue.groupBy("status").agg(F.count("*").alias("n"), F.sum(owed).alias("owed"))


def decoded(rows: DataFrame) -> DataFrame:
    """Raw rows with JSON pages: bad JSON is no pages, an unknown status is pending."""
    pages = F.coalesce(F.from_json("pages_json", "array<int>"), F.array().cast("array<int>"))
    return rows.withColumn("pages", pages).withColumn("status", F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("pending"))


def page_ranges(df: DataFrame, key: str, page: str, shown: int) -> DataFrame:
    """key and ranges: runs of pages as "1-3, 5", the first ``shown`` of them and how many more."""
    w = Window.partitionBy(key).orderBy(page)
    rows = df.select(key, page).distinct().withColumn("__g", F.col(page) - F.row_number().over(w))
    runs = rows.groupBy(key, "__g").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    lists = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r"))
    head = F.array_join(F.transform(F.slice("r", 1, shown), lambda x: x["t"]), ", ")
    more = F.when(F.size("r") > shown, F.concat(F.lit(" (+"), (F.size("r") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return lists.select(key, F.concat(head, more).alias("ranges"))


CACHE_KEY = ["content_key", "page_num", "model_version", "preproc_hash"]


def cache_hits(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    return cache.join(wanted.distinct(), CACHE_KEY, "left_semi")


def cache_put(cache: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cache with valid new rows in place of old ones, and the change of its bytes (one row).

    A key of other than 64 hex digits is invalid; so is a failed page without lines.
    """
    ok = F.col("content_key").rlike("^[0-9a-f]{64}$") & ~((F.coalesce("error", F.lit("")) != "") & (F.col("lines") == 0))
    fresh = new.filter(ok).select(*CACHE_KEY, "bytes", "last_used_at")
    old = cache.select(*CACHE_KEY, F.col("bytes").alias("__old"))
    delta = fresh.join(old, CACHE_KEY, "left").agg(F.coalesce(F.sum(F.col("bytes") - F.coalesce("__old", F.lit(0))), F.lit(0)).alias("delta"))
    return cache.join(fresh, CACHE_KEY, "left_anti").unionByName(fresh), delta


def clustered_lines(boxes: DataFrame, key: str) -> DataFrame:
    """key, line, col of text boxes (x, y, w, h): lines where centres part by over 0.6 of the height before, columns at gaps over 15 % of the width."""
    centre = F.col("y") + F.col("h") / 2
    rows = boxes.withColumn("__c", centre)
    down = Window.partitionBy(key).orderBy("__c", "x", *[c for c in boxes.columns if c.endswith("_id") and c != key])
    new_line = (F.col("__c") - F.lag("__c").over(down)) > F.lag("h").over(down) * 0.6
    rows = rows.withColumn("line", F.sum(F.coalesce(new_line.cast("int"), F.lit(0))).over(down))
    across = Window.partitionBy(key, "line").orderBy("x", "__c")
    width = F.max(F.col("x") + F.col("w")).over(Window.partitionBy(key))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(across)
    rows = rows.withColumn("__far", (F.coalesce(gap, F.lit(0)) > 0.15 * width).cast("int"))
    return rows.withColumn("col", F.sum("__far").over(across)).drop("__c", "__far")


def page_text(pages: DataFrame, floor: float) -> DataFrame:
    """Lines over the confidence floor joined by line ends, and their mean confidence (lines: array<struct<t, c>>)."""
    good = F.filter("lines", lambda x: x["c"] >= floor)
    mean = F.aggregate(good, F.lit(0.0), lambda a, x: a + x["c"]) / F.size(good)
    return pages.withColumns({"text": F.array_join(F.transform(good, lambda x: x["t"]), "\n"), "mean_conf": F.when(F.size(good) > 0, F.round(mean, 4))})
