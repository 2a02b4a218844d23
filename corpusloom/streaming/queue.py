"""The work queue as a stream of requests: state for each document, timers that give stale claims back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.state import ERROR_CHARS, QUEUE

#: Requests: ``seq`` orders those of a path, ``at`` is their time in seconds; the rest is as in ``operators.state``.
REQUESTS = "file_path string, seq long, at long, request string, pages array<int>, page_count int, tier string, force boolean, pages_done int, error string, terminal boolean"
#: Groups of paths; a number that stays as long as a checkpoint.
BUCKETS = 1024
_FIELDS = [f.split()[0] for f in QUEUE.split(", ")][1:]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(value: object, otherwise: int) -> int:
    return otherwise if pd.isna(value) else int(value)


def after(doc: dict | None, r: dict, stale_after: int, max_attempts: int) -> dict | None:
    """A document's row after one request; None stays None until it is enqueued."""
    request, now = r["request"], int(r["at"])
    if request == "enqueue":
        pages = sorted({int(p) for p in (r["pages"] if r["pages"] is not None else ()) if not pd.isna(p)})
        if not pages:
            return doc
        fresh = {"pages": pages, "page_count": _number(r["page_count"], 0), "pages_done": 0, "tier": r["tier"], "status": "pending", "force": bool(r["force"]), "attempts": 0, "last_error": ""}
        return fresh | {"enqueued_at": doc["enqueued_at"] if doc else now, "updated_at": now}
    if doc is None:
        return None
    running = doc["status"] == "running"
    if request == "claim":
        stale = running and doc["updated_at"] <= now - stale_after
        if doc["attempts"] < max_attempts and (stale or doc["status"] == "pending"):
            return doc | {"status": "running", "attempts": doc["attempts"] + 1, "updated_at": now}
        return doc
    if not running and request != "requeue":
        return doc
    error = (r["error"] if isinstance(r["error"], str) else "")[:ERROR_CHARS]
    changed = {
        "progress": lambda: {"pages_done": max(doc["pages_done"], _number(r["pages_done"], doc["pages_done"]))},
        "done": lambda: {"status": "done", "pages_done": len(doc["pages"]), "last_error": ""},
        "skipped": lambda: {"status": "skipped", "last_error": error},
        "failed": lambda: {"status": "failed" if r["terminal"] is True or r["terminal"] == 1 else "pending", "last_error": error},
        "release": lambda: {"status": "pending", "attempts": max(0, doc["attempts"] - 1)},
        "requeue": lambda: {"status": "pending", "attempts": 0, "last_error": ""},
    }.get(request)
    return doc | changed() | {"updated_at": now} if changed else doc


class _Queue(StatefulProcessor):
    """The rows of a bucket of documents, each under its path in keyed state.

    The claims of a batch share a timer; a document that is still running under its claim when that rings is pending again.
    """

    def __init__(self, stale_after: int, max_attempts: int, timers: bool) -> None:
        self.stale_after, self.max_attempts, self.timers = stale_after, max_attempts, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # ``due``: the time of the timer that a document's claim waits for, 0 for none
        self.docs = handle.getMapState("docs", "file_path string", ", ".join([*QUEUE.split(", ")[1:], "due long"]))
        self.waiting = handle.getMapState("waiting", "due long", "paths array<string>")

    def _get(self, path: str) -> dict | None:
        held = self.docs.getValue((path,))
        if held is None:
            return None
        doc = dict(zip([*_FIELDS, "due"], held, strict=True))
        return doc | {"pages": [int(p) for p in doc["pages"]]}

    def _put(self, path: str, doc: dict, due: int) -> tuple:
        row = tuple(doc[f] for f in _FIELDS)
        self.docs.updateValue((path,), (*row, due))
        return (path, *row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("seq", kind="stable")  # a bucket's requests of one batch
        of: dict[str, list[dict]] = {}
        for values in zip(*(asked[c].tolist() for c in asked.columns), strict=True):
            r = dict(zip(asked.columns, values, strict=True))
            of.setdefault(r["file_path"], []).append(r)
        due = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.stale_after if self.timers else 0
        out, running = [], []
        for path, requests in of.items():
            doc = self._get(path)
            for r in requests:
                doc = after(doc, r, self.stale_after, self.max_attempts)
            if doc is not None:
                claimed = self.timers and doc["status"] == "running"
                out.append(self._put(path, doc, due if claimed else 0))
                running += [path] if claimed else []
        if running:
            before = self.waiting.getValue((due,))
            self.waiting.updateValue((due,), ([*(before[0] if before else []), *running],))
            self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame(out, columns=["file_path", *_FIELDS])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        now, out = timerValues.getCurrentProcessingTimeInMs() // 1000, []
        for path in (self.waiting.getValue((due,)) or ([],))[0]:
            doc = self._get(path)
            if doc and doc["status"] == "running" and doc["due"] == due:
                out.append(self._put(path, doc | {"status": "pending", "updated_at": now}, 0))
        self.waiting.removeKey((due,))
        if out:
            yield pd.DataFrame(out, columns=["file_path", *_FIELDS])

    def close(self) -> None:
        pass


def queue_states(requests: DataFrame, stale_after: int = 900, max_attempts: int = 3, timers: bool = True) -> DataFrame:
    """The new row of each document that a micro-batch of REQUESTS touched, or whose claim went stale.

    Requests of a path apply in order of ``seq`` by the rules of ``operators.state``.  Any number of
    documents: their rows lie in the state store under their paths, dealt to BUCKETS groups, so that Python is
    called for a bucket of a micro-batch and not for a path.  Without ``timers`` a stale claim only
    comes back with the next claim; a stream that is to end (availableNow) needs that, as timers keep one running.
    """
    spark: SparkSession = requests.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)
    dealt = requests.withColumn("bucket", F.pmod(F.xxhash64("file_path"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Queue(stale_after, max_attempts, timers), outputStructType=QUEUE, outputMode="Update", timeMode="ProcessingTime" if timers else "None"
    )
