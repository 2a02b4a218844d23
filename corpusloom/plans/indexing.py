"""The write path: what an index run puts into each table, and the engine's three verbs."""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import analytics, scopes
from corpusloom.plans import search

# Folders that are never indexed as roots, and the sizes of the result caches.
BLOCKED = ("/", "/bin", "/boot", "/dev", "/etc", "/lib", "/proc", "/sbin", "/sys", "/usr", "/var")
RESULTS_HELD, ANSWERS_HELD, VECTORS_HELD = 500, 200, 2000


def outputs(seen: DataFrame, known: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:  # P1, P2, P5
    """chunks and summaries of new and changed files, and all folder profiles."""
    fresh = scopes.change_state(known, seen).filter("state IN ('new', 'changed')").select("path")
    todo = seen.join(fresh, "path", "left_semi")
    return {
        "chunks": chunks.join(todo.select("file_id"), "file_id", "left_semi"),
        "summaries": todo.filter(scopes.usable_summary(F.col("summary"))).select("file_id", "summary"),
        "profiles": analytics.folder_profiles(seen),
    }


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32, chars: int = 10_240) -> DataFrame:  # P4
    """target, id, vector of (target, id, text): distinct texts of a batch are embedded once, shortest first, and scattered back.

    A call gets ``batch`` texts at most and, padded to the longest, ``chars`` characters, or one text.
    """

    def calls(texts: list[str]) -> Iterator[list[str]]:
        held: list[str] = []
        for t in texts:  # ascending: the newest is the longest
            if held and (len(held) == batch or (len(held) + 1) * len(t) > chars):
                yield held
                held = []
            held.append(t)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(2).to_pylist()
            known: dict[str, list[float]] = {}
            for some in calls(sorted(set(texts), key=lambda t: (len(t), t))):
                known.update(zip(some, embed(some), strict=True))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array([known[t] for t in texts], pa.list_(pa.float64()))], ["target", "id", "vector"])

    return rows.select("target", "id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "target string, id long, vector array<double>")


def reembedded(files: DataFrame, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:  # P8
    """target, id, vector: new vectors of every chunk, under its file's context prefix, and of every usable summary.

    They replace all vectors there were; nothing of the old ones is read.
    """
    prefix = F.concat(F.lit("["), F.upper("type"), F.lit(": "), F.element_at(F.split("path", "/"), -1), F.lit("] "))
    named = chunks.select("chunk_id", "file_id", "text").join(files.select("file_id", prefix.alias("prefix")), "file_id")
    rows = named.select(F.lit("chunk").alias("target"), F.col("chunk_id").alias("id"), F.concat("prefix", "text").alias("text"))
    usable = files.filter(scopes.usable_summary(F.col("summary")))
    return embedded(rows.unionByName(usable.select(F.lit("summary").alias("target"), F.col("file_id").alias("id"), F.col("summary").alias("text"))), embed)


def rebuilt(files: DataFrame, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str) -> dict[str, int]:  # P8
    """Write all vectors below ``path`` as a new state and count them; a rebuild without the summaries it should have fails."""
    from corpusloom.operators.tables import write_state

    state = write_state(reembedded(files, chunks, embed), path)
    counts = {r["target"]: r["count"] for r in state.groupBy("target").count().collect()}
    expected = files.filter(scopes.usable_summary(F.col("summary"))).count()
    if counts.get("summary", 0) != expected:
        raise RuntimeError(f"{counts.get('summary', 0)} of {expected} summaries were embedded")
    return counts


def index_run(seen: DataFrame, known: DataFrame, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str) -> dict[str, int]:  # P1, P2, P5
    """Write what one run gives to each table below ``path``, chunks before their vectors, and count the rows.

    Spark's tasks are the bounded stages: each reads, cuts and embeds a partition's rows in
    batches, and a task's output is committed whole or not at all.
    """
    from corpusloom.operators.tables import write_state

    parts = outputs(seen, known, chunks)
    written = {name: write_state(df, f"{path}/{name}") for name, df in parts.items()}
    rows = written["chunks"].select(F.lit("chunk").alias("target"), F.col("chunk_id").alias("id"), "text")
    written["vectors"] = write_state(embedded(rows, embed), f"{path}/vectors")
    return {name: df.count() for name, df in written.items()}


def polled(roots: Callable[[], list[str]], locked: Callable[[], bool], index: Callable[[list[str]], object]) -> list[str]:  # P9
    """One poll: the watched roots are indexed unless a run is under way or there is none; gives those handed on.

    A skipped poll loses nothing, as the next one compares with the files again.
    """
    found = [] if locked() else roots()
    if found:
        index(found)
    return found


def validated_folders(folders: list[str]) -> list[str]:  # D10
    """Absolute roots that are no system folder, each once, in order."""
    out = []
    for f in folders:
        path = os.path.normpath(f)
        if os.path.isabs(path) and path not in BLOCKED and path not in out:
            out.append(path)
    return out


def same_model(stored: dict[str, str] | None, current: dict[str, str]) -> bool:  # P10
    """Vectors of another model or width can't be searched with this one's."""
    return stored is None or all(stored.get(k) == v for k, v in current.items())


class Engine:  # R22, R26, R29
    """Retrieve, look up a chunk, count the corpus: plans over three tables.

    Rows of recent questions are held on the driver by (question, scope, generation);
    a new generation of the index forgets them.
    """

    def __init__(self, files: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Callable[[str], list[float]], prefix: str = "") -> None:
        self.files, self.chunks, self.vectors, self.model = files, chunks, vectors, embed
        self.prefix = prefix
        self.generation = 0
        self.held: OrderedDict[tuple, list] = OrderedDict()
        self.asked: OrderedDict[str, list[float]] = OrderedDict()

    def embed(self, question: str) -> list[float]:  # P11
        """The vector of a question under the model's instruction; those of recent questions are held."""
        if question not in self.asked:
            self.asked[question] = self.model(self.prefix + question)
            while len(self.asked) > VECTORS_HELD:
                self.asked.popitem(last=False)
        self.asked.move_to_end(question)
        return self.asked[question]

    def replace(self, files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> None:
        self.files, self.chunks, self.vectors = files, chunks, vectors
        self.generation += 1
        self.held.clear()

    def retrieve(self, question: str, k: int = 15, rerank: Callable[[DataFrame], DataFrame] | None = None, **scope: object) -> list:
        name = (question, k, rerank, tuple(sorted(scope.items())), self.generation)
        if name not in self.held:
            files = scopes.having(self.files, **scope)
            inside = self.chunks.join(files.select("file_id"), "file_id", "left_semi") if scope else self.chunks
            terms = [w for w in question.lower().split() if len(w) >= 3]
            rows = search.hybrid(inside, files.select("file_id", F.col("folder_tag").alias("domain")), self.vectors, terms, self.embed(question), k, rerank=rerank)
            self.held[name] = rows.orderBy("rank").collect()  # k rows
            while len(self.held) > RESULTS_HELD:
                self.held.popitem(last=False)
        self.held.move_to_end(name)
        return self.held[name]

    def chunk(self, chunk_id: int) -> DataFrame:
        return self.chunks.filter(F.col("chunk_id") == chunk_id)

    def stats(self) -> DataFrame:
        return analytics.tagged_counts(self.files)


def agentic(question: str, decompose: Callable[[str], list[str]], retrieve: Callable[[str], list[tuple]], enough: Callable[[list[tuple]], bool], rounds: int = 3, budget: int = 6000) -> tuple[list[tuple], list[str]]:  # R20
    """Evidence (id, score, tokens) and a trace: sub-questions are asked until there is enough.

    It also ends when a round finds nothing new or the token budget is spent.  Retrieval
    and judgement are injected; only bounded result rows are held here.
    """
    best: dict[object, tuple] = {}
    asked, trace, spent = [], [], 0
    todo = [q for q in decompose(question) if q.strip()] or [question]
    for number in range(1, rounds + 1):
        new = 0
        for q in todo:
            for row in retrieve(q):
                key, score, tokens = row[:3]
                if key not in best:
                    if spent + tokens > budget:
                        continue
                    new, spent = new + 1, spent + tokens
                    best[key] = row
                elif score > best[key][1]:
                    best[key] = row
        asked += todo
        found = sorted(best.values(), key=lambda r: (-r[1], str(r[0])))
        trace.append(f"round {number}: {len(todo)} asked, {new} new")
        if new == 0 or spent >= budget or enough(found):
            break
        todo = [q for q in decompose(question + " " + str(number)) if q not in asked]
        if not todo:
            break
    return sorted(best.values(), key=lambda r: (-r[1], str(r[0]))), trace
