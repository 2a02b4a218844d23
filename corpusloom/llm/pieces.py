"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text's piece lattice has an edge for every vocabulary piece at every place.  No
piece holds a character before a space or a line end inside it, so the lattice is
a chain of independent units (spaces and the word after them, or a line end); the
forward sums of equal units are shared.  Backward sampling then draws, for each
unit of each row, the last piece, the one before it and so on, with random numbers
that depend on the row's key and the unit's place only: the same row has the
same segmentation in any partition of the data.

Text is taken as it is: a space is written as the piece mark, and characters that
no piece covers, the mark itself among them, become UTF-8 byte pieces.  Decoding
is therefore lossless.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, table, texts_to_python

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Sharpness of the piece distribution: 1 samples by piece probability, 0 uniformly over segmentations.
THETA, SEED = 0.5, 11
MARK = "▁"
_UNITS = re.compile(r" *[^ \n]+|\n| +")
#: Texts are segmented together up to so many bytes; a longer text goes in parts of as many characters.
BATCH = 500_000
#: A unit of more characters (a script without spaces, a run of spaces) is drawn on its own, so many characters of its lattice at a time.
LONG, SEGMENT = 2000, 1 << 14
#: Lattices of so many distinct units are kept for a task's next texts, then forgotten.
UNITS = 30_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _may_hold_long(text: str) -> bool:
    """False only where no unit is longer than LONG: such a one fills a window of half that length."""
    half = LONG // 2
    windows = range(0, len(text) - half + 1, half)
    return " " * half in text or any(text.find(" ", k, k + half) < 0 and text.find("\n", k, k + half) < 0 for k in windows)


def _mix_one(x: int) -> int:
    """``_mix`` of one number."""
    x &= _ALL
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as text with plain spaces, their ids and weights, and the ids of the 256 bytes."""

    pieces: tuple[str, ...]
    ids: np.ndarray
    weights: np.ndarray
    byte_ids: np.ndarray
    size: int


def load(path: str = MODEL, theta: float = THETA) -> Vocabulary:
    """Read a model with byte fallback.

    Merge-ranked models have no piece probabilities; a piece then weighs
    1 / (2 + its rank), to the power theta.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    pieces = [model.id_to_piece(i).replace(MARK, " ") for i in plain]
    if any(" " in p.lstrip(" ") or "\n" in p for p in pieces):
        raise ValueError("a piece spans units; this vocabulary needs another split")
    order = np.argsort(np.argsort([-model.get_score(i) if model.get_score(i) > -1e8 else i for i in plain], kind="stable"))
    weights = (1.0 / (2.0 + order)) ** theta
    return Vocabulary(tuple(pieces), np.array(plain), weights / weights.sum(), byte_ids, n)


class Segmenter:
    """A vocabulary laid out for whole batches; built once in a task."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED) -> None:
        v, self.seed = vocabulary, np.array([seed], np.uint64)
        lengths = np.array([len(p) for p in v.pieces])
        self.longest = int(lengths.max())
        self.char_code = _mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))
        hashes = np.zeros(len(v.pieces), np.uint64)
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(lengths == n)
            points = np.frombuffer("".join(v.pieces[i] for i in own).encode("utf-32-le"), np.uint32).reshape(-1, n)
            for j in range(n):
                hashes[own] = self._push(hashes[own], self.char_code[points[:, j]])
        self.bits = 20
        slots = np.full(1 << self.bits, -1, np.int32)
        self.by_length = []
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(lengths == n)
            own = own[np.argsort(hashes[own])]
            self.by_length.append((hashes[own], own))
            slots[(hashes[own] >> np.uint64(64 - self.bits)).astype(np.int64)] = 1
        self.slots = slots > 0
        if any(len(np.unique(h)) < len(h) for h, _ in self.by_length):
            raise ValueError("two pieces have one hash")
        self.ids, self.weights, self.byte_ids = v.ids, v.weights, v.byte_ids
        self.scale = float(np.median(v.weights)) ** -0.5
        self.rare = float(v.weights.min()) * 1e-3
        self.bytes_of = [b""] * v.size
        for i, p in zip(v.ids, v.pieces, strict=True):
            self.bytes_of[i] = p.encode()
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.cum, self.length, self.drawn = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.last = np.zeros(0, np.int64)

    @staticmethod
    def _push(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h ^ code) * np.uint64(0xD6E8FEB86659FD93) + (h >> np.uint64(29))

    def _edges(self, chars: np.ndarray, left: np.ndarray):
        """(start, length, id, weight) of all edges; ``left``: characters to the end of the unit."""
        code = self.char_code[chars]
        starts, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        found = []
        covered = np.zeros(len(chars), bool)
        for n, (hashes, own) in enumerate(self.by_length, 1):
            keep = left[starts] >= n
            starts, h = starts[keep], h[keep]
            if not len(starts):
                break
            h = self._push(h, code[starts + (n - 1)])
            may = np.flatnonzero(self.slots[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            if len(may) and len(hashes):
                at = np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)
                hit = hashes[at] == h[may]
                s, p = starts[may[hit]], own[at[hit]]
                # the mark itself is text, not a space
                found.append((s, np.full(len(s), n, np.int32), self.ids[p], self.weights[p]))
                if n == 1:
                    covered[s] = True
        bare = np.flatnonzero(~covered)
        found.append((bare, np.ones(len(bare), np.int32), -1 - chars[bare].astype(np.int64), np.full(len(bare), self.rare)))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def _forward(self, units: list[str]):
        """Edges by end position, with the probabilities that backward sampling draws from, summed up."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        total = len(chars)
        first = np.repeat(ends - sizes, sizes)
        within = np.arange(total) - first
        start, length, ids, weight = self._edges(chars, np.repeat(ends, sizes) - np.arange(total))
        node = (start + length + np.repeat(np.arange(len(units)), sizes)[start]).astype(np.int32)  # n characters, n + 1 nodes
        order = np.argsort(node, kind="stable")
        start, length, ids, weight, node = (x[order] for x in (start, length, ids, weight, node))
        # scaled by a fixed factor for each character, so that sums stay in range; the shares don't change
        weight = weight * (self.scale ** np.arange(self.longest + 1))[length]
        depth = within[start] + length  # of the end within the unit
        longest = int(sizes.max())
        by_depth = np.argsort(depth.astype(np.uint16) if longest < 1 << 16 else depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(1, longest + 2))
        alpha = np.ones(total + len(units))
        share = np.empty(len(node))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            at = by_depth[lo:hi]
            n = node[at]
            value = alpha[n - length[at]] * weight[at]
            heads = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            sums = np.add.reduceat(value, heads)
            share[at] = value / np.repeat(sums, np.diff(np.r_[heads, hi - lo]))
            alpha[n[heads]] = sums
            if longest > 200 and not (1e-200 < sums.min() and sums.max() < 1e200):
                self._rescale(alpha, n[heads], sums)
        cum = np.cumsum(share)
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        last = np.r_[heads[1:], len(node)] - 1
        inside = cum - np.repeat(np.r_[0.0, cum[last[:-1]]], np.diff(np.r_[heads, len(node)]))
        inside[last] = 1.0
        return node + inside, length, ids, ends + np.arange(1, len(units) + 1) - 1

    def _learn(self, units: list[str]) -> None:
        """Append the lattices of new units to those at hand; nodes are numbered on."""
        cum, length, ids, last = self._forward(units)
        base = int(self.last[-1]) + 1 if len(self.last) else 0
        self.cum = np.concatenate([self.cum, cum + base])
        self.length = np.concatenate([self.length, length.astype(np.int32)])
        self.drawn = np.concatenate([self.drawn, ids.astype(np.int32)])
        self.last = np.concatenate([self.last, last + base])

    def _rescale(self, alpha: np.ndarray, nodes: np.ndarray, sums: np.ndarray) -> None:
        """Divide the window of each unit by its latest sum: shares only use ratios within a window."""
        for back in range(self.longest):
            at = np.maximum(nodes - back, 0)
            alpha[at] /= sums

    def encode(self, keys: np.ndarray, texts: list[str]) -> list[np.ndarray]:
        """The sampled ids of each text; ``keys`` seed the rows.  A very long text, or one with a very long unit, goes part by part."""
        long = {i for i, t in enumerate(texts) if len(t) > BATCH or _may_hold_long(t)}
        out = self._encode(keys, ["" if i in long else t for i, t in enumerate(texts)], np.zeros(len(texts), np.int64))
        for i in long:
            parts = []
            for part, place, n in self._parts(texts[i]):
                one = n == 1 and len(part) > LONG
                parts.append(self._draw_long(part, self._state(keys[i : i + 1], place)) if one else self._encode(keys[i : i + 1], [part], np.array([place]))[0])
            out[i] = np.concatenate(parts)
        return out

    def _state(self, keys: np.ndarray, place: int) -> int:
        """The random state of the unit at ``place`` of a row."""
        row = _mix(keys.astype(np.int64).view(np.uint64) + self.seed * _ODD)
        return int(_mix(row + np.array([place], np.uint64) * _ODD)[0])

    def _segment(self, chars: np.ndarray, lo: int, hi: int, window: list[float]):
        """Of the nodes from lo + 1 to hi: where each one's edges begin, their lengths, ids and running sums, and the window after them.

        ``window``: the forward sums of the nodes up to ``lo`` that an edge can begin at.
        """
        base = max(0, lo - self.longest + 1)
        start, length, ids, weight = self._edges(chars[base:hi], hi - np.arange(base, hi))
        end = base + start + length
        own = np.flatnonzero(end > lo)
        own = own[np.argsort(end[own], kind="stable")]
        heads = np.searchsorted(end[own], np.arange(lo + 1, hi + 2)).tolist()
        steps, drawn = length[own].tolist(), ids[own].tolist()
        weights = (weight[own] * (self.scale ** np.arange(self.longest + 1))[length[own]]).tolist()
        alpha, sums, at = window[-self.longest :], [], 0
        for stop in heads[1:]:
            total = 0.0
            for e in range(at, stop):
                total += alpha[-steps[e]] * weights[e]
                sums.append(total)
            at = stop
            alpha.append(total)
            if not 1e-100 < total < 1e100:  # shares only use ratios within a window
                alpha = [a / total for a in alpha[-self.longest :]]
        return heads, steps, drawn, sums, alpha[-self.longest :]

    def _draw_long(self, unit: str, state: int) -> np.ndarray:
        """One unit of any length, by segments: only the windows between them are kept from the forward pass."""
        chars = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
        begins, windows = list(range(0, len(chars), SEGMENT)), [[1.0]]
        for lo in begins:
            windows.append(self._segment(chars, lo, min(len(chars), lo + SEGMENT), windows[-1])[-1])
        out, node = [], len(chars)
        for lo, window in zip(reversed(begins), reversed(windows[:-1]), strict=True):
            if node <= lo:
                continue
            heads, steps, drawn, sums, _ = self._segment(chars, lo, node, window)
            while node > lo:
                state = _mix_one(state + int(_ODD))
                u = ((state >> 11) + 0.5) * 2.0**-53
                first, stop = heads[node - lo - 1], heads[node - lo]
                edge = min(bisect_right(sums, u * sums[stop - 1], first, stop), stop - 1)
                out.append(drawn[edge])
                node -= steps[edge]
        return self._spelled(np.array(out[::-1], np.int64))

    @staticmethod
    def _parts(text: str) -> Iterator[tuple[str, int, int]]:
        """Runs of whole units of about BATCH characters, a very long unit alone; with the number of units before and in each."""
        begin, end, before, n, alone = 0, 0, 0, 0, False
        for m in _UNITS.finditer(text):
            long = m.end() - m.start() > LONG
            if n and (alone or long or m.end() - begin > BATCH):
                yield text[begin:end], before, n
                begin, before, n = end, before + n, 0
            end, n, alone = m.end(), n + 1, long
        if n:
            yield text[begin:end], before, n

    def _encode(self, keys: np.ndarray, texts: list[str], places: np.ndarray) -> list[np.ndarray]:
        """``places``: the number of each text's first unit."""
        if len(self.known) > UNITS:
            self.forget()
        known, new = self.known, []
        flat: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            units = _UNITS.findall(t)
            counts[i] = len(units)
            numbers = list(map(known.get, units))
            if None in numbers:
                for j, u in enumerate(units):
                    if numbers[j] is None:
                        if (at := known.get(u)) is None:
                            at = known[u] = len(known)
                            new.append(u)
                        numbers[j] = at
            flat += numbers
        if not flat:
            return [np.zeros(0, np.int32) for _ in texts]
        if new:
            self._learn(new)
        cum, length, ids, last = self.cum, self.length, self.drawn, self.last
        unit = np.array(flat, np.int32)
        first = np.cumsum(counts) - counts
        place = (np.arange(len(unit)) + np.repeat(places - first, counts)).astype(np.uint64)
        row = _mix(keys.astype(np.int64).view(np.uint64) + self.seed * _ODD)
        state = _mix(np.repeat(row, counts) + place * _ODD)
        begins = np.r_[0, last[:-1] + 1]
        # equal units side by side, so that lookups stay close together
        live = np.argsort(unit, kind="stable")
        unit, state = unit[live], state[live]
        node, begin = last[unit], begins[unit]
        steps, drawn = np.zeros(len(unit), np.int64), []
        while len(live):
            state = _mix(state + _ODD)
            u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            # the sums of node n lie in (n, n + 1]
            edge = np.searchsorted(cum, node + u)
            drawn.append((live, ids[edge]))
            steps[live] += 1
            node = node - length[edge]
            more = np.flatnonzero(node > begin)
            live, node, begin, state = live[more], node[more], begin[more], state[more]
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]), np.int64)
        for k, (at, values) in enumerate(drawn):
            out[ends[at] - 1 - k] = values
        offsets = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return [self._spelled(out[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece (below zero) as the ids of their UTF-8 bytes."""
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids.astype(np.int32)
        points = -1 - ids[bare]
        if (points < 128).all():
            ids[bare] = self.byte_ids[points]
            return ids.astype(np.int32)
        spelled = [self.byte_ids[list(chr(p).encode())] for p in points.tolist()]
        widths = np.ones(len(ids), np.int64)
        widths[bare] = [len(s) for s in spelled]
        out = np.repeat(ids, widths)
        out[np.repeat(ids < 0, widths)] = np.concatenate(spelled)
        return out.astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()


_BUILT: dict[tuple, Segmenter] = {}


def _segmenter(vocabulary: Vocabulary, seed: int) -> Segmenter:
    """One for each worker process: tasks that follow each other share it."""
    name = (seed, vocabulary.size, vocabulary.weights.tobytes(), vocabulary.pieces)
    if hash(name) not in _BUILT:
        _BUILT.clear()
        _BUILT[hash(name)] = Segmenter(vocabulary, seed)
    return _BUILT[hash(name)]


def encode_rows(docs: DataFrame, keep: list[str], key: str = "doc_id", path: str = MODEL, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """``keep`` columns, ``ids`` (the sampled pieces of the whole text), ``n_ids`` and ``lossless``.

    ``lossless``: decoding the ids gave the text again.  Null texts count as empty and
    have no ids; a null key is key 0; rows that repeat a key and a text repeat the ids; an
    empty table gives no rows; columns that aren't kept are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(load(path, theta))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(held.value, seed)
        for batch in slices(batches, "__text", BATCH):
            at, by = batch.schema.get_field_index("__text"), batch.schema.get_field_index("__key")
            texts, keys = batch.column(at).to_pylist(), batch.column(by).to_numpy(zero_copy_only=False)
            ids = segmenter.encode(keys, texts)
            lossless = [segmenter.decode(x) == t for x, t in zip(ids, texts, strict=True)]
            sizes = np.array([len(x) for x in ids], np.int64)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)
            rest = [i for i in range(batch.num_columns) if i not in (at, by)]
            yield pa.record_batch(
                [*(batch.column(i) for i in rest), lists, pa.array(sizes), pa.array(lossless, pa.bool_())],
                [*(batch.schema.names[i] for i in rest), "ids", "n_ids", "lossless"],
            )
        segmenter.forget()  # the worker lives on

    number = F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("__key")
    rows = docs.select(*keep, number, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__text", "__key").schema)
    return texts_to_python(rows).mapInArrow(run, f"{types}, ids array<int>, n_ids long, lossless boolean")


def decode_rows(encoded: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """``keep`` columns and ``text``, the decoded ``ids``; null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(held.value, SEED)
        for batch in batches:
            at = batch.schema.get_field_index("__ids")
            texts = [None if x is None else segmenter.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch([*(batch.column(i) for i in rest), pa.array(texts, pa.string())], [*(batch.schema.names[i] for i in rest), "text"])

    rows = encoded.select(*keep, F.col("ids").alias("__ids"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__ids").schema)
    return texts_to_python(rows).mapInArrow(run, f"{types}, text string")


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, seeded by its id."""
    return encode_rows(table(spark, sf_dir, "documents"), ["doc_id"])
