"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are folded: lower case, runs of anything but ASCII letters, digits and non-ASCII characters read as one
blank.  Benchmark items become patterns of bytes: items up to ``segment`` bytes as they are, longer ones
as segments of that many bytes, half a segment apart, so that a leaked part of 1.5 segments is sure to be found as well.
A pattern of m bytes may differ by e = floor(rate * m) edits.  By the q-gram lemma a match within e edits shares at
least m - q + 1 - q * e q-grams with the pattern, and they lie on at most e + 1 neighbouring diagonals.
Shared q-grams are counted in bands of two cells of e + 1 diagonals, a cell apart, so each match falls whole
into some band; bands that reach the bound are verified by an alignment banded to those diagonals
and e to either side.  Items of under ``least`` bytes, for which the lemma promises no shared q-gram, are found exactly, as
whole words, by an automaton over all of them.

The benchmark goes to the workers in blocks of at most ``block`` bytes of text, each by one pass over the
documents.  With more than one block a pass is written before the next block is sent, and its block let go; so one
block at a time is held, whatever the benchmark's size.

Defined results: null items and items without a letter or digit are not searched; null and empty texts hold nothing.  A null
item_id or doc_id is kept as such.  ``matches`` gives repeated rows repeated results; ``contaminated`` has one row per doc_id,
all rows without one together; ``clean`` judges each row by its own text, whatever its doc_id.  Repeated items
each count.  Other columns are ignored by the former and kept by the latter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw, slices, small_batches

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
Q, _BITS, _AT_ONCE = 12, 22, 1 << 22


def fold(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of folded texts."""
    data, at = raw(pc.utf8_lower(texts))
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    blank = data == 0x20
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = at[(at > 0) & (at < len(data))]
    keep[inner] = True
    size = np.r_[0, keep.cumsum()]
    return data[keep], size[at]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 12 bytes from each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    a = np.ndarray(n, "<u8", data.data, 0, (1,))
    b = np.ndarray(n, "<u8", data.data, Q - 8, (1,))
    h = a * _C1 + b * _C2
    return h ^ (h >> np.uint64(29))


class Patterns:
    """Patterns of benchmark items and an index of their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, segment: int, least: int) -> None:
        data, at = fold(pa.array([t for _, t in items], pa.string()))
        self.items, self.text, grams = [], [], []
        self.short: dict[str, list[int | None]] = {}
        for (item, _), a, b in zip(items, at[:-1].tolist(), at[1:].tolist()):
            own = data[a:b].tobytes().strip(b" ")
            if not own:
                continue
            if len(own) < least:
                self.short.setdefault(f" {own.decode('latin-1')} ", []).append(item)
                continue
            own = np.frombuffer(own, np.uint8)
            starts = [0] if len(own) <= segment else sorted({*range(0, len(own) - segment, segment // 2), len(own) - segment})
            for s in starts:
                self.items.append(item)
                self.text.append(own[s : s + segment])
        self._automaton = None
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.floor(rate * self.size).astype(np.int64)
        self.bound = np.maximum(1, self.size - Q + 1 - Q * self.edits)
        for t in self.text:
            grams.append(_grams(t))
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.which, self.place = hashes[order], which[order], place[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hashes * _C2) >> np.uint64(64 - _BITS)] = True
        self.widest = int(self.size.max()) if len(self.size) else 0
        self.padded = np.zeros((len(self.text), self.widest), np.uint8)
        for i, t in enumerate(self.text):
            self.padded[i, : len(t)] = t

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def words(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int | None, int]]:
        """(text, item, end in it) of each short item that stands in a text as whole words."""
        if not self.short:
            return
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for text, items in self.short.items():
                self._automaton.add_word(text, (len(text), items))
            self._automaton.make_automaton()
        for doc, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            own = f" {data[a:b].tobytes().decode('latin-1').strip(' ')} "
            lead = int(b > a and data[a] == 0x20)
            for end, (_, items) in self._automaton.iter(own):
                for item in items:
                    yield doc, item, end - 1 + lead

    def candidates(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, cell) of the bands that reach their bound."""
        none = np.zeros(0, np.int64)
        grams = _grams(data)
        hit = np.flatnonzero(self.seen[(grams * _C2) >> np.uint64(64 - _BITS)]) if len(grams) else none
        lo, hi = np.searchsorted(self.hashes, grams[hit]), np.searchsorted(self.hashes, grams[hit], side="right")
        doc = np.searchsorted(at, hit, side="right") - 1
        fits = (hi > lo) & (hit + Q <= at[doc + 1])
        hit, lo, n, doc = hit[fits], lo[fits], (hi - lo)[fits], doc[fits]
        if not len(hit):
            return none, none, none
        base = int(np.diff(at).max()) + self.widest + 3  # more cells than any text has on either side
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(n.cumsum() // _AT_ONCE)) + 1, len(n)]
        for a, b in zip(cuts, cuts[1:]):  # a q-gram that many patterns share is not expanded with all others at once
            m = n[a:b]
            own = np.repeat(lo[a:b], m) + np.arange(m.sum()) - np.repeat(m.cumsum() - m, m)
            spot, text, which = np.repeat(hit[a:b], m), np.repeat(doc[a:b], m), self.which[own]
            cell = (spot - at[text] - self.place[own]) // (self.edits[which] + 1)
            key, count = np.unique((text * len(self.size) + which) * (2 * base) + cell + base, return_counts=True)
            keys, back = np.unique(np.r_[keys, key], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, count], len(keys)).astype(np.int64)
        both = np.zeros(len(keys), np.int64)
        both[:-1] = np.where(np.diff(keys) == 1, counts[1:], 0)
        which = keys // (2 * base) % len(self.size)
        keys = keys[counts + both >= self.bound[which]]
        return keys // (2 * base) // len(self.size), keys // (2 * base) % len(self.size), keys % (2 * base) - base

    def regions(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
        """(texts, items, edits, ends) of verified regions and of short items."""
        doc, which, cell = self.candidates(data, at) if self.text else (np.zeros(0, np.int64),) * 3
        for a in range(0, len(doc), 512):
            d, w = doc[a : a + 512], which[a : a + 512]
            cost, end = self.verify(data, at, d, w, cell[a : a + 512])
            ok = cost <= self.edits[w]
            yield d[ok], [self.items[i] for i in w[ok].tolist()], cost[ok], end[ok]
        found = list(self.words(data, at))
        if found:
            d, items, end = zip(*found)
            yield np.array(d), list(items), np.zeros(len(d), np.int64), np.array(end)

    def verify(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, which: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the folded text) of the best alignment of each candidate in its band."""
        step = self.edits[which] + 1
        width = int((4 * step).max())
        first = cell * step - step
        diagonal = first[:, None] + np.arange(width)[None]
        outside = np.arange(width)[None] >= (4 * step)[:, None]
        ramp = np.arange(width)
        cost = np.where(outside, 1 << 20, 0).astype(np.int64)
        best, end = np.full(len(doc), 1 << 20), np.zeros(len(doc), np.int64)
        low, high = at[doc][:, None], at[doc + 1][:, None]
        for i in range(1, self.widest + 1):
            spot = low + i + diagonal - 1
            char = np.where((spot >= low) & (spot < high), data[np.clip(spot, 0, len(data) - 1)], 0)
            same = char == self.padded[which, i - 1][:, None]
            new = cost + ~same
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new = np.minimum.accumulate(new - ramp, axis=1) + ramp
            new[outside] = 1 << 20
            cost = new
            done = self.size[which] == i
            if done.any():
                k = cost[done].argmin(1)
                best[done] = cost[done, k]
                end[done] = i + diagonal[done, k]
        return best, end


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int | None, str]]]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator()
    now, size = [], 0
    for item, text in rows:
        now.append((item, text))
        size += len(text)
        if size >= block:
            yield now
            now, size = [], 0
    if now:
        yield now


def _passes(rows: DataFrame, benchmark: DataFrame, block: int, one: Callable[[DataFrame, Broadcast], DataFrame], options: dict) -> Iterator[DataFrame]:
    """What ``one`` makes of the rows it is given and each block of the benchmark."""
    options = {"rate": 0.05, "segment": 100, "least": 60} | options
    context, blocks = rows.sparkSession.sparkContext, _blocks(benchmark, block)
    now, following = next(blocks, None), next(blocks, None)
    while now is not None:
        shared = context.broadcast(Patterns(now, **options))
        if following is None:
            yield one(rows, shared)  # the last block stays with the plan that uses it
        else:
            made = materialize(one(rows, shared), "searched")
            shared.destroy()
            yield made
        now, following = following, next(blocks, None)


def matches(docs: DataFrame, benchmark: DataFrame, block: int = 4 << 20, **options) -> DataFrame:
    """doc_id, item_id, edits, end (byte in the folded text) of each verified region, with column ``_row`` kept if docs have it.

    Options: ``rate`` (0.05), ``segment`` (100), ``least`` (60).
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id", *(["_row"] if "_row" in docs.columns else [])]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def one(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    for doc, items, cost, end in shared.value.regions(*fold(part.column("text"))):
                        take = pa.array(doc)
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in keep), pa.array(items, pa.int64()), pa.array(cost), pa.array(end)], [*keep, "item_id", "edits", "end"])

        return rows.mapInArrow(run, f"{kinds}, item_id long, edits long, end long")

    found = list(_passes(rows, benchmark, block, one, options))
    if not found:
        zero = F.lit(0).cast("long")
        return rows.select(*keep, zero.alias("item_id"), zero.alias("edits"), zero.alias("end")).limit(0)
    return reduce(DataFrame.unionByName, found)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_ids (null last), n_regions, least_edits of each doc_id that holds a benchmark passage."""
    found = matches(docs, benchmark, **options).select("doc_id", F.struct("item_id").alias("item"), "end", "edits")
    ids = F.array_sort(F.transform(F.collect_set("item"), lambda x: x.item_id))
    return found.groupBy("doc_id").agg(ids.alias("item_ids"), F.count_distinct("item", "end").alias("n_regions"), F.min("edits").alias("least_edits"))


def clean(docs: DataFrame, benchmark: DataFrame, block: int = 4 << 20, **options) -> DataFrame:
    """The rows that hold no benchmark passage.  Each is judged where it is read: nothing is shuffled."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, text string"

    def one(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    good = np.ones(part.num_rows, bool)
                    for doc, *_ in shared.value.regions(*fold(part.column("text"))):
                        good[doc] = False
                    yield part.filter(pa.array(good))

        return rows.mapInArrow(run, kinds)

    left: list[DataFrame] = [rows]

    def narrowed(_: DataFrame, shared: Broadcast) -> DataFrame:
        return one(left[-1], shared)

    for kept in _passes(rows, benchmark, block, narrowed, options):
        left.append(kept)
    return left[-1].select("row.*")
