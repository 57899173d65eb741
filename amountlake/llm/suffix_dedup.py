"""Repeats by sparse suffix arrays.

Suffixes are kept only where a text has a minimiser: the leftmost smallest of the k-gram hashes of some window of
``window`` words, which is chosen by content, so a passage has the same minimisers wherever it stands.  Minimisers
whose first k words occur once are dropped by a count; so most of a text is never sorted.

What a minimiser decides is the run of windows it is smallest in: some words to its left and some to its right.  If all
its occurrences agree in that whole run, the run is one suffix.  If not, matches end somewhere inside, and it is extended
leftwards to a suffix from each of those windows' starts.  Each suffix is named by a hash of its first words and a 128-bit
hash of all words it is compared on.  Suffixes are sorted by name, then document and place, in ranges, so a
passage in a third of all documents is spread over tasks, and each is compared with its neighbours.  In a run of equal suffixes the
first is the earliest, so a suffix repeats an earlier one exactly if it equals its left neighbour: no pairs are made, and none is
missed.  The first and last suffix of each range are compared by the driver (two short rows per task).
Matches extend left and right as the spans of a document that overlap are merged.

A word is in ``spans`` if a window of ``window`` words over it stands elsewhere too, in this document or another, and is
late if such a window also stands earlier: smaller doc_id (null last; for one doc_id smaller text hash), or the same
document and an earlier place.  Of all copies of a window exactly one is not late.

Defined results: documents without repeats, null, empty and short texts among them, have no row.  Rows that agree
in doc_id and text are one document, counted once.  ``others`` has the documents met as neighbours, the own one where it
repeats itself; each member of a passage is linked so to another, not to all.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, Words, anchors, grams, materialize, mix, signed, small_batches, slices, with_keys
from .substring_dedup import _positions

_NAME = ["w", "h1", "h2"]
_ORDER = [*_NAME, "_k", "_t", "start"]
_MATCH = "_k long, _t long, start int, stop int, other long, late boolean"


def _minimisers(docs: DataFrame, k: int, window: int) -> DataFrame:
    """g (hash of the k words there), c (hash of all the minimiser decides), _k, _t, p, and the words decided: from p - l to p + r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                g, at, lo, hi = anchors(words, hashes, k, window)
                row = np.searchsorted(words.first, at, side="right") - 1
                c = mix(Spans(hashes).of(lo, hi + window) + ((at - lo) * 64 + (at - hi)).astype(np.uint64))
                thin = [pa.array(x.astype(np.int16)) for x in (at - lo, hi + window - at)]
                yield pa.RecordBatch.from_arrays([signed(g), signed(c), *(part.column(x).take(pa.array(row)) for x in ("_k", "_t")), pa.array((at - words.first[row]).astype(np.int32)), *thin], ["g", "c", "_k", "_t", "p", "l", "r"])

    return docs.mapInArrow(run, "g long, c long, _k long, _t long, p int, l short, r short")


def _extended(docs: DataFrame, k: int, window: int) -> DataFrame:
    """The suffixes from each window's start that the minimisers at ``ps`` decide, cut after ``window`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                _, at, lo, hi = anchors(words, hashes, k, window)
                pick = np.isin(at, _positions(part.column("ps"), words))
                lo, hi = lo[pick], hi[pick]
                size = hi - lo + 1
                s = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
                row = np.searchsorted(words.first, s, side="right") - 1
                names = [signed(grams(hashes, n, salt)[s] if len(s) else np.zeros(0, np.uint64)) for n, salt in ((2, 1), (window, 77), (window, 177))]
                start = (s - words.first[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*names, *(part.column(x).take(pa.array(row)) for x in ("_k", "_t")), pa.array(start), pa.array(start + np.int32(window))], [*_ORDER, "stop"])

    return docs.mapInArrow(run, "w long, h1 long, h2 long, _k long, _t long, start int, stop int")


def _neighbours(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Matches of consecutive suffixes: _k, _t, start, stop, other, late of each that equals its left or right neighbour."""
    w, h1, h2, k, t, start, stop = columns
    same = (w[1:] == w[:-1]) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    i = np.flatnonzero(same)
    j = i + 1
    first = i[np.r_[True, np.diff(i) != 1]] if len(i) else i  # heads of runs of equal suffixes
    own, other = np.r_[first, j], np.r_[first + 1, i]
    late = np.r_[np.zeros(len(first), bool), np.ones(len(j), bool)]
    return [k[own], t[own], start[own], stop[own], k[other], late]


def _sorted_matches(suffixes: DataFrame) -> DataFrame:
    spark = suffixes.sparkSession
    kinds = f"{_MATCH}, place int, first boolean, w long, h1 long, h2 long"
    names = [x.split()[0] for x in kinds.split(", ")]
    columns = [*_ORDER, "stop"]

    def edge(row: list, place: int, first: bool) -> pa.RecordBatch:
        w, h1, h2, k, t, start, stop = (x[0] for x in row)
        values = [k, t, start, stop, None, None, place, first, w, h1, h2]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(values, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_run = None, False
        place = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in columns]
            if last is None:
                yield edge(now, place, True)
            else:
                now = [np.concatenate([a, b]) for a, b in zip(last, now)]
            found = _neighbours(now)
            if open_run:  # the row carried over is in already, as the end of a run
                keep = ~((found[0] == now[3][0]) & (found[1] == now[4][0]) & (found[2] == now[5][0]) & ~found[5])
                found = [x[keep] for x in found]
            open_run = len(now[0]) > 1 and all(now[c][-1] == now[c][-2] for c in range(3)) or (open_run and len(now[0]) == 1)
            last = [x[-1:].copy() for x in now]
            n = len(found[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found), *(pa.nulls(n, x) for x in (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))], names)
        if last is not None:
            yield edge(last, place, False)

    ranged = suffixes.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    made = materialize(ranged.mapInArrow(run, kinds), "matches")
    edges = sorted(made.filter("place is not null").collect(), key=lambda e: (e["place"], not e["first"]))
    bound = []
    for a, b in zip(edges[1::2], edges[2::2]):
        if all(a[c] == b[c] for c in _NAME):
            bound += [(a["_k"], a["_t"], a["start"], a["stop"], b["_k"], False), (b["_k"], b["_t"], b["start"], b["stop"], a["_k"], True)]
    return made.filter("place is null").select("_k", "_t", "start", "stop", "other", "late").unionByName(spark.createDataFrame(bound, _MATCH))


def matches(docs: DataFrame, window: int, k: int) -> DataFrame:
    """_k, _t, start, stop, other, late of each suffix that repeats; docs have _k, _t, text."""
    found = materialize(_minimisers(docs, k, window), "minimisers")
    seen = found.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    seen = seen.filter("n > 1").select("g", "n", (F.col("c0") == F.col("c1")).alias("whole"))
    marks = materialize(found.join(seen, "g").select("g", "c", "_k", "_t", "p", "l", "r", "whole"), "repeated")
    # one hash of the whole run stands for all its words; the k words there are the first half of the name
    whole = marks.filter("whole").select(F.col("g").alias("w"), F.col("c").alias("h1"), F.lit(0).cast("long").alias("h2"), "_k", "_t", (F.col("p") - F.col("l")).cast("int").alias("start"), (F.col("p") + F.col("r")).cast("int").alias("stop"))
    parts = marks.filter("not whole").groupBy("_k", "_t").agg(F.collect_set("p").alias("ps"))
    partial = _extended(docs.join(parts, ["_k", "_t"]), k, window)
    return _sorted_matches(whole.unionByName(partial))


def repeats(docs: DataFrame, window: int = 50, k: int = 8) -> DataFrame:
    """doc_id, n_repeated, n_late, spans, late (merged [from, to) word numbers), others (doc_ids met) of documents with repeats."""
    small_batches(docs.sparkSession)
    lean = with_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("_k", "_t", "text")
    found = matches(_once(lean), window, k)
    each = found.groupBy("_k", "_t").agg(F.collect_set(F.struct("start", "stop")).alias("every"), F.collect_set(F.when(F.col("late"), F.struct("start", "stop"))).alias("late"), F.sort_array(F.collect_set("other")).alias("others"))
    span = "array<struct<from:int,to:int>>"
    return each.mapInArrow(_merge, f"doc_id long, n_repeated long, n_late long, spans {span}, late {span}, others array<long>")


def _once(lean: DataFrame) -> DataFrame:
    """One row of those that agree in doc_id and text.  Only rows whose id and text occur again are shuffled."""
    again = materialize(lean.groupBy("_k", "_t").count().filter("count > 1").select("_k", "_t"), "again")
    if again.isEmpty():
        return lean
    return lean.join(again, ["_k", "_t"], "left_anti").unionByName(lean.join(again, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"]))


def _spans(pairs: list[dict]) -> list[dict]:
    """Merged spans; ones that only touch stay apart, as no window stands over the border."""
    out: list[dict] = []
    for x in sorted(pairs, key=lambda x: (x["start"], x["stop"])):
        if out and x["start"] < out[-1]["to"]:
            out[-1]["to"] = max(out[-1]["to"], x["stop"])
        else:
            out.append({"from": x["start"], "to": x["stop"]})
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    none = 2**63 - 1
    for batch in batches:
        every, late = ([_spans(x) for x in batch.column(c).to_pylist()] for c in ("every", "late"))
        size = lambda spans: pa.array([sum(s["to"] - s["from"] for s in x) for x in spans], pa.int64())
        ids = pa.array([None if x == none else x for x in batch.column("_k").to_pylist()], pa.int64())
        others = pa.array([[None if y == none else y for y in x] for x in batch.column("others").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, size(every), size(late), pa.array(every, kind), pa.array(late, kind), others], ["doc_id", "n_repeated", "n_late", "spans", "late", "others"])
