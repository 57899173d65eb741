"""Substring dedup by seed and extend.

Seeds are winnowed word k-grams: each window of ``window`` words belongs to the leftmost smallest
k-gram hash in it, its anchor, so equal windows have equal anchors at equal distances and no repeat of
``window`` words can be missed.  Extension is by classes, not by pairs: the windows an anchor owns
reach as far left and right as the anchor decides them, and one hash covers that whole extent.

1. Anchors are counted by hash (a map-side aggregate, so a hot passage is no hot task).  Of those that
   occur twice or more, either all extents agree - then every occurrence but the first repeats it
   whole - or the repeats end inside some extent.
2. For the latter, the owned windows are hashed one by one (128 bits), and grouped the same way.
3. A word goes if any window over it also starts earlier; adjacent repeated windows so merge
   into maximal repeats of ``window`` words and more.

Earlier: smaller doc_id (null last; for one doc_id, smaller text hash), then earlier start.

Defined results: null, empty and short texts lose nothing.  Rows that agree in doc_id and text are one
row repeated, and give one result, repeated.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, Words, anchors, grams, materialize, mix, signed, slices, small_batches, with_keys


def _anchored(docs: DataFrame, k: int, window: int, extents: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                hashes = words.hashes()
                g, at, lo, hi = anchors(words, hashes, k, window)
                row = np.searchsorted(words.first, at, side="right") - 1
                columns = [signed(g), *(part.column(c).take(pa.array(row)) for c in ("_k", "_t")), pa.array((at - words.first[row]).astype(np.int32))]
                if extents:
                    shape = ((at - lo) * 64 + (at - hi)).astype(np.uint64)
                    columns.append(signed(mix(Spans(hashes).of(lo, hi + window) + shape)))
                yield pa.RecordBatch.from_arrays(columns, ["g", "_k", "_t", "p", *["c"] * extents])

    return docs.mapInArrow(run, "g long, _k long, _t long, p int" + ", c long" * extents)


def repeated_anchors(docs: DataFrame, k: int, window: int) -> DataFrame:
    """_k, _t, p, whole of each anchor that repeats an earlier one whole, or (whole = false) may do so in part."""
    seen = _anchored(docs, k, window, True).groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("_k", "_t", "p")).alias("least"))
    seen = seen.filter("n > 1").select("g", (F.col("c0") == F.col("c1")).alias("whole"), "least")
    found = _anchored(docs, k, window, False).join(seen, "g")
    return found.filter(~F.col("whole") | (F.struct("_k", "_t", "p") != F.col("least"))).select("_k", "_t", "p", "whole")


def _windows(docs: DataFrame, k: int, window: int) -> DataFrame:
    """h1, h2, _k, _t, s of each window that an anchor listed in column ``ps`` owns."""

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
                h1, h2 = (grams(hashes, window, salt)[s] if len(s) else np.zeros(0, np.uint64) for salt in (77, 177))
                yield pa.RecordBatch.from_arrays([signed(h1), signed(h2), *(part.column(c).take(pa.array(row)) for c in ("_k", "_t")), pa.array((s - words.first[row]).astype(np.int32))], ["h1", "h2", "_k", "_t", "s"])

    return docs.mapInArrow(run, "h1 long, h2 long, _k long, _t long, s int")


def _positions(lists: pa.Array, words: Words) -> np.ndarray:
    """Word indexes in the slice, of lists of word numbers in each text."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    return flat + np.repeat(words.first[:-1], counts)


def dedup(docs: DataFrame, window: int = 20, k: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, removed (list of [from, to) word numbers) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = with_keys(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    lean = keyed.select("_k", "_t", "text")
    marks = materialize(repeated_anchors(lean, k, window), "anchors")
    parts = marks.filter("not whole").groupBy("_k", "_t").agg(F.collect_set("p").alias("ps"))
    windows = materialize(_windows(lean.join(parts, ["_k", "_t"]), k, window), "windows")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("_k", "_t", "s")).alias("least")).filter("n > 1").drop("n")
    late = windows.join(first, ["h1", "h2"]).filter(F.struct("_k", "_t", "s") != F.col("least")).select("_k", "_t", F.col("s").alias("at"), F.lit(False).alias("anchor"))
    every = late.unionByName(marks.filter("whole").select("_k", "_t", F.col("p").alias("at"), F.lit(True).alias("anchor")))
    cuts = materialize(every.groupBy("_k", "_t").agg(F.collect_set(F.when(F.col("anchor"), F.col("at"))).alias("ps"), F.collect_set(F.when(~F.col("anchor"), F.col("at"))).alias("ss")), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _cut(part, k, window)

    return keyed.join(cuts, ["_k", "_t"], "left").select("doc_id", "text", "ps", "ss").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<from:int,to:int>>"
    )


def _cut(part: pa.RecordBatch, k: int, window: int) -> pa.RecordBatch:
    words = Words(part.column("text"))
    ps, ss = _positions(part.column("ps"), words), _positions(part.column("ss"), words)
    depth = np.zeros(words.n + 1, np.int32)
    if len(ps):
        _, at, lo, hi = anchors(words, words.hashes(), k, window)
        pick = np.isin(at, ps)
        np.add.at(depth, lo[pick], 1)
        np.add.at(depth, hi[pick] + window, -1)
    np.add.at(depth, ss, 1)
    np.add.at(depth, ss + window, -1)
    gone = depth.cumsum()[:-1] > 0
    lost = np.r_[0, gone.cumsum()][words.first]
    lost = np.diff(lost)
    texts, sums, spans = [], [], []
    data = words.data.tobytes()
    start, end, first = words.start, words.end, words.first.tolist()
    for i, (a, b) in enumerate(zip(first, first[1:])):
        if a == b:
            kept, cut = b"", []
        elif lost[i]:
            keep = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([data[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist())])
            edge = np.flatnonzero(np.diff(np.r_[0, gone[a:b].astype(np.int8), 0]))
            cut = [{"from": int(x), "to": int(y)} for x, y in zip(edge[::2], edge[1::2])]
        else:
            kept, cut = b" ".join(data[start[a] : end[b - 1]].split()), []
        texts.append(kept.decode())
        sums.append(hashlib.sha256(kept).hexdigest())
        spans.append(cut)
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(words.first)), pa.array(lost.astype(np.int64)), pa.array(sums), pa.array(texts), pa.array(spans, kind)],
        ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"],
    )
