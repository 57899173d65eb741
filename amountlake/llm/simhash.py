"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes.  Fingerprints that differ in ``d`` bits differ in at most
``d`` byte positions, so they share at least ``8 - d`` positional bytes: with d = 3, five of eight.
The index holds, for each fingerprint, postings of three positional bytes each.  With positions
split into two halves of four, any five shared positions put three into one half, so the eight
triples inside the halves meet every qualifying pair at least once.  Pairs that meet tally their
shared positional bytes; those reaching the guaranteed minimum are verified by bit count.

Equal fingerprints are one class before anything is indexed: a group of copies, of whatever size,
is one posting.  A posting list longer than ``hot`` is not paired as it is: its members are posted again
under every choice of two of the five positions left (a qualifying pair shares two there too).  Lists that are still
longer are posted a last time: of the six half bytes in the three positions left, at most three differ, so
under every choice of three of them.  That fixes 52 of 64 bits, so a list then has at most 4096 members however
large the input is; every list is paired whole, and no link is lost.

Components are found by alternating large-star and small-star steps on the links of classes; each
round is a written table, nothing is collected, and nodes with very many links are spread over tasks.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other.
doc_id null takes part; a component of nothing but null ids has a null component_id.  Repeated
rows give repeated results.  Other columns of the input are ignored, so none can clash.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, raw, slices, small_batches

_SPACES = b" \t\n\r\x0b\x0c"


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) > shingle:
        start = np.r_[0, end[:-shingle] + 1].tolist()
        stop = end[shingle - 1 :].tolist()
    else:
        start, stop = [0], [len(line)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(start, stop)], np.uint64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.zeros(64, np.int64)
    for a in range(0, len(bits), 255):  # sums of 255 bits fit a byte
        votes += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long, signed) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = raw(part.column("text"))
                whole = data.tobytes()
                got = [fingerprint(whole[a:b], shingle, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _byte(fp, i: int):
    return F.shiftrightunsigned(fp, 56 - 8 * i).bitwiseAND(F.lit(255))


def _mask(halves: tuple[int, ...]) -> int:
    """Bits of the given half bytes (0 to 15, from the left), as a signed number."""
    mask = sum(15 << (60 - 4 * i) for i in halves)
    return mask - (1 << 64) if mask >> 63 else mask


def _bytes(positions: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(h for i in positions for h in (2 * i, 2 * i + 1))


_TRIPLES = [c for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for c in combinations(half, 3)]
_FIVES = list(combinations(range(8), 5))
#: the masks a list is posted again under, by its own mask
_NEXT = {_mask(_bytes(t)): [_mask(_bytes(c)) for c in _FIVES if set(t) <= set(c)] for t in _TRIPLES}
_LAST = {_mask(_bytes(c)): [_mask(_bytes(c) + h) for h in combinations(_bytes(tuple(set(range(8)) - set(c))), 3)] for c in _FIVES}


def _post(fps: DataFrame, masks) -> DataFrame:
    return fps.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).distinct()


def _again(posts: DataFrame, following: dict[int, list[int]]) -> DataFrame:
    table = ", ".join(f"{k}L, array({', '.join(f'{m}L' for m in v)})" for k, v in following.items())
    return _post(posts, F.element_at(F.expr(f"map({table})".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")), F.col("mask")))


def links(fps: DataFrame, bits: int = 3, hot: int = 256) -> DataFrame:
    """a < b: all pairs of distinct fingerprints (column fp) that differ in 1 to ``bits`` bits; ``bits`` up to 3."""
    if not 0 <= bits <= 3:
        raise ValueError("the index is complete for up to 3 differing bits")
    posts, cold = _post(fps, F.array(*[F.lit(m).cast("long") for m in _NEXT])), None
    for following in (_NEXT, _LAST, None):
        size = posts.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        posts = materialize(join_counted(posts, size, ["mask", "key"], "n"), "postings")
        own = posts.filter(F.col("n") <= hot) if following else posts
        cold = own if cold is None else cold.unionByName(own)
        if not following or posts.filter(F.col("n") > hot).isEmpty():
            break
        posts = _again(posts.filter(F.col("n") > hot), following)
    left, right = (cold.select("mask", "key", F.col("fp").alias(x)) for x in "ab")
    shared = sum(F.when(_byte(F.col("a"), i) == _byte(F.col("b"), i), 1).otherwise(0) for i in range(8))
    pairs = left.join(right, ["mask", "key"]).filter("a < b").filter(shared >= 8 - bits)
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b").distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free sums of hashes: equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of edges a, b."""
    now, mark = materialize(edges.select("a", "b"), "edges"), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.filter("v > u"), least, ["u"], "n").select(F.col("v").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, ["x"], "n").select(F.col("y").alias("x"), "m").filter("x <> m").union(low.select("x", "m"))
        now = materialize(small.distinct().select(F.col("m").alias("a"), F.col("x").alias("b")), "star")
        before, mark = mark, _digest(now)
        if before == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long), component_id of each row."""
    marked = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"), bits))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = materialize(join_counted(placed, ids, ["root"], "members").select("fp", "component_id", "n"), "named")
    return join_counted(marked, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """The documents that are the first of their near-duplicate group: smallest doc_id, one row of repeated ones.

    Rows without a doc_id can't be told apart by it; they stay.
    """
    found = near_duplicates(docs, shingle, bits)
    kept = found.groupBy("component_id").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").select("doc_id").distinct()
    return docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
