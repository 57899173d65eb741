"""Nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector is taken relative to the nearest of a few centroids (fitted on a bounded sample), rotated into ``bits``
dimensions by a seeded random matrix of orthonormal rows, and kept as one sign bit per dimension, packed, with three correction
scalars: the length of the residual, its product with the centroid, and its product with its own code.  From these the
inner product with a query is estimated without bias, and the error is within
``eps * sqrt((1 - a**2) / a**2) / sqrt(bits - 1)`` of it but for a chance that falls steeply in eps, where a is the
product of residual and code.  More bits than the vector has dimensions narrow the bound (at 64 dimensions and 512
bits to about a third).  A vector is reranked in double precision on the original only if the estimate plus its bound
reaches the k-th best so far; a whole list is skipped if no member can (by the triangle inequality).

Every vector is indexed.  The index is a table of codes and vectors; vectors are never shuffled.  Queries go to it in blocks of at
most ``block`` rows through the driver, each block by one pass; a task scans its rows in batches, keeps the k best of
each query, and only these meet.  Each block is a written table, and is let go before the next.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components take no part as
query or candidate, nor do rows without an id.  A vector is compared with those of its own dimension.  Every other row is a
candidate, also ones that share the query's id or repeat it; each row that is a query has its own ranks.  Fewer candidates than
k are all returned.  Ties go to the smaller id.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches

_CODED = "rid long, vec_id long, dim int, v array<double>, list int, code binary, length double, along double, product double"
_RESULT = "qid long, query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


_TURNS: dict[tuple[int, int, int], np.ndarray] = {}


def rotation(d: int, bits: int, seed: int) -> np.ndarray:
    """d orthonormal rows of ``bits`` numbers (at least d), the same in every worker."""
    at = (d, max(d, bits), seed)
    if at not in _TURNS:
        if len(_TURNS) > 8:
            _TURNS.clear()
        q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((at[1], d)))
        _TURNS[at] = np.ascontiguousarray((q * np.sign(np.diag(r))).T)
    return _TURNS[at]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Means of unit vectors in clusters, by Lloyd's rounds from evenly chosen rows."""
    unit = _unit(sample)
    c = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(rounds):
        own = ((c * c).sum(1)[None] - 2 * unit @ c.T).argmin(1)
        c = np.stack([unit[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def encode(x: np.ndarray, c: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(list, packed bits, residual length, residual . centroid, residual direction . code) of each vector."""
    unit = _unit(x)
    own = ((c * c).sum(1)[None] - 2 * unit @ c.T).argmin(1)
    rest = unit - c[own]
    size = np.sqrt((rest * rest).sum(1))
    turned = rest @ turn
    a = np.abs(turned).sum(1) / np.sqrt(turn.shape[1]) / np.maximum(size, 1e-300)
    return own, np.packbits(turned >= 0, axis=1), size, (rest * c[own]).sum(1), np.clip(a, 1e-6, 1)


def bounds(code: tuple[np.ndarray, ...], q: np.ndarray, i: int, rows: np.ndarray, c: np.ndarray, turn: np.ndarray, eps: float) -> np.ndarray:
    """Upper bounds of the cosines of unit queries with the vectors ``rows``, all of list i."""
    _, packed, size, along, a = code
    bits = turn.shape[1]
    local = q - c[i]
    far = np.sqrt((local * local).sum(1))
    sign = np.unpackbits(packed[rows], axis=1, count=bits).astype(np.float32) * 2 - 1
    dot = ((local @ turn).astype(np.float32) @ sign.T) / np.sqrt(bits)
    error = eps * np.sqrt(1 - a[rows] ** 2) / a[rows] / np.sqrt(max(1, bits - 1))
    return (q @ c[i])[:, None] + along[rows][None] + size[rows][None] * (dot / a[rows][None] + error[None] * far[:, None]) + 1e-6


class Best:
    """The k nearest of each query among what was scanned so far."""

    def __init__(self, rid: np.ndarray, q: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, eps: float) -> None:
        self.rid, self.q, self.c, self.turn, self.k, self.eps = rid, q, c, turn, k, eps
        self.unit = _unit(q)
        self.norm = np.sqrt((q * q).sum(1))
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.met = self.scored = 0
        self.far = np.sqrt(((self.unit[:, None] - c[None]) ** 2).sum(2)) if len(q) * len(c) * q.shape[1] < 1 << 26 else np.stack([np.sqrt(((self.unit - x) ** 2).sum(1)) for x in c], 1)

    def scan(self, rid: np.ndarray, ids: np.ndarray, x: np.ndarray, code: tuple[np.ndarray, ...]) -> None:
        own, _, size, along, _ = code
        norm = np.sqrt((x * x).sum(1))
        for i in np.unique(own).tolist():
            rows = np.flatnonzero(own == i)
            reach = self.unit @ self.c[i] + along[rows].max() + size[rows].max() * self.far[:, i] + 1e-6
            for lo in range(0, len(self.q), 256):
                ask = lo + np.flatnonzero(reach[lo : lo + 256] >= self.score[lo : lo + 256, -1])
                if not len(ask):
                    continue
                upper = bounds(code, self.unit[ask], i, rows, self.c, self.turn, self.eps)
                upper[self.rid[ask][:, None] == rid[rows][None]] = -np.inf
                self.met += upper.size
                for j, row in enumerate(ask.tolist()):
                    self._rerank(row, upper[j], rows, ids, x, norm)

    def _rerank(self, row: int, upper: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, norm: np.ndarray) -> None:
        kth = self.score[row, -1]
        if len(upper) > 4 * self.k:  # a few of the highest first, so that the k-th best rules out more
            first = np.argpartition(-upper, 2 * self.k)[: 2 * self.k]
            sure = np.sort(self._cosines(row, rows[first], x, norm)[upper[first] > -np.inf])
            kth = max(kth, sure[-self.k]) if len(sure) >= self.k else kth
        again = np.flatnonzero((upper >= kth) & (upper > -np.inf))
        if not len(again):
            return
        self.scored += len(again)
        own = rows[again]
        score = np.r_[self.score[row], self._cosines(row, own, x, norm)]
        near = np.r_[self.ids[row], ids[own]]
        best = np.lexsort((near, -score))[: self.k]
        self.score[row], self.ids[row] = score[best], near[best]

    def _cosines(self, row: int, own: np.ndarray, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        v, n, size = self.q[row], self.norm[row], norm[own]
        good = np.isfinite(n) and n > 0 and np.isfinite(size).all() and (size > 0).all()
        if good and (dots := x[own] @ v) is not None and np.isfinite(dots).all() and np.isfinite(size * n).all() and (size * n > 0).all():
            return np.clip((x[own] * v).sum(1) / (size * n), -1, 1)
        return np.clip((_unit(x[own]) * self.unit[row]).sum(1), -1, 1)  # products that over- or underflow


class Codec:
    """Centroids of the dimensions of a sample; any other dimension has one, at the origin."""

    def __init__(self, sample: dict[int, np.ndarray], lists: int, bits: int, seed: int) -> None:
        self.found = {d: centroids(x, lists) for d, x in sample.items()}
        self.bits, self.seed = bits, seed

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        return self.found.get(d, np.zeros((1, d))), rotation(d, self.bits, self.seed)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d)) if (dims != d).any() else batch


def index(vectors: DataFrame, lists: int, bits: int, sample: int, seed: int) -> tuple[DataFrame, Codec]:
    """The written table of codes, ``rid`` a number of each row, and what decodes it."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    chosen = rows.orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").collect()
    by: dict[int, list] = {}
    for r in chosen:
        by.setdefault(len(r[0]), []).append(r[0])
    codec = Codec({d: np.array(x) for d, x in by.items()}, lists, bits, seed)
    shared = rows.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, one in _by_dim(batch):
                own, packed, *scalars = encode(_matrix(one.column("v")), *shared.value.of(d))
                code = pa.array([p.tobytes() for p in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([*(one.column(n) for n in ("rid", "vec_id", "dim", "v")), pa.array(own.astype(np.int32)), code, *map(pa.array, scalars)], [x.split()[0] for x in _CODED.split(", ")])

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("v").alias("dim"), "v")
    return materialize(numbered.mapInArrow(run, _CODED), "codes"), codec


def _pass(coded: DataFrame, shared: Broadcast, codec: Broadcast, k: int, eps: float) -> DataFrame:
    """The k nearest of the queries among each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for d, one in _by_dim(batch):
                if d not in shared.value:
                    continue
                if d not in best:
                    rid, _, q = shared.value[d]
                    best[d] = Best(rid, q, *codec.value.of(d), k, eps)
                packed = np.frombuffer(b"".join(one.column("code").to_pylist()), np.uint8).reshape(one.num_rows, -1)
                code = (one.column("list").to_numpy(), packed, *(one.column(n).to_numpy() for n in ("length", "along", "product")))
                best[d].scan(one.column("rid").to_numpy(), one.column("vec_id").to_numpy(), _matrix(one.column("v")), code)
        for d, own in best.items():
            row, nth = np.nonzero(own.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(own.rid[row]), pa.array(shared.value[d][1][row]), pa.array(own.ids[row, nth]), pa.array(own.score[row, nth])], ["qid", "query_id", "vec_id", "score"])

    return coded.select("rid", "vec_id", "dim", "v", "list", "code", "length", "along", "product").mapInArrow(run, _RESULT)


def _blocks(asked: DataFrame, block: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """{dimension: (rid, vec_id, vectors)} of at most ``block`` queries each."""
    held: dict[int, list] = {}
    n = 0

    def made() -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {d: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), np.array([r[2] for r in x])) for d, x in held.items()}

    for r in asked.select("rid", "vec_id", "v").toLocalIterator():
        held.setdefault(len(r[2]), []).append(r)
        n += 1
        if n == block:
            yield made()
            held, n = {}, 0
    if n:
        yield made()


def search(vectors: DataFrame, queries: Column, k: int = 5, lists: int = 16, bits: int = 512, sample: int = 4096, block: int = 8192, eps: float = 3.0, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which ``queries`` (on vec_id) holds, among all rows."""
    spark = vectors.sparkSession
    small_batches(spark, 4096, "64m")
    coded, codec = index(vectors, lists, bits, sample, seed)
    shared_codec, found = spark.sparkContext.broadcast(codec), None
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    for asked in _blocks(coded.filter(queries), block):
        shared = spark.sparkContext.broadcast(asked)
        near = _pass(coded, shared, shared_codec, k, eps).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        one = materialize(near.select("query_id", "rank", "vec_id", "score"), "nearest")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    if found is None:
        return coded.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return found
