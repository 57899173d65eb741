"""Pieces the corpus operators share: scratch tables, Arrow batching, hashing.

Scratch tables live under the folder that ``spark.checkpoint.dir`` names, which
every executor can reach.  A written table cuts lineage, so that a lost executor
costs the rereading of files and no more; shuffle files of finished parts are let
go as soon as their result is written.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: ASCII white space: the complement of the word pattern ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
#: glibc's, which gives freed pages back to the system; None elsewhere
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables; one of our own only where none is set and all runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="amountlake-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/amountlake/{uuid.uuid4().hex}-{tag}")
    return _MADE[-1]


def made() -> list[str]:
    """Scratch tables so far that were not deleted."""
    return list(_MADE)


def sweep(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _MADE.remove(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: new lineage, no shuffle files kept."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Let executors collect garbage and give freed heap back; else what one stage took stays theirs while the next one's workers grow."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what one Arrow batch of long texts holds; make sure that workers can import the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception as error:  # an older Spark has no such setting
        if "maxBytesPerBatch" not in str(error):
            raise


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], count: str, hot: int = 1_000_000, salts: int = 64) -> DataFrame:
    """``big`` joined with the one row ``small`` has for each of its keys; column ``count`` there says how many of big's rows have it.

    A key of over ``hot`` rows would be one task's work.  Such keys (at most one per ``hot`` rows of big, so few enough to
    broadcast) are spread over ``salts`` tasks.
    """
    heavy = small.filter(F.col(count) > hot).select(*keys, F.lit(True).alias("_heavy"))
    spread = F.pmod(F.xxhash64(*[c for c in big.columns if c not in keys]), F.lit(salts))
    left = big.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_heavy"), spread).otherwise(0)).drop("_heavy")
    copies = F.when(F.col(count) > hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.join(small.withColumn("_salt", F.explode(copies)), [*keys, "_salt"]).drop("_salt")


def bounded(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows``, of a few numbers each and read from a table, with a hint to broadcast them if there are at most ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def with_keys(docs: DataFrame) -> DataFrame:
    """Add ``_k`` (doc_id, null last) and ``_t``: with both equal, rows are copies of one row.

    ``_t`` is a hash of the text, or 0 throughout if no doc_id occurs twice; it then costs shuffles nothing.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    every, different = docs.agg(F.count(k), F.count_distinct(k)).first()
    t = F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("text"))
    return docs.withColumns({"_k": k, "_t": F.lit(0).cast("long") if every == different else t})


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the bytes of one column stay near ``most``; what work on it took goes back to the system."""
    at = lengths(batch.column(column)).cumsum() // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(offsets(column))


def offsets(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    at = offsets(column)
    if len(column) == 0 or at[-1] == at[0] or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 12), base, np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


_BASE, _STRIDE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_BASE_INV, _STRIDE_INV = (pow(x, -1, 1 << 64) for x in (_BASE, _STRIDE))


class Words:
    """The words of the texts of one slice, found and hashed without a loop over them.

    ``start``/``end`` are byte positions in ``data``; ``first`` has, for each text, the index
    of its first word, and one entry more.
    """

    def __init__(self, column: pa.Array) -> None:
        self.data, at = raw(column)
        space = _SPACE[self.data]
        begin, stop = ~space, ~space
        if len(space):
            edge = np.zeros(len(space) + 1, bool)
            edge[at] = True
            begin[1:] &= space[:-1] | edge[1:-1]
            stop[:-1] &= space[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, at)
        self.n = len(self.start)

    def hashes(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        size, n = self.end - self.start, len(self.data)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * powers(_BASE, n), out=prefix[1:])
        return mix((prefix[self.end] - prefix[self.start]) * powers(_BASE_INV, n)[self.start] + size.astype(np.uint64))


def grams(words: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions are missing."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix((np.arange(k, dtype=np.uint64) + _U(salt)) * _U(0x9E3779B97F4A7C15)) | _U(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * factors[j]
    return mix(out)


class Spans:
    """Hashes of any run of words, from prefix sums."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(_STRIDE, n), out=self.prefix[1:])
        self.inverse = powers(_STRIDE_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def anchors(words: Words, hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Winnowed anchors: (hash, word, first window, last window) of each.

    A window is ``window`` words of one text; it belongs to the leftmost smallest k-gram hash
    in it.  Equal windows so belong to equal k-grams at equal distances.
    """
    g = grams(hashes, k)
    n, w = words.n - window + 1, window - k + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    best, arg = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, w):
        other = g[j : j + n]
        less = other < best
        best[less] = other[less]
        arg[less] = j
    last = np.repeat(words.first[1:], np.diff(words.first))[:n] - window
    s = np.flatnonzero(np.arange(n) <= last)
    if not len(s):
        return np.zeros(0, np.uint64), none, none, none
    at = s + arg[s]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(s) != 1)) + 1
    lo, hi = s[np.r_[0, cut]], s[np.r_[cut, len(s)] - 1]
    at = at[np.r_[0, cut]]
    return g[at], at, lo, hi


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
