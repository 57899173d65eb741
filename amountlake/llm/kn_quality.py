"""Quality by perplexity under an interpolated modified Kneser-Ney model of the words of trusted text.

N-grams are of ``order`` words (ASCII case folded), with start marks before each text, and are named by 64-bit hashes.  All
counts are held in shards by that hash, so no n-gram, however frequent, and no context is one task's work:

1. Tasks count the n-grams of their part of the trusted text before anything is shuffled; each shard sums its n-grams' counts.
   It passes on, summed within the shard, what they add to their contexts (total, and how many n-grams of count 1, 2,
   and 3 or more) and how many n-grams end in each (n-1)-gram: the counts of the next lower order, made the same way.
2. Discounts come from counts of counts, a row per order.
3. Documents ask shards for the distinct n-grams and contexts of a block of rows and get those that were counted: a join by
   shard.  Shards of the model and a block's answers are files in the shared folder, so the model is not shuffled again; documents
   are then scored where they are read, with their block's file, so texts are never shuffled.  Shards are made, and blocks
   asked, in parts, each letting go of what it shuffled before the next.

What goes over the wire are packed arrays, not a row per n-gram.  The model never reaches the driver, and grows with the trusted text.

A document's perplexity is that of its whole text.  Every fifth trusted document, by a hash of doc_id, is left out
of the model and sets the thresholds: a document is kept if its perplexity is at most the ``quantile`` of theirs in its language;
languages with fewer than ``least`` of them take the quantile of all.

Defined results: a text without a word, null and empty ones among them, has no perplexity and is not kept.  With no trusted
text at all, every document with words is kept, with perplexity 0.  A null lang is a language of its own.  A null doc_id is
never trusted.  Repeated rows give repeated results and each count; repeated labels count once, and a doc_id that any row calls
good is trusted.  A perplexity equal to the threshold is kept.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded, made, materialize, mix, release, scratch, slices, small_batches, sweep
from .tokenbin import _open, _save

_U8 = np.uint64
_START = _U8(0x5851F42D4C957F2D)
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * _U8(0xD1B54A32D192ED03)) | _U8(1)
_ROW = "kind string, shard long, block long, data binary"
#: the arrays of a blob of each kind: counts by n-gram, contexts, parts of contexts, questions
_TYPES = {"a": "<u8 <u8", "c": "<u8 <f8 <f8", "x": "<u8 <u8 <u8 <u8 <u8", "q": "<u8", "s": "<u8"}


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of equal length, the first ascending, as differences; bytes of like weight side by side."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, types: str) -> list[np.ndarray]:
    raw, kinds, out, at = zstandard.ZstdDecompressor().decompress(data), [np.dtype(t) for t in types.split()], [], 0
    n = len(raw) // sum(t.itemsize for t in kinds)
    for t in kinds:
        size = n * t.itemsize
        plane = np.frombuffer(raw, np.uint8, size, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).view(t).reshape(n))
        at += size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def _types(kind: str) -> str:
    return "<u8 " * (int(kind[1:]) + 1) if kind[0] == "n" else _TYPES[kind[0]]


def key(words: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams whose words are in parallel arrays."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w, f in zip(words, _FACTORS):
        out += w * f
    return mix(out)


def columns(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words order - 1, ... 0 places before each word, and where the words of each text begin."""
    words = Words(pc.ascii_lower(texts))
    hashes, place = words.hashes(), np.arange(words.n)
    begin = np.repeat(words.first[:-1], np.diff(words.first))
    out = []
    for back in range(order - 1, -1, -1):
        was = np.r_[np.full(min(back, words.n), _START), hashes[: max(0, words.n - back)]]
        out.append(np.where(place - back >= begin, was, _START))
    return out, words.first


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, a place of each, sums of values)."""
    order = np.argsort(keys)  # not a stable sort: that takes three times as long, and no result depends on the order of equal keys
    found = keys[order]
    heads = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
    return found[heads], order[heads], [np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """What np.unique gives; its hash table takes many times as long as a sort."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _shards(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of ascending keys."""
    edge = np.searchsorted(keys >> _U8(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return ((s, int(a), int(b)) for s, (a, b) in enumerate(zip(edge, edge[1:])) if b > a)


def _rows(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    kind, shard, block, data = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(shard, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], ["kind", "shard", "block", "data"])


def _counted(words: list[np.ndarray], n: np.ndarray, bits: int, part: int = 0, parts: int = 1) -> list[tuple[str, int, int, bytes]]:
    """Blobs of distinct n-grams and their counts, by shard; of every ``parts``-th shard from ``part`` on."""
    keys = key(words)
    if parts > 1:
        own = (keys >> _U8(64 - bits)) % _U8(parts) == _U8(part)
        keys, words, n = keys[own], [w[own] for w in words], n[own]
    keys, at, (n,) = _sums(keys, n)
    out = []
    for shard, a, b in _shards(keys, bits):
        own = at[a:b]
        by = np.argsort(words[0][own])  # the first word repeats, so its differences are small
        out.append((f"n{len(words)}", shard, -1, pack(*(w[own[by]] for w in words), n[a:b][by])))
    return out


def _gathered(table: pa.Table, kind: str) -> list[np.ndarray]:
    types = _types(kind)
    blobs = [unpack(d, types) for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()) if k == kind]
    return [np.concatenate(c) for c in zip(*blobs)] if blobs else [np.zeros(0, t) for t in types.split()]


def count(texts: DataFrame, order: int, bits: int, turn: int = 0, turns: int = 1, most: int = 4_000_000) -> DataFrame:
    """Counted n-grams of column text, of one part of the shards; a task holds ``most`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(columns(part.column("text"), order)[0])
                size += len(held[-1][0])
                if size >= most:
                    words = [np.concatenate(c) for c in zip(*held)]
                    yield _rows(_counted(words, np.ones(size, np.uint64), bits, turn, turns))
                    held, size = [], 0
        if size:
            words = [np.concatenate(c) for c in zip(*held)]
            yield _rows(_counted(words, np.ones(size, np.uint64), bits, turn, turns))

    return texts.mapInArrow(run, _ROW)


def _write(uri: str, data: list[bytes]) -> None:
    """A whole file or none, however often tasks run."""
    folder, name = uri.rsplit("/", 1)
    fs, base = _open(folder)
    _save(fs, f"{base}/{name}", f"{uuid.uuid4().hex}", data)


def _load(uri: str, kind: str) -> list[np.ndarray]:
    """Arrays of a file; empty ones if there is none."""
    fs, path = _open(uri)
    try:
        with fs.open_input_stream(path) as file:
            return unpack(file.read(), _types(kind))
    except FileNotFoundError:
        return [np.zeros(0, t) for t in _types(kind).split()]


def _reduce(level: int, bits: int, folder: str):
    def run(table: pa.Table) -> pa.Table:
        *words, n = _gathered(table, f"n{level}")
        keys, at, (n,) = _sums(key(words), n)
        words = [w[at] for w in words]
        shard = table.column("shard")[0].as_py()
        _write(f"{folder}/a{level}-{shard}", [pack(keys, n)])
        out = []
        few = [(n == i).astype(np.uint64) for i in (1, 2)] + [(n >= 3).astype(np.uint64)]
        if level > 1:
            context, _, sums = _sums(key(words[:-1]), n, *few)
            out += [(f"x{level}", s, -1, pack(context[a:b], *(x[a:b] for x in sums))) for s, a, b in _shards(context, bits)]
            out += _counted(words[1:], np.ones(len(n), np.uint64), bits)
        stat = np.array([len(n), n.sum(), *((n == i).sum() for i in (1, 2, 3, 4))], np.uint64)
        out.append((f"s{level}", shard, -1, stat.tobytes()))
        return pa.Table.from_batches([_rows(out)])

    return run


class Discounts:
    """Of each order: modified Kneser-Ney discounts of counts 1, 2 and 3 or more; and what the lowest order shares out."""

    def __init__(self, order: int, stats: dict[int, np.ndarray]) -> None:
        self.order = order
        self.of = {level: self._discounts(stats[level][2:]) for level in range(1, order + 1)}
        types, total, n1, n2 = (float(x) for x in stats[1][:4])
        self.total = total
        self.rest = float(np.dot(self.of[1], [n1, n2, types - n1 - n2])) / total / (types + 1)

    @staticmethod
    def _discounts(counts: np.ndarray) -> np.ndarray:
        n1, n2, n3, n4 = (float(x) for x in counts)
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        out = [i - (i + 1) * y * b / a if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return np.array([min(max(d, 0.05), i - 0.05 if i < 3 else 2.95) for d, i in zip(out, (1, 2, 3))])

    def less(self, level: int, n: np.ndarray) -> np.ndarray:
        """Counts after their discount."""
        n = n.astype(np.int64)
        return n - np.r_[0.0, self.of[level]][np.minimum(n, 3)]


class Model:
    """``folder``: files a<level>-<shard> (counts) and c<level>-<shard> (total and weight of contexts)."""

    def __init__(self, folder: str, discounts: Discounts, bits: int) -> None:
        self.folder, self.discounts, self.bits = folder, discounts, bits


def fit(texts: DataFrame, order: int = 2, bits: int = 4, parts: int = 4) -> Model | None:
    """From column text of trusted documents."""
    spark = texts.sparkSession
    small_batches(spark)
    folder, stats, shares = scratch(spark, "model"), {}, []
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    levels, known = [count(texts, order, bits, part, parts) for part in range(parts)], set(made())
    for n in range(order, 0, -1):
        done = [materialize(level.groupBy("shard").applyInArrow(_reduce(n, bits, folder), _ROW), f"order-{n}") for level in levels]
        done = reduce(DataFrame.unionByName, done)
        rows = [np.frombuffer(r[0], np.uint64) for r in done.filter(F.col("kind") == f"s{n}").select("data").collect()]  # a row per shard
        if not rows:
            return None
        stats[n] = np.sum(rows, 0)
        shares.append(done.filter(F.col("kind") == f"x{n}"))
        levels = [done.filter(F.col("kind") == f"n{n - 1}")]
    discounts = Discounts(order, stats)

    def contexts(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        for n in range(2, order + 1):
            keys, *values = _gathered(rows, f"x{n}")
            keys, _, (total, *few) = _sums(keys, *values)
            freed = sum(d * x for d, x in zip(discounts.of[n], few))
            _write(f"{folder}/c{n}-{shard}", [pack(keys, total.astype("<f8"), np.asarray(freed / np.maximum(total, 1), "<f8"))])
        return pa.table({"shard": pa.array([shard], pa.int64())})

    reduce(DataFrame.unionByName, shares).groupBy("shard").applyInArrow(contexts, "shard long").collect()  # writes files; a row per shard
    del done, levels, shares
    sweep(spark, [path for path in made() if path not in known])  # all is in the folder now
    release(spark)
    return Model(folder, discounts, bits)


def _asked(words: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The n-grams and contexts that scores of these words need, one for each word."""
    order = len(words)
    grams = {f"a{n}": key(words[order - n :]) for n in range(1, order + 1)}
    return grams | {f"c{n}": key(words[order - n : order - 1]) for n in range(2, order + 1)}


def _find(keys: np.ndarray, known: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Values of each key, 0 where it isn't known."""
    if not len(known):
        return [np.zeros(len(keys), v.dtype) for v in values]
    order, at = np.argsort(keys), np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(known, keys[order])  # in ascending order the search stays where it is
    at = np.minimum(at, len(known) - 1)
    hit = known[at] == keys
    return [np.where(hit, v[at], v.dtype.type(0)) for v in values]


def log_probabilities(asked: dict[str, np.ndarray], answers: dict[str, list[np.ndarray]], d: Discounts) -> np.ndarray:
    (n,) = _find(asked["a1"], *answers["a1"])
    p = d.less(1, n) / d.total + d.rest
    for level in range(2, d.order + 1):
        total, weight = _find(asked[f"c{level}"], *answers[f"c{level}"])
        (n,) = _find(asked[f"a{level}"], *answers[f"a{level}"])
        p = np.where(total > 0, d.less(level, n) / np.maximum(total, 1) + weight * p, p)
    return np.log(p)


def _runs(part: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of rows of one block."""
    block = part.column("_block").to_numpy()
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
    return ((int(block[a]), part.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a)


def _questions(rows: DataFrame, order: int, bits: int, most: int = 4_000_000) -> DataFrame:
    def ask(block: int, held: list) -> pa.RecordBatch:
        out = []
        for kind, keys in _asked([np.concatenate(c) for c in zip(*held)]).items():
            keys = _distinct(keys)
            out += [(f"q{kind}", s, block, pack(keys[a:b])) for s, a, b in _shards(keys, bits)]
        return _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in batches:
            for part in slices(batch, "_text"):
                for block, own in _runs(part):
                    if size and (block != now or size >= most):
                        yield ask(now, held)
                        held, size = [], 0
                    now = block
                    words = columns(own.column("_text"), order)[0]
                    if len(words[0]):
                        held.append(words)
                        size += len(words[0])
        if size:
            yield ask(now, held)

    return rows.mapInArrow(run, _ROW)


def _meet(folder: str):
    """What a shard knows of what each block asks."""

    def run(asked: pa.Table) -> pa.Table:
        out, known = [], {}
        shard = asked.column("shard")[0].as_py()
        for kind, block, data in zip(*(asked.column(c).to_pylist() for c in ("kind", "block", "data"))):
            kind = kind[1:]
            if kind not in known:
                known[kind] = _load(f"{folder}/{kind}-{shard}", kind)
            keys, *values = known[kind]
            wanted = unpack(data, "<u8")[0]
            at = np.searchsorted(keys, wanted)
            at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)] if len(keys) else at[:0]
            if len(at):
                out.append((kind, 0, block, pack(keys[at], *(v[at] for v in values))))
        return pa.Table.from_batches([_rows(out)])

    return run


def _file(base: str, block: int) -> str:
    return f"{base}/{block & (1 << 64) - 1:016x}"


def _stored(out: str):
    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        body = []
        for kind in sorted(set(rows.column("kind").to_pylist())):
            columns = _gathered(rows, kind)
            by = np.unique(columns[0], return_index=True)[1]  # parts of a block that two tasks read may ask alike
            data = pack(*(c[by] for c in columns))
            body += [kind.encode().ljust(8), np.array([len(data)], "<u8").tobytes(), data]
        _write(_file(out, block), body)
        return pa.table({"block": pa.array([block], pa.int64())})

    return run


def _answers(out: str, block: int, order: int) -> dict[str, list[np.ndarray]]:
    found = {k: [np.zeros(0, t) for t in _types(k).split()] for n in range(1, order + 1) for k in (f"a{n}", f"c{n}")}
    fs, base = _open(out)
    try:
        with fs.open_input_stream(_file(base, block)) as file:
            data = file.read()
    except FileNotFoundError:  # nothing this block holds was counted
        return found
    at = 0
    while at < len(data):
        kind, size = data[at : at + 8].decode().strip(), int(np.frombuffer(data, "<u8", 1, at + 8)[0])
        found[kind] = unpack(data[at + 16 : at + 16 + size], _types(kind))
        at += 16 + size
    return found


def _blocked(docs: DataFrame, keep: list[str], size: int = 24 << 20) -> DataFrame:
    """keep, _text and _block: about ``size`` bytes of text in rows that follow each other in a file."""
    try:
        docs.select("_metadata.row_index")
        text = F.col("text").cast("string")
    except AnalysisException:  # not read from files: write it, so that rows have places that stay
        docs = materialize(docs.select(*keep, F.col("text").cast("string").alias("_text")), "texts")
        text = F.col("_text")
    rows, length = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    each = int(min(65_536, max(16, size * rows // max(1, length or 0)))) if rows else 16
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / each))
    return docs.select(*keep, text.alias("_text"), block.alias("_block"))


def perplexities(docs: DataFrame, model: Model | None, keep: list[str], passes: int = 8) -> DataFrame:
    """The columns ``keep`` with n_words and perplexity."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows, out = _blocked(docs, keep), scratch(spark, "answers")
    fs, base = _open(out)
    fs.create_dir(base, recursive=True)
    order, discounts = (model.discounts.order, model.discounts) if model else (1, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers = None, None
        for batch in batches:
            for part in slices(batch, "_text"):
                for block, own in _runs(part):
                    words, first = columns(own.column("_text"), order)
                    n = np.diff(first)
                    value = np.zeros(len(n))
                    if discounts is not None and len(words[0]):
                        if block != now:
                            now, answers = block, _answers(out, block, order)
                        total = np.r_[0.0, np.cumsum(log_probabilities(_asked(words), answers, discounts))][first]
                        value = np.exp(-np.diff(total) / np.maximum(n, 1))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), pa.array(n), pa.array(value, mask=n == 0)], [*keep, "n_words", "perplexity"])

    scored = None
    for turn in range(passes if model else 1):
        own = rows.filter(F.pmod("_block", F.lit(passes)) == turn) if model else rows
        if model:
            asked = _questions(own.select("_text", "_block"), order, model.bits)
            met = asked.groupBy("shard").applyInArrow(_meet(model.folder), _ROW)
            materialize(met.groupBy("block").applyInArrow(_stored(out), "block long"), "answered")
        one = materialize(own.mapInArrow(run, f"{kinds}, n_words long, perplexity double"), "scores")
        if model:  # this part's answers are used up
            fs.delete_dir_contents(base)
        scored = one if scored is None else scored.unionByName(one)
    return scored


def classify(docs: DataFrame, labels: DataFrame, order: int = 2, quantile: float = 0.99, least: int = 30, passes: int = 8, per_shard: int = 48 << 20) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    good = materialize(good, "good")
    side = bounded(good)
    ids = {"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string")}
    aside = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(5)) == 0
    length = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(2, length / per_shard)))))
    trusted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull() & ~aside)
    model = fit(trusted.join(side, F.col("doc_id") == F.col("_good"), "left_semi").select("text"), order, bits)
    scored = perplexities(docs.withColumns(ids), model, ["doc_id", "lang"], passes)
    known = scored.join(side, F.col("doc_id") == F.col("_good"), "left_semi").filter(F.col("perplexity").isNotNull() & aside)
    by = known.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    by = by.select(F.col("lang").alias("_lang"), F.when(F.col("n") >= least, F.col("own")).alias("own"))
    every = known.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    joined = scored.join(F.broadcast(by), F.col("lang").eqNullSafe(F.col("_lang")), "left")  # a row per language
    threshold = F.coalesce(F.col("own"), F.lit(every).cast("double"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return joined.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
