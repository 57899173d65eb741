"""Token ids in files: one zstandard frame per document, under one shared dictionary.

A folder holds ``dictionary`` (trained on serialized id arrays of a bounded sample), and for each
shard ``NNNNNN.bin``, frames end to end, with ``NNNNNN.idx``: magic, id width, count of documents and the
sha256 of the dictionary, then doc_id (with a null flag), the frame's offset and the number of ids of
each.  Shards, and documents in them, are in ascending doc_id order (null last), so a document is found
by binary search and read by one ranged read.

Documents are range-partitioned by doc_id first and encoded in order, so ids are never shuffled.
A task writes its shard under a name of its own and renames it; one that runs again writes the same.

Encoding is the tokenizer library's.  For the tokenizer whose pre-tokenizer cuts letters, single digits
and symbols apart, each distinct piece is encoded by the library's model once per worker and remembered
(up to twice ``memory`` pieces and those of a slice; when there are more, those not met lately go), and pieces of Latin-1 texts without
apostrophes are cut and told apart in arrays, exactly, before the memory is asked; texts with characters that are or lower to ones beyond U+024F, control
separators or special token marks go through the library whole.

Defined results: a null or empty text is the end id alone.  Repeated doc_ids are in order of their texts'
hashes.  Other columns are ignored.  An empty table gives no shards and no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, release, scratch, slices, small_batches, with_keys

MAGIC = b"ALIDS001"
_PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Characters below U+0250 whose lower case is not.
_RISING = "".join(chr(i) for i in range(0x250) if max(chr(i).lower()) >= "\u0250")
_SLOW = re.compile(rf"[\x1c-\x1f{_RISING}\u0250-\U0010ffff]|<\|")
_BYTES = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_AS_CHAR = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _BYTES)}


def _range(kind: str) -> str:
    """Characters of a general category below U+0250, for use in a class."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


#: The pre-tokenizer's pattern for texts that hold nothing ``_SLOW`` finds.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_range('L')}]+|[{_range('N')}]|[^\t-\r \x85\xa0{_range('L')}{_range('N')}]+")


#: Of each byte of Latin-1 text: 0 white space, 1 letter, 2 number, 3 symbol.
_CLASS = np.array([0 if chr(i) in "\t\n\x0b\x0c\r \x85\xa0" else {"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 3) for i in range(256)], np.uint8)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_WHOLE, _BY_PATTERN, _BY_BYTE = range(3)


def _way(text: str) -> int:
    """How a text is cut: not at all, by the pattern, or as Latin-1 bytes, where no piece but a run of one class occurs."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WHOLE if _SLOW.search(text) else _BY_PATTERN
    if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return _WHOLE
    return _BY_PATTERN if "'" in text or "\0" in text else _BY_BYTE


class _Pieces(dict):
    """Serialized ids by piece; what is not there is taken from ``old`` or encoded."""

    def __init__(self, encode: Callable[[str], bytes], old: dict[str, bytes]) -> None:
        self.encode, self.old = encode, old

    def __missing__(self, piece: str) -> bytes:
        known = self.old.get(piece)
        if known is None:
            known = self.encode(piece)
        self[piece] = known
        return known


class Encoder:
    """Texts to serialized ids (little-endian, 2 bytes where the vocabulary allows)."""

    def __init__(self, path: str, memory: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.known = all(made.get(k) == v for k, v in _PLAIN.items())
        most = max(self.library.get_vocab().values(), default=0)
        self.codes = [i.tobytes() for i in np.arange(most + 1).astype(self.kind)]
        self.memory, self.cache = memory, _Pieces(self._piece, {})

    def _piece(self, piece: str) -> bytes:
        word = piece if piece.isascii() and piece.isprintable() else "".join(map(_AS_CHAR.__getitem__, piece.encode()))
        codes = self.codes
        return b"".join([codes[t.id] for t in self.library.model.tokenize(word)])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _by_byte(self, texts: list[str]) -> list[bytes]:
        """All pieces of all texts are found and told apart in arrays; the memory is asked once for each."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        line = "\n".join(texts).lower()
        data = np.frombuffer(line.encode("latin-1") + bytes(17), np.uint8)
        kind = np.r_[np.uint8(0), _CLASS[data[: len(line)]], np.uint8(0)]
        turn = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start = np.flatnonzero(turn[:-1] & (kind[1:-1] > 0))
        if not len(start):
            return [b""] * len(texts)
        size = np.flatnonzero((turn[1:] | (kind[1:-1] == 2)) & (kind[1:-1] > 0)) + 1 - start
        eight = np.lib.stride_tricks.as_strided(data.view(np.uint8)[:8].view("<u8"), (len(line) + 9,), (1,))
        low, high = eight[start] & _KEEP[np.minimum(size, 8)], eight[np.minimum(start + 8, len(line))] & _KEEP[np.clip(size - 8, 0, 8)]
        long = np.flatnonzero(size > 16)
        high[long] = long.astype(np.uint64) << np.uint64(32)  # each on its own
        low[long] = 0
        order = np.argsort(mix(low + high * np.uint64(0x9E3779B97F4A7C15)))
        other = np.r_[True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])]
        heads = order[other]
        known = list(map(self.cache.__getitem__, [line[a:b] for a, b in zip(start[heads].tolist(), (start + size)[heads].tolist())]))
        width = np.dtype(self.kind).itemsize
        n = np.fromiter(map(len, known), np.int64, len(known)) // width
        piece = np.empty(len(start), np.int64)
        piece[order] = np.cumsum(other) - 1
        many = n[piece]
        upto = np.r_[0, many.cumsum()]
        ids = np.frombuffer(b"".join(known), self.kind)[np.repeat((n.cumsum() - n)[piece] - upto[:-1], many) + np.arange(upto[-1])].tobytes()
        at = (width * upto[np.r_[0, np.searchsorted(start, ends)]]).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.memory:
            self.cache = _Pieces(self._piece, dict(self.cache))
        ways = [_way(t) if self.known else _WHOLE for t in texts]
        easy = [t for t, way in zip(texts, ways) if way == _BY_BYTE]
        done = iter(self._by_byte(easy) if easy else ())
        cut = lambda t: b"".join(map(self.cache.__getitem__, _PIECES.findall(t.lower())))
        return [next(done) if way == _BY_BYTE else cut(t) if way == _BY_PATTERN else self.whole(t) for t, way in zip(texts, ways)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _save(fs: pafs.FileSystem, path: str, own: str, data: list[bytes]) -> None:
    with fs.open_output_stream(f"{path}.{own}") as out:
        for piece in data:
            out.write(piece)
    fs.move(f"{path}.{own}", path)


def train_dictionary(docs: DataFrame, path: str, sample: int = 600, size: int = 1 << 16, most: int = 8192) -> bytes:
    """A dictionary from ``sample`` documents at most, chosen by a hash of doc_id, ``most`` bytes of ids of each."""
    order = F.xxhash64("doc_id", F.lit(11))
    edge = docs.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[:most] for x in encoder(path).encode(texts)], pa.binary())], ["ids"])

    chosen = docs.filter(order <= edge).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "ids binary").limit(2 * sample)
    samples = sorted(bytes(r[0]) for r in chosen.collect() if len(r[0]) >= 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write(docs: DataFrame, out: str, path: str, end_id: int | None = 2, level: int = 3, shards: int | None = None) -> list[tuple[int, int, int]]:
    """Write documents' ids to the folder ``out``; (shard, documents, ids) of each shard, in order."""
    spark = docs.sparkSession
    small_batches(spark)
    book = train_dictionary(docs, path)
    fs, base = _open(out)
    fs.create_dir(base, recursive=True)
    _save(fs, f"{base}/dictionary", "driver", [book])
    shared = spark.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        book = shared.value
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(book) if book else None, write_content_size=True)
        end = b"" if end_id is None else np.array([end_id], codec.kind).tobytes()
        width = np.dtype(codec.kind).itemsize
        context = TaskContext.get()
        fs, base = _open(out)
        shard, own = context.partitionId(), f"{context.stageId()}-{context.taskAttemptId()}"
        ids, nulls, sizes, counts = [], [], [], []
        stream = None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                if stream is None:
                    stream = fs.open_output_stream(f"{base}/{shard:06d}.bin.{own}")
                column = part.column("doc_id")
                ids.append(column.fill_null(0).to_numpy())
                nulls.append(column.is_null().to_numpy(zero_copy_only=False))
                for x in codec.encode(["" if t is None else t for t in part.column("text").to_pylist()]):
                    frame = pack.compress(x + end)
                    stream.write(frame)
                    sizes.append(len(frame))
                    counts.append((len(x) + len(end)) // width)
        if stream is None:
            return
        stream.close()
        fs.move(f"{base}/{shard:06d}.bin.{own}", f"{base}/{shard:06d}.bin")
        head = MAGIC + np.array([width, len(counts)], "<u8").tobytes() + hashlib.sha256(book).digest()
        body = [np.concatenate(ids).astype("<i8"), np.concatenate(nulls).astype("u1"), np.r_[0, np.cumsum(sizes)].astype("<u8"), np.array(counts, "<u8")]
        _save(fs, f"{base}/{shard:06d}.idx", own, [head, *(b.tobytes() for b in body)])
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(counts)]), pa.array([int(sum(counts))])], ["shard", "docs", "ids"])

    rows = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    order = ["_k", "_t"]
    rows = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    made = rows.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "shard long, docs long, ids long").collect()
    release(spark)
    return sorted(tuple(r) for r in made)


class Shard:
    """Reads documents of one shard."""

    def __init__(self, out: str, shard: int) -> None:
        fs, base = _open(out)
        with fs.open_input_stream(f"{base}/{shard:06d}.idx") as file:
            idx = file.read()
        if idx[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        width, n = np.frombuffer(idx, "<u8", 2, 8).tolist()
        with fs.open_input_stream(f"{base}/dictionary") as file:
            book = file.read()
        if hashlib.sha256(book).digest() != idx[24:56]:
            raise ValueError("the dictionary is not the one these documents were written with")
        at = 56
        self.doc_id = np.frombuffer(idx, "<i8", n, at)
        self.null = np.frombuffer(idx, "u1", n, at + 8 * n).astype(bool)
        self.offset = np.frombuffer(idx, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.n_tokens = np.frombuffer(idx, "<u8", n, at + 17 * n + 8).astype(np.int64)
        self.kind = "<u2" if width == 2 else "<u4"
        self.file = fs.open_input_file(f"{base}/{shard:06d}.bin")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book) if book else None)

    def frames(self, a: int, b: int) -> list[np.ndarray]:
        """Ids of documents a to b - 1, by one ranged read."""
        lo = int(self.offset[a])
        data = self.file.read_at(int(self.offset[b]) - lo, lo)
        return [np.frombuffer(self.unpack.decompress(data[self.offset[i] - lo : self.offset[i + 1] - lo]), self.kind) for i in range(a, b)]


def read(spark: SparkSession, out: str, shards: list[tuple[int, int, int]], fields: str, digest: Callable) -> DataFrame:
    """A row per document in the files: what ``digest(doc_ids, starts, list of id arrays)`` returns as arrays."""
    starts = np.r_[0, np.cumsum([s[2] for s in shards])].tolist()
    plan = [(s[0], s[1], a) for s, a in zip(shards, starts)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "docs", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, docs, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                files = Shard(out, shard)
                for a in range(0, docs, 256):
                    b = min(docs, a + 256)
                    first = start + np.r_[0, files.n_tokens[:b].cumsum()][a:b]
                    ids = pa.array(files.doc_id[a:b], mask=files.null[a:b])
                    yield digest(ids, first, files.frames(a, b))

    return spark.createDataFrame(plan, schema).repartition(max(1, len(plan)), "shard").mapInArrow(run, fields)


def _digest(ids: pa.Array, first: np.ndarray, frames: list[np.ndarray]) -> pa.RecordBatch:
    sums = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in frames]
    return pa.RecordBatch.from_arrays([ids, pa.array(first.astype(np.int64)), pa.array([len(x) for x in frames], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def tokenize(docs: DataFrame, path: str, out: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    out = out or scratch(spark, "ids")
    return read(spark, out, write(docs, out, path, end_id), "doc_id long, start long, n_tokens long, ids_crc32 long", _digest)
