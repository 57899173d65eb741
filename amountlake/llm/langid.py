"""Language identification by error-correcting output codes over byte n-gram classifiers.

Each language has a codeword; for each bit a binary classifier weighs the trigrams of languages with
that bit against those without.  Up to seven languages take the exhaustive code, more a seeded random
dense code of about ten bits per doubling, the best of many by its smallest Hamming distance.  A text's
margins are decoded by the logistic loss to each codeword, so a sure bit counts more than a doubtful
one; the nearest codeword wins, and a small gap to the second flags ambiguity.

Classifiers are log ratios of smoothed trigram shares, counted over every labelled training text (no
sample).  Each language weighs alike, however many rows it has.  What reaches the driver is one
histogram of ``buckets`` counts per language.

Defined results: a null text, or one with no letter, is ``und`` with score 0 and not ambiguous; so is
every text if nothing was learned.  With one language learned, it is predicted.  Ties go to the
language first in order.  A null doc_id is neither held out nor learned from.  Repeated rows give
repeated results.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, raw, slices, small_batches

UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def histograms(texts: pa.Array, buckets: int) -> np.ndarray:
    """Counts of hashed byte trigrams of each text; all that is no letter in ASCII reads as a blank."""
    data, at = raw(pc.utf8_lower(texts))
    data = _FOLD[data].astype(np.uint64)
    out = np.zeros((len(texts), buckets), np.float32)
    if len(data) < 3:
        return out
    code = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    slot = (mix(code) % np.uint64(buckets)).astype(np.int64)
    slot[code == 0x202020] = -1
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = slot[a : max(a, b - 2)]
        out[i] = np.bincount(own[own >= 0], minlength=buckets)
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1."""
    if n <= 7:
        bits = np.array([[(c >> r) & 1 for c in range(1, 1 << (n - 1))] for r in range(n - 1)] + [[0] * ((1 << (n - 1)) - 1)])
        return bits * 2 - 1
    rng, length, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, length)) * 2 - 1
        if (np.abs(code.sum(0)) == n).any():
            continue
        gap = (length - code @ code.T) // 2
        least = gap[~np.eye(n, dtype=bool)].min()
        if least > far:
            best, far = code, least
    return best


class Model:
    """langs, their codewords, and a weight per bucket and bit."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5) -> None:
        self.langs = langs
        self.code = codewords(len(langs)) if len(langs) > 1 else np.zeros((len(langs), 0))
        share = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1])
        yes = np.stack([share[self.code[:, b] > 0].mean(0) for b in range(self.code.shape[1])], 1) if len(langs) > 1 else np.zeros((counts.shape[1], 0))
        no = np.stack([share[self.code[:, b] < 0].mean(0) for b in range(self.code.shape[1])], 1) if len(langs) > 1 else yes
        self.weights = (np.log(yes) - np.log(no)).astype(np.float32) if len(langs) > 1 else yes
        self.buckets = counts.shape[1]

    def decode(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score (0 to 1), and the gap in loss to the second."""
        n = hist.sum(1, keepdims=True)
        margin = (hist @ self.weights) / np.maximum(n, 1) * np.minimum(n, 100) / 4
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        best = loss.argmin(1)
        ranked = np.sort(loss, 1)
        gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        score = 1 / np.exp(ranked[:, :1] - loss).sum(1)
        return best, np.clip(score, 0, 1), gap


def fit(train: DataFrame, buckets: int = 8192) -> Model | None:
    """Learn from columns text and lang; rows where either is null tell nothing."""
    small_batches(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hist = histograms(part.column("text"), buckets)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + hist[langs == lang].sum(0, dtype=np.float64)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            if not len(at):
                at = np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = train.filter("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return None
    counts = np.zeros((len(langs), buckets))
    place = {x: i for i, x in enumerate(langs)}
    np.add.at(counts, ([place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()), got.column("n").to_numpy())
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model | None, keep: list[str], gap: float = 0.5) -> DataFrame:
    """The columns ``keep`` of each row, with lang_pred, score and ambiguous."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                texts = part.column("_text").fill_null("")
                known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & (m is not None)
                lang, score, doubt = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if m is not None and known.any():
                    best, sure, apart = m.decode(histograms(texts, m.buckets))
                    lang[known] = np.array(m.langs, object)[best][known]
                    score[known] = sure[known]
                    doubt[known] = apart[known] < gap
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], [*keep, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.filter("doc_id is not null and not held_out"))
    return predict(rows, model, ["doc_id", "held_out"])
