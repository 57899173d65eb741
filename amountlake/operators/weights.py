"""A tagger from weights: embedding, dilated convolutions, two heads; and the weights files it reads and writes."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import CLASSES
from .decode import decode
from .tagger import SPAN, finish

PAD_TAIL, WINDOW, OVERLAP = 24, 128, 16
#: (kernel, dilation, residual) of the layers of each architecture
ARCHITECTURES = {
    "v1": ((3, 1, False), (5, 1, False), (3, 2, False), (3, 4, False)),
    "v2": ((5, 1, False), *((3, d, True) for d in (1, 2, 4, 8))),
}


def parameters(arch: str, vocabulary: int, embed: int = 16, channels: int = 48, classes: int = len(CLASSES)) -> int:
    total, width = vocabulary * embed, embed
    for k, _, _ in ARCHITECTURES[arch]:
        total += channels * width * k + channels
        width = channels
    return total + (channels + 1) * (3 + classes)


def quantize(x: np.ndarray) -> dict:
    """Symmetric int8, one scale per tensor."""
    top = float(np.abs(x).max()) if x.size else 0.0
    scale = top / 127 if top else 1.0
    return {"shape": list(x.shape), "scale": scale, "data_b64": base64.b64encode(np.clip(np.rint(x / scale), -127, 127).astype(np.int8).tobytes()).decode()}


def _tensor(t) -> np.ndarray:
    if isinstance(t, dict) and "data_b64" in t:
        return np.frombuffer(base64.b64decode(t["data_b64"]), np.int8).astype(np.float32).reshape(t["shape"]) * np.float32(t["scale"])
    if isinstance(t, dict):
        return np.asarray(t["data"], np.float32).reshape(t["shape"])
    return np.asarray(t, np.float32)


def _plain(x: np.ndarray) -> dict:
    digits = lambda v: float(f"{v:.5g}")
    return {"shape": list(x.shape), "data": [digits(v) for v in x.reshape(-1)]}


class Network:
    """Both file versions, float or int8, as one list of layers."""

    def __init__(self, made: dict) -> None:
        self.charset = {c: i for i, c in enumerate(made["charset"])}
        self.classes = list(made.get("classes", CLASSES))
        self.embed = _tensor(made["embed"])
        if "conv" in made:
            layers = [(x["k"], x["dilation"], x["residual"], x) for x in made["conv"]]
        else:
            shapes = [(3, 1), (5, 1), (3, made.get("dilation", 2)), (3, 4)][: made.get("layers", 3)]
            layers = [(k, d, False, made[f"conv{i}"]) for i, (k, d) in enumerate(shapes, 1)]
        self.conv = [(k, d, r, _tensor(x["w"]), _tensor(x["b"])) for k, d, r, x in layers]
        self.heads = [(_tensor(made[h]["w"]), _tensor(made[h]["b"])) for h in ("bio", "cls")]
        self.crf = [_tensor(made["crf"][n]) for n in ("trans", "start", "end")] if made.get("crf") else None

    def save(self, int8: bool = False) -> dict:
        pack, bias = (quantize, lambda b: [float(v) for v in b]) if int8 else (_plain, _plain)
        out = {"version": 2, "charset": list(self.charset), "classes": self.classes, "embed": pack(self.embed)}
        out["conv"] = [{"k": k, "dilation": d, "residual": r, "w": pack(w), "b": bias(b)} for k, d, r, w, b in self.conv]
        out |= {h: {"w": pack(w), "b": bias(b)} for h, (w, b) in zip(("bio", "cls"), self.heads)}
        if self.crf:
            out["crf"] = {n: _plain(x) for n, x in zip(("trans", "start", "end"), self.crf)}
        return out

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        """Ids, padded by at least 24 to one length."""
        width = max(map(len, texts), default=0) + PAD_TAIL
        ids = np.zeros((len(texts), width), np.int64)
        for row, text in zip(ids, texts):
            row[: len(text)] = [self.charset.get(c, 1) for c in text]
        return ids

    def logits(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed[self.encode(texts)]  # text, place, channel
        for k, d, residual, w, b in self.conv:
            reach = d * (k - 1) // 2
            wide = np.pad(x, ((0, 0), (reach, reach), (0, 0)))
            y = b + sum(wide[:, i * d : i * d + x.shape[1]] @ w[:, :, i].T for i in range(k))
            x = np.maximum(y, 0) + x if residual else np.maximum(y, 0)
        return tuple(x @ w.T + b for w, b in self.heads)

    def tag(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bio, class, three probabilities) per character; long texts in windows, the first that holds a character decides."""
        pieces = [(i, at, t[at : at + WINDOW]) for i, t in enumerate(texts) for at in window_starts(len(t))]
        out = [(np.zeros(len(t), np.int64), np.zeros(len(t), np.int64), np.zeros((len(t), 3), np.float32)) for t in texts]
        if not pieces:
            return out
        bio, cls = self.logits([p[2] for p in pieces])
        for (i, at, piece), b, c in zip(pieces, bio, cls):
            n, skip = len(piece), OVERLAP if at else 0
            p = np.exp(b[:n] - b[:n].max(1, keepdims=True)) if n else b[:0]
            path = viterbi(b[:n], *self.crf) if self.crf else b[:n].argmax(1)
            for target, found in zip(out[i], (path, c[:n].argmax(1), p / p.sum(1, keepdims=True) if n else p)):
                target[at + skip : at + n] = found[skip:]
        return out


def window_starts(n: int) -> list[int]:
    stride = WINDOW - OVERLAP
    return list(range(0, max(1, n - OVERLAP), stride)) if n > WINDOW else [0]


def viterbi(scores: np.ndarray, trans: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best path in single precision; ties keep the lowest label."""
    scores = scores.astype(np.float32)
    if not len(scores):
        return np.zeros(0, np.int64)
    now, back = start + scores[0], []
    for s in scores[1:]:
        ways = now[:, None] + trans
        back.append(ways.argmax(0))
        now = ways.max(0) + s
    path = [int((now + end).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def weights_tagger(spark: SparkSession, made: dict | str):
    """A tagger for :func:`parse_df` from weights, as a dict or a path to JSON; broadcast once, of fixed size."""
    if isinstance(made, str):
        with open(made, encoding="utf-8") as file:
            made = json.load(file)
    shared = spark.sparkContext.broadcast(Network(made))

    def run(texts: pd.Series) -> pd.Series:
        net = shared.value
        rows = [t or "" for t in texts]
        out: list[list[dict]] = []
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            for text, (bio, cls, p) in zip(part, net.tag(part)):
                spans = decode(text, bio.tolist(), [net.classes[c] for c in cls.tolist()], p.max(1).tolist() if len(p) else [])
                out.append([finish(s, text) | {"raw_confidence": score} for s, score in spans])
        return pd.Series(out)

    def tagger(text: Column) -> Column:
        return F.pandas_udf(run, f"array<{SPAN}>")(text)

    return tagger
