"""Decoding of character tags, and the tagger from weights."""

import re

import numpy as np
import pytest

from amountlake.functions.lexicon import CLASSES
from amountlake.operators import weights
from amountlake.operators.decode import decode, repair_classes
from amountlake.operators.parse import parse_df


def _tags(text, spans):
    """spans: (start, pieces of (class, text)); blanks in them are SEP."""
    bio, cls = [0] * len(text), ["O"] * len(text)
    for start, pieces in spans:
        at = start
        for c, piece in pieces:
            for i in range(at, at + len(piece)):
                bio[i], cls[i] = (1 if i == start else 2), c
            at += len(piece)
    return bio, cls


def _classes(text, spans, **changes):
    bio, cls = _tags(text, spans)
    for i in changes.get("gaps", ()):
        bio[i] = 0
    for i, c in changes.get("classes", {}).items():
        cls[i] = c
    return [[(t[0], t[1]) for t in tokens if t[0] != "SEP"] for tokens, _ in decode(text, bio, cls)]


def _line(tagged):
    """Text, and a span from "piece=CLASS piece=CLASS": blanks stand for themselves, + joins."""
    pieces = []
    for part in re.split(r"( |\+)", tagged):
        if part != "+":
            piece, _, cls = part.rpartition("=") if "=" in part else (part, "", "SEP")
            pieces.append((cls, piece))
    return "".join(p for _, p in pieces), pieces


def _decoded(*tagged, glue=" ", **changes):
    text, spans = "", []
    for t in tagged:
        text += glue if text else ""
        own, pieces = _line(t)
        spans.append((len(text), pieces))
        text += own
    return [" ".join(f"{t}={c}" for c, t in s) for s in _classes(text, spans, **changes)]


def test_digits_and_points():
    assert _classes("15000/month", [(0, _line("1500=DIGITS")[1])]) == [[("DIGITS", "15000")]]
    assert _decoded("1=DIGITS+.=O+5=DIGITS+cr=UNIT_CRORE") == ["1=DIGITS .=DOT 5=DIGITS cr=UNIT_CRORE"]


def test_connectors():
    assert _decoded("2=DIGITS lakh=UNIT_LAKH+/=SEP+3=DIGITS lakh=UNIT_LAKH") == ["2=DIGITS lakh=UNIT_LAKH /=RANGE 3=DIGITS lakh=UNIT_LAKH"]
    assert repair_classes("dedh-lakh", 0, 9, ["PFX_DEDH"] * 4 + ["RANGE"] + ["UNIT_LAKH"] * 4)[4] == "SEP"


def test_two_spans_join():
    assert len(_decoded("दो=CARD_2 लाख=UNIT_LAKH", "तीन=CARD_3 लाख=UNIT_LAKH", glue=" से ", classes={7: "RANGE", 8: "RANGE"})) == 1
    assert _decoded("das=CARD_10", "bees=CARD_20", "hazaar=UNIT_HAZAAR") == ["das=CARD_10 bees=CARD_20 hazaar=UNIT_HAZAAR"]
    assert len(_decoded("5=DIGITS lakh=UNIT_LAKH", "3=DIGITS crore=UNIT_CRORE")) == 2
    assert len(_decoded("das=CARD_10", "hazaar=UNIT_HAZAAR", glue=", ")) == 2


def test_words_stay_whole():
    assert _decoded("unnasi=CARD_79 hazaar=UNIT_HAZAAR", gaps=(3, 5)) == ["unnasi=CARD_79 hazaar=UNIT_HAZAAR"]
    for fused in ("पावणे=PFX_PAUNE+चार=CARD_4", "બ=CARD_2+સો=UNIT_SAU"):
        assert _decoded(fused) == [fused.replace("+", " ")]


def test_boundaries():
    assert _decoded("das=CARD_10 hazaar=UNIT_HAZAAR 1987=DIGITS") == ["das=CARD_10 hazaar=UNIT_HAZAAR"]


def _tiny(rng, channels=6, embed=4):
    charset = ["<pad>", "<unk>", *"0123456789abcdefghijklmnopqrstuvwxyz ."]
    tensor = lambda *shape: {"shape": list(shape), "data": rng.standard_normal(int(np.prod(shape))).tolist()}
    made = {"version": 2, "charset": charset, "embed": tensor(len(charset), embed), "conv": []}
    width = embed
    for k, d, r in ((5, 1, False), (3, 1, True), (3, 2, True)):
        made["conv"].append({"k": k, "dilation": d, "residual": r, "w": tensor(channels, width, k), "b": tensor(channels)})
        width = channels
    return made | {"bio": {"w": tensor(3, channels), "b": tensor(3)}, "cls": {"w": tensor(120, channels), "b": tensor(120)}}


def _naive(net, text):
    ids = [net.charset.get(c, 1) for c in text] + [0] * weights.PAD_TAIL
    x = [net.embed[i].astype(np.float64) for i in ids]
    for k, d, r, w, b in net.conv:
        out = []
        for t in range(len(x)):
            y = b.astype(np.float64).copy()
            for i in range(k):
                at = t + i * d - d * (k - 1) // 2
                if 0 <= at < len(x):
                    y += w[:, :, i] @ x[at]
            out.append(np.maximum(y, 0) + (x[t] if r else 0))
        x = out
    return [np.stack([h @ v + b for v in x]) for h, b in net.heads]


def test_network_against_loops():
    net = weights.Network(_tiny(np.random.default_rng(3)))
    for got, want in zip(net.logits(["5 lakh"]), _naive(net, "5 lakh")):
        np.testing.assert_allclose(got[0], want, rtol=2e-3, atol=2e-3)
    again = weights.Network(net.save())
    np.testing.assert_allclose(again.embed, net.embed, rtol=1e-4)
    small = weights.Network(net.save(int8=True))
    assert np.abs(small.embed - net.embed).max() <= np.abs(net.embed).max() / 127


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    s, trans, start, end = (rng.standard_normal(x).astype(np.float32) for x in ((5, 3), (3, 3), 3, 3))
    score = lambda p: start[p[0]] + end[p[-1]] + sum(s[i, x] for i, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
    assert tuple(weights.viterbi(s, trans, start, end)) == max(product(range(3), repeat=5), key=score)


@pytest.mark.parametrize("n, starts", [(0, [0]), (128, [0]), (129, [0, 112]), (240, [0, 112]), (241, [0, 112, 224])])
def test_windows(n, starts):
    assert weights.window_starts(n) == starts


def test_weights_tagger_runs(spark):
    tagger = weights.weights_tagger(spark, _tiny(np.random.default_rng(5)))
    rows = parse_df(spark.createDataFrame([("5 lakh " * 40,), (None,), ("",)], "text string"), tagger=tagger).collect()
    assert len(rows) == 3 and weights.parameters("v2", 170) == 40475 and len(CLASSES) == 120
