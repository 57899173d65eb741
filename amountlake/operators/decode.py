"""From per-character tags to spans of tokens.

Tags are repaired by what characters show on their own: digit runs are digits, words belong together, a blank
between a range's halves is its connector.  Tokens are ``(class, text, start, end)``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexicon import RANGE_SIGNS, UNITS, lexicon

Token = tuple[str, str, int, int]
KINDS = ("PFX_", "CARD_", "UNIT_")
LONGEST_WORD = 24


def kind(ch: str) -> str:
    if ch in "0123456789":
        return "digit"
    if ch.isspace():
        return "space"
    return "letter" if ch.isalpha() or "̀" <= ch <= "ͯ" or "ऀ" <= ch <= "ॣ" or "઀" <= ch <= "ૣ" or ch in "‌‍" else "other"


class _Kinds(dict):
    """First letters of kinds by code point, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        self[code] = kind(chr(code))[0]
        return self[code]


_KINDS, _NAMES, _SAME = _Kinds(), {k[0]: k for k in ("digit", "space", "letter", "other")}, re.compile("d+|s+|l+|o+")


def runs(text: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    kinds = text[start:end].translate(_KINDS)
    return [(_NAMES[kinds[m.start()]], start + m.start(), start + m.end()) for m in _SAME.finditer(kinds)]


def _word(cls: str) -> bool:
    return cls.startswith(KINDS)


def _solid(cls: str) -> bool:
    return cls == "DIGITS" or _word(cls)


def _stretches(classes: list[str]) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for c, group in groupby(classes):
        n = len(list(group))
        out.append((c, at, at + n))
        at += n
    return out


def _fused(parts: list[tuple[str, int, int]], word: str) -> bool:
    """Prefix, cardinal and unit in that order, each on evidence of its own: a word written as one."""
    if len(parts) not in (2, 3) or not all(_word(c) for c, _, _ in parts):
        return False
    rank = [next(i for i, k in enumerate(KINDS) if c.startswith(k)) for c, _, _ in parts]
    if any(a >= b for a, b in zip(rank, rank[1:])):
        return False
    bound = lexicon().bound
    for (c, a, b), after in zip(parts, [*parts[1:], None]):
        if b - a < 2 and not (after and word[after[1] : after[2]] in bound.get((word[a:b], c), ())):
            return False
    return True


def _adopt(parts: list[tuple[str, int, int]], i: int) -> str | None:
    """The class of the longer neighbour of at least three characters, the left one on a tie."""
    near = [parts[j] for j in (i - 1, i + 1) if 0 <= j < len(parts) and parts[j][2] - parts[j][1] >= 3]
    return max(near, key=lambda p: p[2] - p[1])[0] if near else None


def smooth(classes: list[str], word: str) -> list[str]:
    """One class per stretch of a word that has evidence; short stretches take a neighbour's, else the word's vote."""
    parts = _stretches(classes)
    if _fused(parts, word):
        return classes
    out, vote = list(classes), None
    for i, (c, a, b) in enumerate(parts):
        if b - a < 3:
            new = _adopt(parts, i)
            if new is None:
                vote = vote or _vote(classes)
                new = vote
            out[a:b] = [new] * (b - a)
    return out


def _vote(classes: list[str]) -> str:
    count = Counter(c for c in classes if _word(c) or c in ("RANGE", "DIGITS"))
    if not count:
        return "O"
    top = max(count.values())
    best = [c for c in count if count[c] == top]
    return max(best, key=lambda c: max(b - a for x, a, b in _stretches(classes) if x == c))


def _agreed(classes: list[str], word: str) -> str | None:
    """The one class that every stretch of the word has by itself or from a neighbour."""
    parts = _stretches(classes)
    keep = _fused(parts, word)
    found = {c if keep or b - a >= 3 else _adopt(parts, i) for i, (c, a, b) in enumerate(parts)}
    return found.pop() if len(found) == 1 else None


def repair_bio(text: str, bio: list[int], classes: list[str], pieces: list[tuple[str, int, int]] | None = None) -> list[int]:
    """Bridge single gaps, let spans swallow the rest of digit runs and of words their characters agree on."""
    bio = list(bio)
    for i in range(1, len(bio) - 1):
        if bio[i] == 0 and bio[i - 1] and bio[i + 1] == 2:
            bio[i] = 2
    for k, a, b in runs(text) if pieces is None else pieces:
        if k == "digit":
            for i in range(a + 1, b):
                if bio[i] == 0 and bio[i - 1]:
                    bio[i] = 2
        elif k == "letter" and b - a <= LONGEST_WORD and any(bio[a:b]) and not all(bio[a:b]):
            cls = _agreed(classes[a:b], text[a:b])
            if cls and _word(cls):
                bio[a:b] = [1] + [2] * (b - a - 1)
    return bio


def repair_classes(text: str, start: int, end: int, classes: list[str]) -> list[str]:
    """Classes of a span's characters by what they are."""
    pieces = runs(text, start, end)
    out = list(classes[start:end])

    def seen(i: int, step: int) -> str | None:
        j = i + step
        if 0 <= j < len(pieces) and pieces[j][0] == "space":
            j += step
        if not 0 <= j < len(pieces):
            return None
        k, a, b = pieces[j]
        if k == "letter":
            return Counter(smooth(classes[a:b], text[a:b])).most_common(1)[0][0]
        return "DIGITS" if k == "digit" else None

    for i, (k, a, b) in enumerate(pieces):
        mark = text[a:b]
        if k == "digit":
            new = ["DIGITS"] * (b - a)
        elif k == "letter":
            new = smooth(classes[a:b], mark)
        elif k == "space":
            new = ["RANGE" if "RANGE" in classes[a:b] else "SEP"] * (b - a)
        elif mark in (".", ",") and 0 < i < len(pieces) - 1 and pieces[i - 1][0] == pieces[i + 1][0] == "digit":
            new = [{".": "DOT", ",": "COMMA"}[mark]]
        else:
            left, right = seen(i, -1), seen(i, 1)
            ranged = mark in RANGE_SIGNS and left and right and _solid(left) and right.startswith(("DIGITS", "CARD_", "PFX_"))
            new = ["RANGE" if ranged else "SEP"] * (b - a)
        out[a - start : b - start] = new
    return out


def _tokens(text: str, start: int, classes: list[str]) -> list[Token]:
    out: list[Token] = []
    for c, a, b in _stretches(classes):
        for k, x, y in runs(text, start + a, start + b) if c not in ("SEP", "RANGE", "O") else [("", start + a, start + b)]:
            if out and out[-1][0] == c and c != "DIGITS" and k == "":
                continue
            out.append((c, text[x:y], x, y))
    return out


_POSSESSIVE = re.compile(r"['’][a-zऀ-ॿ]{1,2}")


def _whole_words(text: str, tokens: list[Token], starts: list[int], ends: list[int]) -> list[Token]:
    """Word tokens that leave part of their word outside become O, as do a lone k or l before more letters and possessive endings.

    ``starts`` and ``ends`` are of the text's words; a word token lies within one word.
    """
    covered: Counter[int] = Counter()
    own = {}
    for c, _, a, b in tokens:
        if _word(c):
            i = bisect_right(starts, a) - 1
            own[a] = i if i >= 0 and a < ends[i] else -1
            covered[own[a]] += b - a
    out = []
    for c, t, a, b in tokens:
        if _word(c):
            i = own[a]
            if i < 0 or covered[i] < ends[i] - starts[i] or (len(t) == 1 and t in "kl" and b < len(text) and kind(text[b]) == "letter"):
                c = "O"
        if text[max(0, a - 1)] in "'’" and _POSSESSIVE.fullmatch(text, max(0, a - 1), b) and (b == len(text) or kind(text[b]) != "letter"):
            c = "O"
        out.append((c, t, a, b))
    return out


def _edges(tokens: list[Token]) -> list[Token]:
    solid = [i for i, t in enumerate(tokens) if _solid(t[0])]
    return tokens[solid[0] : solid[-1] + 1] if solid else []


def _value(t: Token) -> int | None:
    return int(t[1]) if t[0] == "DIGITS" and t[1].isdigit() else int(t[0][5:]) if t[0].startswith("CARD_") else None


def trim_boundaries(tokens: list[Token]) -> list[Token]:
    """Without a year behind a unit, or digits that the next spelled number repeats."""
    solid = [t for t in tokens if _solid(t[0])]
    if len(solid) > 1 and solid[-1][0] == "DIGITS" and re.fullmatch(r"(19|20)\d\d", solid[-1][1]) and solid[-2][0] in UNITS:
        tokens = tokens[: tokens.index(solid[-1])]
    if len(solid) > 1 and solid[0][0] == "DIGITS" and solid[1][0].startswith("CARD_") and _value(solid[0]) == _value(solid[1]):
        tokens = tokens[tokens.index(solid[1]) :]
    return _edges(tokens)


def merge_spans(text: str, spans: list[tuple[list[Token], float]], classes: list[str]) -> list[tuple[list[Token], float]]:
    """Join halves of a range around a connecting word, then an amount that was cut at a blank."""
    out: list[tuple[list[Token], float]] = []
    for tokens, score in spans:
        if out:
            a, b = out[-1][0][-1][3], tokens[0][2]
            gap = [p for p in runs(text, a, b) if p[0] != "space"]
            if len(gap) == 1 and gap[0][0] == "letter" and Counter(classes[gap[0][1] : gap[0][2]]).most_common(1)[0][0] == "RANGE":
                out[-1] = ([*out[-1][0], ("RANGE", text[a:b], a, b), *tokens], (out[-1][1] + score) / 2)
                continue
        out.append((tokens, score))
    merged: list[tuple[list[Token], float]] = []
    for tokens, score in out:
        if merged:
            left, right = merged[-1][0][-1], tokens[0]
            open_end = left[0].startswith(("CARD_", "PFX_", "DIGITS")) and right[0].startswith(("UNIT_", "CARD_"))
            restated = left[0] == "DIGITS" and right[0].startswith("CARD_") and _value(left) == _value(right)
            if right[2] - left[3] == 1 and text[left[3]].isspace() and open_end and not restated:
                merged[-1] = ([*merged[-1][0], ("SEP", text[left[3]], left[3], right[2]), *tokens], (merged[-1][1] + score) / 2)
                continue
        merged.append((tokens, score))
    return merged


def decode(text: str, bio: list[int], classes: list[str], sure: list[float] | None = None, least: float = 0.5) -> list[tuple[list[Token], float]]:
    """(tokens, confidence) of each span; confidence is the mean of the largest probability of each character."""
    sure = sure or [1.0] * len(text)
    pieces = runs(text)
    words = [(a, b) for k, a, b in pieces if k == "letter"]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    bio = repair_bio(text, bio, classes, pieces)
    found, at = [], 0
    while at < len(bio):
        if bio[at] != 1:
            at += 1
            continue
        end = at + 1
        while end < len(bio) and bio[end] == 2:
            end += 1
        tokens = _edges(_whole_words(text, _tokens(text, at, repair_classes(text, at, end, classes)), starts, ends))
        score = sum(sure[at:end]) / (end - at)
        if tokens and score >= least:
            found.append((tokens, score))
        at = end
    trimmed = ((trim_boundaries(t), s) for t, s in merge_spans(text, found, classes))
    return [(t, s) for t, s in trimmed if t]


DECODED = "array<struct<start:int,end:int,text:string,classes:array<string>>>"


SHORT = 64


def _spans(text: str, bio: list[int], classes: list[str]) -> list[dict]:
    found = decode(text, bio, classes)
    return [{"start": w[0][2], "end": w[-1][3], "text": text[w[0][2] : w[-1][3]], "classes": [x[0] for x in w if x[0] != "SEP"]} for w, _ in found]


@lru_cache(maxsize=1 << 13)  # short texts repeat in columns; results don't depend on it
def _short(text: str, bio: tuple[int, ...], classes: str) -> list[dict]:
    return _spans(text, list(bio), classes.split("\n"))


def _decoded(text: pd.Series, bio: pd.Series, classes: pd.Series) -> pd.Series:
    def one(t: str | None, b, c) -> list[dict]:
        if t is None or b is None or c is None or not len(t) == len(b) == len(c):
            return []
        b, c = [int(x) for x in b], list(c)
        if 0 < len(t) <= SHORT and None not in c and (line := "\n".join(c)).count("\n") == len(c) - 1:
            return _short(t, tuple(b), line)
        return _spans(t, b, c)

    return pd.Series([one(*row) for row in zip(text, bio, classes)])


def decode_tags(text: Column, bio: Column, classes: Column) -> Column:
    """Spans of a text from a tag (0 outside, 1 begins, 2 goes on) and a class of each character.

    Null, or arrays that are not as long as the text: no span.
    """
    return F.pandas_udf(_decoded, DECODED)(text, bio, classes)
