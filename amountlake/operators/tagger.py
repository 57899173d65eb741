"""Span proposal by the lexicon.

A text is cut into runs (digits, letters, blanks, marks); letter runs are looked up, with glued
units, fused prefixes, bound number forms and case endings taken apart; runs that carry numbers, joined by
single blanks, connectors and points, make a span.  Words are resolved once per worker and remembered.

Confidence is a heuristic of ours, a mean over tokens: 1 for exact forms and structure, 0.9 for forms
explained by an ending or by gluing, 0.7 for a unit one edit away.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fold import evaluate, gate, verified
from ..functions.gates import TOKEN
from ..functions.lexicon import PACKS, PREFIXES, RANGE_SIGNS, UNITS, currency_patterns, key, lexicon, normalize

SPAN = (
    "struct<start:int,end:int,text:string,raw_confidence:double,value:double,low:double,high:double,unit:string,currency:string,gate:string,verified:boolean,"
    f"tokens:array<{TOKEN}>>"
)
_RUN = re.compile(r"[0-9]+|(?:[^\W\d_][̀-ͯऀ-ःऺ-ॏॢॣઁ-ઃ઼-્‌‍]*)+|\s+|.", re.DOTALL)
Token = tuple[str, str, int, int]
#: connectors that join two amounts, not the ends of one range, if the left has a unit
EITHER = frozenset(("ya", "or", "या", "किंवा", "કે"))
#: words before six digits that make them a postal code
POSTAL = frozenset(("pin", "pincode", "पिन", "પિન"))


def is_word(run: str) -> bool:
    return run[0].isalpha() or unicodedata.category(run[0]) in ("Mn", "Mc")


def exact_class(word: str) -> str | None:
    found = lexicon().forms.get(word)
    return min(found) if found else None


def _solid(cls: str) -> bool:
    return cls == "DIGITS" or cls.startswith(("CARD_", "PFX_", "UNIT_"))


@lru_cache(maxsize=1 << 17)
def split_word(word: str, depth: int = 0, packs: tuple[str, ...] = PACKS) -> tuple[tuple[str, str], ...] | None:
    """(class, piece) of one letter run, or None if no pack explains it."""
    lex = lexicon()
    low = key(word)
    if low in lex.glued_only or low in lex.blocked:
        return None
    for pack in packs:
        if low in lex.by_pack[pack]:
            return ((lex.by_pack[pack][low], word),)
    if depth > 3:
        return None
    for pack in packs:
        forms = lex.by_pack[pack]
        for tail in lex.glued[pack]:
            if low.endswith(tail) and len(low) > len(tail):
                head = word[: -len(tail)]
                parts = split_word(head, depth + 1, (pack,))
                if parts is None:
                    bound = [c for (s, c), before in lex.bound.items() if s == key(head) and tail in before]
                    parts = ((bound[0], head),) if bound else None
                if parts and all(c.startswith(("CARD_", "PFX_")) for c, _ in parts):
                    return (*parts, (forms[tail], word[len(head) :]))
        for head in sorted((s for s in lex.fused[pack] if low.startswith(s) and len(s) < len(low)), key=len, reverse=True) if low.startswith(lex.fused[pack]) else ():
            parts = split_word(word[len(head) :], depth + 1, (pack,))
            if parts and parts[0][0].startswith("CARD_"):
                return ((forms[head], word[: len(head)]), *parts)
        for head in sorted((s for s in lex.prefixed[pack] if low.startswith(s)), key=len, reverse=True) if low.startswith(lex.prefixed[pack]) and low.endswith(lex.units[pack]) else ():
            cls = forms.get(low[len(head) :], "")
            if cls.startswith("UNIT_") and len(low) - len(head) > 2:
                return ((forms[head], word[: len(head)]), (cls, word[len(head) :]))
        for stem in lex.heads(low, pack) if low.endswith(lex.endings[pack]) else ():
            parts = split_word(word[: len(stem)], depth + 1, (pack,))
            if not parts or (len(parts) == 1 and len(stem) < 3):
                continue
            if all(c == "O" for c, _ in parts):
                return (("O", word),)
            if all(_solid(c) for c, _ in parts):
                *before, (cls, piece) = parts
                return (*before, (cls, piece + word[len(stem) :]))
    return None


@lru_cache(maxsize=1 << 16)
def _near_unit(word: str) -> str | None:
    if len(word) < 5:
        return None
    lex = lexicon()
    for cls in UNITS:
        if any(f[0] == word[0] and len(f) > 3 and lex.near(cls, word) for f in lex.by_class[cls]):
            return cls
    return None


def tokens_of(text: str) -> list[Token]:
    """Tokens of a normalized text; what is no part of an amount is class O."""
    out: list[Token] = []
    lex = lexicon()
    at = 0
    while at < len(text):
        phrase = next((p for p in lex.phrases if text.startswith(p, at) and not text[at + len(p) : at + len(p) + 1].isalnum() and (at == 0 or not text[at - 1].isalnum())), None) if text[at] in "anh" else None
        run = phrase or _RUN.match(text, at).group()
        end = at + len(run)
        if phrase:
            out.append((exact_class(phrase), run, at, end))
        elif run.isascii() and run.isdigit():
            out.append(("DIGITS", run, at, end))
        elif run.isspace():
            out.append(("SEP", run, at, end))
        elif run in RANGE_SIGNS:
            out.append(("SIGN", run, at, end))
        elif run in (".", ","):
            out.append(({".": "DOT", ",": "COMMA"}[run], run, at, end))
        elif is_word(run):
            parts = split_word(run)
            last = next((t for t in reversed(out) if t[0] != "SEP"), None)
            if parts is None and last and last[0].startswith(("DIGITS", "PFX_", "CARD_")) and last[3] >= at - 1:
                cls = _near_unit(run)
                parts = ((cls, run),) if cls else None
            for cls, piece in parts or (("O", run),):
                out.append((cls, piece, at, at + len(piece)))
                at += len(piece)
        else:
            out.append(("O", run, at, end))
        at = end
    return out


def _number(t: Token) -> float | None:
    if t[0].startswith("CARD_"):
        return float(t[0][5:])
    if t[0] in PREFIXES and PREFIXES[t[0]][1] is None:
        return PREFIXES[t[0]][0]
    return None


def _joins(left: list[Token], gap: list[Token], right: Token) -> str | None:
    """Class of the gap if both sides are one span, else None."""
    lex = lexicon()
    kinds = "".join({"SEP": "s", "SIGN": "r", "DOT": ".", "COMMA": ",", "O": "o"}.get(t[0], "w") for t in gap)
    a, b = left[-1], right
    if not gap:
        return "GLUE"
    if kinds in (".", ",") and a[0] == b[0] == "DIGITS":
        return "POINT"
    if kinds == "s" and len(gap[0][1]) == 1:
        if a[0] == b[0] == "DIGITS":
            return None
        if b[0] == "DIGITS":
            return "SEP" if a[0].startswith(("UNIT_", "PFX_")) and not (a[0].startswith("UNIT_") and len(b[1]) >= 5) else None
        x, y = _number(a), _number(b)
        if x is not None and y is not None and a[0].startswith("PFX_") and b[0].startswith("CARD_") and x < y:
            return "RANGE"
        return "SEP"
    number = b[0].startswith(("DIGITS", "CARD_", "PFX_"))
    if kinds.strip("s") == "r" and number:
        return "RANGE"
    if kinds.strip("s") == "r" and b[0].startswith("UNIT_") and "s" not in kinds:
        return "SEP"
    words = [t for t in gap if t[0] != "SEP"]
    if number and len(words) == 1 and kinds == "sos" and words[0][1] in lex.range_words:
        either = words[0][1] in EITHER and any(t[0].startswith("UNIT_") for t in left)
        return None if either else "RANGE"
    return None


def spans_of(text: str) -> list[list[Token]]:
    """Token lists of the proposed spans, gaps between numbers as SEP, RANGE, DOT or COMMA."""
    tokens = tokens_of(text)
    solid = [i for i, t in enumerate(tokens) if _solid(t[0])]
    spans: list[list[Token]] = []
    for n, i in enumerate(solid):
        if n and spans:
            gap = tokens[solid[n - 1] + 1 : i]
            how = _joins(spans[-1], gap, tokens[i])
            ranged = any(t[0] == "RANGE" for t in spans[-1])
            if how and not (how == "RANGE" and ranged):
                if how == "RANGE":
                    spans[-1].append(("RANGE", text[gap[0][2] : gap[-1][3]], gap[0][2], gap[-1][3]))
                else:
                    spans[-1] += [("SEP" if how == "SEP" else t[0], *t[1:]) for t in gap]
                spans[-1].append(tokens[i])
                continue
        spans.append([tokens[i]])
    return [s for s in map(_trim, spans) if s]


def _trim(span: list[Token]) -> list[Token]:
    """Without a year behind a unit, or digits that only restate the number after them."""
    solid = [t for t in span if _solid(t[0])]
    if len(solid) > 1 and solid[-1][0] == "DIGITS" and solid[-2][0].startswith("UNIT_") and re.fullmatch(r"(19|20)\d\d", solid[-1][1]):
        span = span[: span.index(solid[-1])]
    elif len(solid) > 1 and solid[0][0] == "DIGITS" and solid[1][0].startswith("CARD_") and int(solid[0][1][:9]) == int(solid[1][0][5:]):
        span = span[span.index(solid[1]) :]
    while span and not _solid(span[-1][0]):
        span = span[:-1]
    return span


def _counted(span: list[Token], text: str) -> bool:
    """Our own rule for what a learned tagger takes from context: small spelled numbers without unit or
    currency count things, split digit runs are phone numbers, six digits behind a postal word are a code."""
    a, b = span[0][2], span[-1][3]
    solid = [t for t in span if _solid(t[0])]
    left, right = _markers()
    marked = bool(left.search(text[max(0, a - 8) : a]) or right.match(text[b : b + 8]))
    if not any(t[0].startswith(("UNIT_", "DIGITS")) for t in solid):
        small = sum(float(t[0][5:]) for t in solid if t[0].startswith("CARD_")) < 20
        return small and not marked and bool(text[max(0, a - REACH) : a].strip() or text[b : b + REACH].strip())
    if all(t[0] == "DIGITS" for t in solid) and not marked:
        split = re.search(r"\d{4,} $", text[max(0, a - REACH) : a]) or re.match(r" \d{4,}", text[b : b + REACH])
        postal = len(solid) == 1 and b - a == 6 and POSTAL.intersection(re.findall(r"\w[\w\u0900-\u0aff]*", text[max(0, a - 16) : a]))
        return bool(split or postal)
    return False


@lru_cache(maxsize=1)
def _markers() -> tuple[re.Pattern, re.Pattern]:
    return tuple(re.compile(p) for p in currency_patterns())


def _score(token: dict) -> float:
    return 1.0 if token["exact"] or not _solid(token["cls"]) or token["cls"] == "DIGITS" else 0.9 if token["justified"] else 0.7


@lru_cache(maxsize=1 << 16)
def _flags_of(cls: str, text: str, following: str | None) -> dict:
    return lexicon().flags(cls, text, following)


def annotate(span: list[Token]) -> list[dict]:
    following = [t[1] for t in span[1:]] + [None]
    return [_flags_of(cls, text, after) | {"start": a, "end": b} for (cls, text, a, b), after in zip(span, following)]


REACH = 64
#: so many words without a number part amounts
APART = 6


@lru_cache(maxsize=1 << 17)
def _role(run: str) -> str:
    """``number`` for digits and words that may count, ``word`` for other words, else nothing."""
    word = is_word(run)
    if run[0].isdigit():
        return "number"
    parts = split_word(run) if word else None
    return "number" if word and (run == "quarter" or parts and any(_solid(c) for c, _ in parts)) else "word" if word else ""


#: digits, words, and what outside ASCII may stand for either; captured, so that a split keeps them
_TOLD = re.compile(r"([0-9]+|(?:[^\W\d_][̀-ͯऀ-ःऺ-ॏॢॣઁ-ઃ઼-્‌‍]*)+|[^\x00-\x7f\s])")


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts around digits and number words, cut where ``APART`` words in a row count nothing: no amount reaches over them.

    Blanks and marks between words don't matter, however many there are. Words are told apart once for each distinct one of a text.
    """
    parts = _TOLD.split(text)
    words = parts[1::2]
    roles = {w: _role(w) for w in set(words)}
    number = {w for w, role in roles.items() if role == "number"}
    if not number:
        return []
    ends = list(accumulate(map(len, parts)))  # of gap, word, gap, ...
    plain = [i for i, w in enumerate(words) if roles[w] == "word"]
    out: list[list[int]] = []
    last = 0  # plain words before the last number
    for n in (bisect_left(plain, i) for i, w in enumerate(words) if w in number):
        if not out or n >= last + APART:
            if out:
                out[-1][1] = ends[2 * plain[last + APART - 1] + 1]
            start = ends[2 * plain[n - APART]] if n >= APART else 0
            if out and start <= out[-1][1]:
                out[-1][1] = len(text)
            else:
                out.append([start, len(text)])
        last = n
    if last + APART <= len(plain):
        out[-1][1] = ends[2 * plain[last + APART - 1] + 1]
    for part in out:
        while part[0] > 0 and not text[part[0] - 1].isspace():
            part[0] -= 1
        while part[1] < len(text) and not text[part[1]].isspace():
            part[1] += 1
    joined: list[tuple[int, int]] = []
    for a, b in out:
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined


def propose(text: str | None) -> list[dict]:
    if not text:
        return []
    out = []
    for a, b in _stretches(text):
        for span in spans_of(text[a:b]):
            span = [(c, t, x + a, y + a) for c, t, x, y in span]
            if not _counted(span, text):
                out.append(finish(span, text))
    return out


def amounts(text: str | None) -> list[dict]:
    """The spans of a text as it is written that no gate drops, as amounts; confidence is the raw one."""
    return _kept(text) if text is not None and len(text) <= 64 else _amounts(text)


def _amounts(text: str | None) -> list[dict]:
    if not text:
        return []
    normal = normalize(text)
    out = []
    for s in propose(normal):
        if s["gate"] is None:
            tokens = [{"cls": t["cls"], "text": t["text"]} for t in s["tokens"]]
            out.append(
                {
                    "span": text[s["start"] : s["end"]] if len(text) == len(normal) else s["text"], "start": s["start"], "end": s["end"], "value": s["value"], "range_low": s["low"], "range_high": s["high"],
                    "unit": s["unit"], "currency": s["currency"], "confidence": s["raw_confidence"], "raw_confidence": s["raw_confidence"], "verified": s["verified"],
                    "classes": [t["cls"] for t in tokens if t["cls"] != "SEP"], "tokens": tokens,
                }
            )
    return out


_kept = lru_cache(maxsize=1 << 15)(_amounts)  # short texts repeat in columns; results don't depend on it


def finish(span: list[Token], text: str) -> dict:
    """A span with its value, gate, currency and verification."""
    tokens = annotate(span)
    a, b = span[0][2], span[-1][3]
    left, right = _markers()
    marked = bool(left.search(text[max(0, a - 8) : a]) or right.match(text[b : b + 8]))
    value, low, high, unit = evaluate([t[:2] for t in span])
    return {
        "start": a,
        "end": b,
        "text": text[a:b],
        "raw_confidence": sum(map(_score, tokens)) / len(tokens),
        "value": value,
        "low": low,
        "high": high,
        "unit": unit,
        "currency": "INR" if marked else None,
        "gate": gate(tokens, marked),
        "verified": verified(tokens),
        "tokens": tokens,
    }


def _propose(text: pd.Series) -> pd.Series:
    return text.map(propose)


def _flags(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda row: [] if row is None else annotate([(t["cls"], t["text"], -1, -1) for t in row]))


def proposer():
    """The tagger as a UDF."""
    return F.pandas_udf(_propose, f"array<{SPAN}>")


def propose_spans(text: Column) -> Column:
    """array of spans of a normalized text; no span for null."""
    return F.when(text.isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(proposer()(text))


def with_flags(tokens: Column) -> Column:
    """Lexicon flags on an array<struct<cls, text>>."""
    return F.pandas_udf(_flags, f"array<{TOKEN}>")(tokens)


