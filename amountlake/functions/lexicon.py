"""The number lexicon of four language packs, as plain relations.

Spellings of the romanised pack derive in part from the Dakshina dataset (CC BY-SA 4.0).
"""

from __future__ import annotations

import pkgutil
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKS = tuple("hi_latn hi_deva mr_deva gu_gujr".split())
ALIASES = dict(zip(("", "latn", "deva", "mr", "gu"), (PACKS[0], *PACKS)))

#: unit class -> (value, name in results)
UNITS = {
    "UNIT_SAU": (1e2, "sau"),
    "UNIT_HAZAAR": (1e3, "hazaar"),
    "UNIT_LAKH": (1e5, "lakh"),
    "UNIT_MILLION": (1e6, "million"),
    "UNIT_CRORE": (1e7, "crore"),
    "UNIT_BILLION": (1e9, "billion"),
    "UNIT_ARAB": (1e9, "arab"),
    "UNIT_KHARAB": (1e11, "kharab"),
}
#: prefix class -> (value alone, what it adds to a number beside it; None: the number is lost)
PREFIXES = {
    "PFX_PAAV": (0.25, None),
    "PFX_AADHA": (0.5, None),
    "PFX_PAUNE": (0.75, -0.25),
    "PFX_SAVA": (1.25, 0.25),
    "PFX_DEDH": (1.5, None),
    "PFX_DHAI": (2.5, None),
    "PFX_SAADHE": (0.5, 0.5),
}
CLASSES = (*"O SEP RANGE DIGITS DOT COMMA".split(), *PREFIXES, *(f"CARD_{n}" for n in range(1, 100)), *UNITS)
RANGE_SIGNS = frozenset("-–—/")
_DIGITS = {ord(c): str(i) for base in (0x0966, 0x0AE6) for i, c in enumerate(map(chr, range(base, base + 10)))}
_NATIVE = re.compile("[०-९૦-૯]")


def normalize(text: str) -> str:
    """NFC, native digits to ASCII, lower case."""
    text = unicodedata.normalize("NFC", text)
    return (text.translate(_DIGITS) if _NATIVE.search(text) else text).lower()


def key(surface: str) -> str:
    return unicodedata.normalize("NFC", surface).lower()


def within_one(a: str, b: str) -> bool:
    """Edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] or a == b


class Lexicon:
    """Rows (kind, class, pack, surfaces) and the lookups made from them."""

    def __init__(self, path: Path | None = None) -> None:
        text = path.read_text(encoding="utf-8") if path else pkgutil.get_data(__name__, "lexicon.tsv").decode()  # also from an archive
        lines = text.splitlines()
        self.rows = [(k, c, p, s.split("|")) for k, c, p, s in (line.split("\t") for line in lines if line)]
        self.forms: dict[str, set[str]] = defaultdict(set)
        self.by_pack: dict[str, dict[str, str]] = {p: {} for p in PACKS}
        self.lists: dict[tuple[str, str], list[str]] = defaultdict(list)
        self.bound: dict[tuple[str, str], set[str]] = {}
        for kind, cls, pack, surfaces in self.rows:
            if kind == "form":
                for s in surfaces:
                    self.forms[key(s)].add(cls)
                    self.by_pack[pack][key(s)] = cls
            elif kind == "bound":
                self.bound[key(surfaces[0]), cls] = {key(s) for s in surfaces[1:]}
            elif kind != "symbol":
                self.lists[kind, pack] += map(key, surfaces)
        every = lambda kind: {s for p in PACKS for s in self.lists[kind, p]}
        self.range_words, self.ambiguous, self.blocked = every("range"), every("ambiguous"), every("blocked")
        self.before, self.after = every("before"), every("after")
        self.symbols = {s: cls for kind, cls, _, surfaces in self.rows if kind == "symbol" for s in surfaces}
        self.by_class: dict[str, list[str]] = defaultdict(list)
        for s, classes in self.forms.items():
            for c in classes:
                self.by_class[c].append(s)
        self.phrases = sorted((s for s in self.forms if " " in s), key=len, reverse=True)
        by = lambda p, *kinds: tuple(s for s, c in self.by_pack[p].items() if c.startswith(kinds))
        self.fused = {p: by(p, *(x.upper() for x in self.lists["fused", p])) if self.lists["fused", p] else () for p in PACKS}
        self.prefixed = {p: tuple(s for s in by(p, "PFX_") if len(s) > 2) for p in PACKS}
        self.units = {p: tuple(s for s in by(p, "UNIT_") if len(s) > 2) for p in PACKS}
        self.glued = {p: tuple(self.lists["glue", p]) for p in PACKS}
        self.glued_only = {s for p in PACKS for s in self.lists["glue", p]} - {s for p in PACKS for s in self.lists["free", p]}
        self.endings = {p: tuple(self.lists["suffix", p]) for p in PACKS}
        self._endings = {p: sorted(self.lists["suffix", p], key=lambda s: (-len(s), s)) for p in PACKS}

    def heads(self, word: str, pack: str) -> list[str]:
        """What is left of a word without one case ending of a pack, and under it one oblique ending."""
        out = []
        for ending in self._endings[pack]:
            if word.endswith(ending) and len(word) > len(ending):
                stem = word[: -len(ending)]
                out.append(stem)
                out += [stem[: -len(o)] for o in self.lists["oblique", pack] if stem.endswith(o) and len(stem) > len(o)]
        return out

    def inflected(self, word: str, cls: str) -> bool:
        if word in self.forms or word in self.blocked:
            return False
        return any(self.by_pack[p].get(h) == cls for p in PACKS for h in self.heads(word, p) if len(h) >= 3)

    def known(self, cls: str, surface: str) -> bool:
        s = key(surface)
        return s not in self.blocked and (cls in self.forms.get(s, ()) or self.inflected(s, cls))

    def near(self, cls: str, surface: str) -> bool:
        s = key(surface)
        return self.known(cls, s) or (s not in self.blocked and any(within_one(s, f) for f in self.by_class[cls]))

    def justified(self, cls: str, text: str, following: str | None) -> bool:
        """Whether the lexicon or a structural rule explains a token."""
        if cls == "SEP":
            return bool(text) and not text.strip()
        if cls in ("DOT", "COMMA"):
            return text == {"DOT": ".", "COMMA": ","}[cls]
        if cls == "RANGE":
            return text.strip() in RANGE_SIGNS or key(text.strip()) in self.range_words
        if cls == "DIGITS":
            return bool(text) and all(c in "0123456789" or ord(c) in _DIGITS for c in text)
        s = key(text)
        if cls == "O":
            return "O" in self.forms.get(s, ())
        return self.known(cls, s) or (s not in self.blocked and following is not None and key(following) in self.bound.get((s, cls), ()))

    def flags(self, cls: str, text: str, following: str | None) -> dict:
        """All that gates and verification ask of a token."""
        s = key(text)
        return {
            "cls": cls,
            "text": text,
            "justified": self.justified(cls, text, following),
            "known": cls not in ("SEP", "RANGE", "DOT", "COMMA", "O") and (cls == "DIGITS" or self.known(cls, s)),
            "exact": cls in self.forms.get(s, ()),
            "near": not cls.startswith("UNIT_") or self.near(cls, s),
            "ambiguous": s in self.ambiguous,
            "blocked": s in self.blocked,
            "ordinary": self.forms.get(s) == {"O"},
        }


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


def resolve_pack(name: str) -> str:
    """Pack by id, alias, or unique prefix or suffix; else the first."""
    if name in PACKS:
        return name
    if name in ALIASES:
        return ALIASES[name]
    found = [p for p in PACKS if p.startswith(name) or p.endswith(name)]
    return found[0] if len(found) == 1 else PACKS[0]


def relation(spark: SparkSession, kind: str = "form") -> DataFrame:
    """pack, class, surface of one kind of row: form, range, suffix, oblique, ambiguous, blocked, bound, glue, symbol, before, after."""
    rows = [(p, c, s) for k, c, p, surfaces in lexicon().rows if k == kind for s in surfaces]
    return spark.createDataFrame(rows, "pack string, class string, surface string")


def currency_patterns() -> tuple[str, str]:
    """Regexes for a marker that ends what is before a span, and a word that starts what is after it."""
    lex = lexicon()
    before = {m.rstrip(".") for m in lex.before} | set(lex.before)
    alternatives = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"(?:{alternatives(before)})\s*$", rf"^\s*(?:{alternatives(lex.after)})"
