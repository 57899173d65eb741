"""Synthetic labelled lines: phrases built from weighted structures, put into templates; each row from its own seed.

``spark.range(n)`` gives the rows, a hash of seed and row number the choices, so any row can be made again anywhere.
Labels come from the tokens the phrase was built of, never from parsing.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import evaluate
from ..functions.lexicon import PACKS, PREFIXES, UNITS, lexicon, normalize
from ..functions.normalize import SCRIPT_DIGITS
from ..runtime import ship

STRUCTURES = {
    "prefix_unit": 20, "prefix_num_unit": 12, "card_unit": 15, "digits_word_unit": 15, "digits_symbol": 15, "digits_currency": 8, "chain": 7, "english_fraction": 4,
    "bare_card_currency": 4, "mult_chain": 5, "bare_unit_currency": 3, "unit_chain": 2, "chain_trailing_bare": 6,
}
FAMILIES = {"casual": 16, "classifieds": 16, "news": 13, "salary": 9, "ranges": 8, "two_spans": 10, "bare": 12, "short": 8, "negatives": 12, "conj": 7}
TEMPLATES = {
    "hi_latn": {"plain": ["yeh gaadi {P} mein mili thi", "unka kharcha {P} se upar gaya", "dukaan ka bhaada {P}", "{P} wapas karna hai mujhe"], "two": ["pehle {P} aur baad mein {P} diye", "{P} nahi balki {P} lagenge"], "none": ["aaj mausam accha hai", "woh kal gaon jaayega", "train der se aayi"]},
    "hi_deva": {"plain": ["यह गाड़ी {P} में मिली थी", "उनका खर्चा {P} निकला", "{P} वापस करना है मुझे"], "two": ["पहले {P} फिर बाद में {P} दिए"], "none": ["आज मौसम अच्छा है", "वह कल गाँव जाएगा"]},
    "mr_deva": {"plain": ["ही गाडी {P} मिळाली होती", "त्यांचा खर्च {P} झाला"], "two": ["काल {P} मग नंतर {P} दिले"], "none": ["आज हवा छान आहे", "तो उद्या गावी जाईल"]},
    "gu_gujr": {"plain": ["આ ગાડી {P} મળી હતી", "એમનો ખર્ચ {P} થયો"], "two": ["પહેલાં {P} પછી {P} આપ્યા"], "none": ["આજે હવામાન સારું છે", "તે કાલે ગામ જશે"]},
}
RANGE_WORD = {"hi_latn": "se", "hi_deva": "से", "mr_deva": "ते", "gu_gujr": "થી"}
MONEY = {"hi_latn": "rupaye", "hi_deva": "रुपये", "mr_deva": "रुपये", "gu_gujr": "રૂપિયા"}
BIG = ("UNIT_HAZAAR", "UNIT_LAKH", "UNIT_CRORE")
Token = tuple[str, str]


class Maker:
    """Phrases of one pack from one random source."""

    def __init__(self, pack: str, rng: random.Random) -> None:
        self.pack, self.rng, self.lex = pack, rng, lexicon()

    def form(self, cls: str) -> Token:
        glued = set(self.lex.lists["glue", self.pack]) - set(self.lex.lists["free", self.pack])
        found = sorted(s for s, c in self.lex.by_pack[self.pack].items() if c == cls and s not in glued and s not in self.lex.ambiguous and (" " not in s) and not (s.isascii() and len(s) < 4 and cls in UNITS))
        return cls, self.rng.choice(found) if found else f"{cls}"

    def has(self, cls: str) -> bool:
        return self.form(cls)[1] != cls

    def card(self, a: int = 1, b: int = 99) -> Token:
        while True:
            token = self.form(f"CARD_{self.rng.randint(a, b)}")
            if token[1] != token[0] and token[1] not in self.lex.ambiguous and not token[1].isdigit():
                return token

    def unit(self, among: tuple[str, ...] = BIG) -> Token:
        return self.form(self.rng.choice(among))

    def prefix(self, numbered: bool) -> Token:
        return self.form(self.rng.choice([p for p, (_, adds) in PREFIXES.items() if (adds is not None) == numbered and self.has(p)]))

    def digits(self, a: int, b: int) -> Token:
        return "DIGITS", str(self.rng.randint(a, b))

    def phrase(self, structure: str | None = None) -> tuple[list[Token], bool]:
        """Tokens and whether a currency word must follow."""
        s = structure or self.rng.choices(list(STRUCTURES), list(STRUCTURES.values()))[0]
        blank = ("SEP", " ")
        if s == "prefix_unit":
            return [self.prefix(False), blank, self.unit()], False
        if s in ("prefix_num_unit", "english_fraction"):
            return [self.form("PFX_SAADHE"), blank, self.card(3, 90), blank, self.unit()], False
        if s == "digits_word_unit":
            return [self.digits(2, 99), blank, self.unit()], False
        if s == "digits_symbol":
            return [self.digits(2, 99), *self.rng.choice([[("UNIT_HAZAAR", "k")], [("UNIT_CRORE", "cr")], [("DOT", "."), self.digits(1, 9), ("UNIT_LAKH", "l")]])], False
        if s == "digits_currency":
            return [self.digits(20, 99999)], True
        if s in ("chain", "chain_trailing_bare"):
            tail = [blank, self.card(1, 9)] if s == "chain_trailing_bare" else []
            return [self.card(), blank, self.form("UNIT_LAKH"), blank, self.card(), blank, self.form("UNIT_HAZAAR"), *tail], False
        if s in ("mult_chain", "unit_chain"):
            head = [self.card(2, 90), blank] if s == "mult_chain" else []
            return [*head, self.form("UNIT_HAZAAR"), blank, self.form("UNIT_CRORE")], False
        if s == "bare_card_currency":
            return [self.card(20, 99)], True
        if s == "bare_unit_currency":
            return [self.form("UNIT_LAKH")], True
        return [self.card(), blank, self.unit()], False

    def range(self) -> list[Token]:
        a = self.rng.randint(2, 40)
        b = self.rng.randint(a + 1, 3 * a)
        mode = self.rng.choices(("digits", "cards"), (40, 60))[0]
        unit = self.unit()
        if mode == "digits" or b > 99:
            return [("DIGITS", str(a)), ("RANGE", "-"), ("DIGITS", str(b)), ("SEP", " "), unit]
        return [self.card(a, a), ("RANGE", f" {RANGE_WORD[self.pack]} "), self.card(b, b), ("SEP", " "), unit]

    def line(self) -> dict:
        family = self.rng.choices(list(FAMILIES), list(FAMILIES.values()))[0]
        kinds = TEMPLATES[self.pack]
        if family == "negatives":
            return {"text": self.rng.choice(kinds["none"]), "spans": []}
        form = self.rng.choice(kinds["two" if family in ("two_spans", "conj") else "plain"]) if family not in ("bare", "short") else "{P}"
        text, spans = "", []
        pieces = form.split("{P}")
        for i, piece in enumerate(pieces):
            text += piece
            if i < len(pieces) - 1:
                tokens, money = (self.range(), False) if family == "ranges" else self.phrase()
                start = len(text)
                text += "".join(t for _, t in tokens)
                value, low, high, unit = evaluate(tokens)
                spans.append({"start": start, "end": len(text), "value": value, "low": low, "high": high, "unit": unit, "currency": "INR" if money else None, "classes": " ".join(c for c, _ in tokens if c != "SEP")})
                if money:
                    text += " " + MONEY[self.pack]
        return {"text": text, "spans": spans}


def noise(word: str, rng: random.Random) -> str:
    """One spelling change that keeps the word's first letter: a doubled, swapped, dropped or long letter."""
    if len(word) < 4:
        return word
    i = rng.randrange(1, len(word) - 1)
    out = rng.choice((word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word + word[-1]))
    return word if out in lexicon().forms or out in lexicon().blocked else out


def to_script(text: str, pack: str) -> str:
    return text.translate(str.maketrans("0123456789", SCRIPT_DIGITS[pack]))


def example(seed: int, row: int, pack: str) -> dict:
    """The labelled line of one row."""
    made = Maker(pack, random.Random(f"{seed}:{row}:{pack}")).line()
    assert normalize(made["text"]) == made["text"], made
    return made


SCHEMA = "struct<text:string,spans:array<struct<start:int,end:int,value:double,low:double,high:double,unit:string,currency:string,classes:string>>>"


def generate(spark: SparkSession, n: int, seed: int = 13, weights: dict[str, float] | None = None) -> DataFrame:
    """n labelled lines: row, lang, text, spans; languages by weight."""
    ship(spark)
    weights = weights or dict.fromkeys(PACKS, 1.0)
    total, edge = sum(weights.values()), 0.0
    lang, u = F.lit(list(weights)[-1]), F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) / float(1 << 30)
    for pack, w in reversed(list(weights.items())[:-1]):
        edge = sum(v for k, v in weights.items() if list(weights).index(k) <= list(weights).index(pack)) / total
        lang = F.when(u < edge, pack).otherwise(lang)

    def run(rows: pd.Series, langs: pd.Series) -> pd.DataFrame:
        got = [example(seed, r, p) for r, p in zip(rows, langs)]
        return pd.DataFrame({"text": [g["text"] for g in got], "spans": [g["spans"] for g in got]})

    df = spark.range(n).withColumnRenamed("id", "row").withColumn("lang", lang)
    return df.withColumn("_m", F.pandas_udf(run, SCHEMA)("row", "lang")).select("row", "lang", "_m.text", "_m.spans")
