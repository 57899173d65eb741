"""Arithmetic, gates and parsing."""

import pytest
from pyspark.sql import functions as F

from amountlake.functions import arithmetic, fold, gates
from amountlake.functions.lexicon import PACKS, lexicon, resolve_pack
from amountlake.operators.parse import explode_amounts, model_info, parse_df, register
from amountlake.operators.tagger import annotate, propose, with_flags

#: classes, or digits as they are; value, low, high, unit
ARITHMETIC = [
    ("PFX_PAUNE CARD_2 UNIT_LAKH", 175000, None, None, "lakh"),
    ("CARD_1 UNIT_CRORE CARD_20 UNIT_LAKH", 12000000, None, None, "crore"),
    ("PFX_DHAI UNIT_SAU", 250, None, None, "sau"),
    ("PFX_SAADHE 3 UNIT_LAKH", 350000, None, None, "lakh"),
    ("CARD_10 UNIT_HAZAAR UNIT_CRORE", 1e11, None, None, "crore"),
    ("UNIT_SAU UNIT_CRORE", 1e9, None, None, "crore"),
    ("PFX_SAADHE CARD_3 UNIT_SAU UNIT_CRORE", 3.5e9, None, None, "crore"),
    ("CARD_1 UNIT_LAKH CARD_20 UNIT_HAZAAR UNIT_CRORE", 1.2e12, None, None, "crore"),
    ("PFX_AADHA PFX_AADHA UNIT_LAKH", 50000, None, None, "lakh"),
    ("CARD_3 PFX_SAADHE PFX_SAADHE UNIT_LAKH", 350000, None, None, "lakh"),
    ("PFX_SAVA PFX_DEDH UNIT_LAKH", 150001.25, None, None, "lakh"),
    ("CARD_1 UNIT_LAKH RANGE CARD_10 UNIT_HAZAAR", 110000, None, None, "lakh"),
    ("2 RANGE 3 UNIT_LAKH", 200000, 200000, 300000, "lakh"),
    ("5 UNIT_LAKH RANGE 10 UNIT_LAKH", 500000, 500000, 1000000, "lakh"),
    ("CARD_3 UNIT_HAZAAR CARD_5 UNIT_HAZAAR", 3000, 3000, 5000, "hazaar"),
    ("CARD_5 UNIT_LAKH CARD_5 UNIT_LAKH", 1000000, None, None, "lakh"),
    ("CARD_30 CARD_35 UNIT_HAZAAR", 30000, 30000, 35000, "hazaar"),
    ("CARD_2 UNIT_HAZAAR CARD_5", 2005, None, None, "hazaar"),
    ("CARD_20 CARD_5", 25, None, None, None),
    ("CARD_3 UNIT_HAZAAR CARD_5 CARD_10 UNIT_LAKH", 3000, 3000, 1000005, "hazaar"),
    ("२५ UNIT_HAZAAR", 25000, None, None, "hazaar"),
    ("૭૫૦૦", 7500, None, None, None),
    ("1 DOT ५", 1.5, None, None, None),
    ("2 UNIT_LAKH RANGE 3", 3, 3, 200000, "lakh"),
]


def _tokens(line):
    out = []
    for word in line.split():
        if out:
            out.append(("SEP", " "))
        named = {"DOT": ("DOT", "."), "RANGE": ("RANGE", "-")}
        out.append(named.get(word) or ((word, "x") if "_" in word else ("DIGITS", word)))
    return [t for i, t in enumerate(out) if not (t[0] == "SEP" and ("DOT" in (out[i - 1][0], out[i + 1][0])))]


@pytest.mark.parametrize("line, value, low, high, unit", ARITHMETIC)
def test_fold(line, value, low, high, unit):
    assert fold.evaluate(_tokens(line)) == (value, low, high, unit)


def test_native_fold_agrees(spark):
    rows = [(i, [{"cls": c, "text": t} for c, t in _tokens(x[0])]) for i, x in enumerate(ARITHMETIC)] + [(99, [])]
    df = spark.createDataFrame(rows, "i int, t array<struct<cls:string,text:string>>")
    got = {r.i: tuple(r.e) for r in df.select("i", arithmetic.evaluate(F.col("t"), depth=1).alias("e")).collect()}
    assert got.pop(99) == (0.0, None, None, None)
    assert got == {i: tuple(float(v) if isinstance(v, int) else v for v in x[1:]) for i, x in enumerate(ARITHMETIC)}


GATES = [("9876543210", "bare_digits"), ("2024", "bare_digits"), ("15000", None), ("1,00,000", None), ("kharab", "lone_ambiguous_unit"), ("dhai", "lone_prefix"), ("karodon", "ordinary_word"), ("05 lakh", "leading_zero"), ("1.05 lakh", None), ("1996 k", "loose_symbol_unit"), ("20k", None), ("arab", "ambiguous_only"), ("2.5l", None)]


def _flag_rows(text):
    from amountlake.operators.tagger import tokens_of

    return [("UNIT_CRORE" if c == "O" else c, t, a, b) for c, t, a, b in tokens_of(text)]


@pytest.mark.parametrize("text, rule", GATES)
def test_gate(text, rule):
    assert fold.gate(annotate(_flag_rows(text)), marked=False) == rule


def test_native_gates_agree(spark):
    rows = [(t, [{"cls": c, "text": x} for c, x, _, _ in _flag_rows(t)], r) for t, r in GATES]
    df = spark.createDataFrame(rows, "text string, t array<struct<cls:string,text:string>>, rule string").withColumn("f", with_flags(F.col("t")))
    for r in df.select("text", "rule", gates.dropped(F.col("f"), F.lit(None).cast("string")).alias("d")).collect():
        assert r.d == (r.rule is not None), r


def test_lexicon_counts():
    lex = lexicon()
    assert {p: len(lex.by_pack[p]) for p in PACKS} == {"hi_latn": 424, "hi_deva": 140, "mr_deva": 257, "gu_gujr": 235}
    assert len(lex.forms) == 1011 and all(len(c) == 1 for c in lex.forms.values())
    assert resolve_pack("mr") == "mr_deva" and resolve_pack("deva") == "hi_deva" and resolve_pack("?") == "hi_latn"


PARSED = [
    ("usko sava lakh mile", "sava lakh", 125000, None, True),
    ("dedh crore ka ghar", "dedh crore", 1.5e7, None, True),
    ("paune do lakh tak", "paune do lakh", 175000, None, True),
    ("2.5L tak", "2.5L", 250000, None, True),
    ("20k logon ne", "20k", 20000, None, True),
    ("das hazaar crore", "das hazaar crore", 1e11, None, True),
    ("Rs.4,500 diye", "4,500", 4500, "INR", True),
    ("2 lakh's ka", "2 lakh", 200000, None, True),
    ("दो लाख से तीन लाख", "दो लाख से तीन लाख", 200000, None, True),
    ("पावणेचार हजार", "पावणेचार हजार", 3750, None, True),
    ("दोनशे", "दोनशे", 200, None, True),
    ("બસો", "બસો", 200, None, True),
    ("સાડાત્રણસો", "સાડાત્રણસો", 350, None, True),
    ("लाखांचं", "लाखांचं", 100000, None, True),
    ("20 hazzaar", "20 hazzaar", 20000, None, False),
    ("दस हज़ार 1987", "दस हज़ार", 10000, None, True),
    ("5 panch hajar", "panch hajar", 5000, None, True),
    ("२५ हज़ार", "२५ हज़ार", 25000, None, True),
]


def test_parse(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(PARSED)], "i int, text string")
    got = {r.i: r.amounts for r in parse_df(df).collect()}
    for i, (text, span, value, currency, verified) in enumerate(PARSED):
        assert [(a.span, a.value, a.currency, a.verified) for a in got[i]] == [(span, value, currency, verified)], text


def test_parse_odd_input(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("karodon log", 3), ("करोडो", 4), ("do din baad", 5), ("x" * 5000 + " 5 lakh " + "y " * 3000, 6)], "text string, amounts int")
    rows = parse_df(df.withColumnRenamed("amounts", "key")).orderBy("key").collect()
    assert [len(r.amounts) for r in rows] == [0, 0, 0, 0, 0, 1]
    assert rows[5].amounts[0].value == 500000 and rows[5].amounts[0].start == 5001
    assert parse_df(df.limit(0)).count() == 0
    assert [r.value for r in explode_amounts(df.select("text"), strict=True, min_confidence=0.9).collect()] == [500000]


def test_sql_function(spark):
    """SQL and parse_df agree, gates included; the plan has one Arrow pass."""
    register(spark)
    lines = [(i, t) for i, t in enumerate([*[x[0] for x in PARSED], "9876543210 par", "kharab hai", None, "", "KUL 5 LAKH aur 20k", "İ 5 lakh"])]
    df = spark.createDataFrame(lines, "i int, text string")
    got = spark.sql("SELECT i, a.* FROM {df} LATERAL VIEW inline(parse_amounts(text)) a", df=df).collect()
    want = parse_df(df).select("i", "amounts").collect()
    assert [(r.i, r.span, r.start, r.end, r.value, r.currency, r.confidence, r.verified) for r in got] == [(r.i, a.span, a.start, a.end, a.value, a.currency, a.confidence, a.verified) for r in want for a in r.amounts]
    assert len(got) == len(PARSED) + 3
    assert spark.sql("SELECT normalize_amount_text('२५ LAKH') AS t").first().t == "25 lakh"
    assert [x.gate is None for x in spark.sql("SELECT propose_amounts('9876543210 par 5 lakh') AS s").first().s] == [False, True]
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(parse_df(df)._jdf.queryExecution(), "simple")
    assert plan.count("ArrowEvalPython") == 1
    assert model_info()["classes"] == 120


def test_cuts_change_nothing():
    """A text is cut only where no amount reaches: random texts give what they give uncut, wherever and however long."""
    import random

    from amountlake.operators import tagger

    rng = random.Random(5)
    stock = "5 20 1,000 lakh k crore sava dedh se ya - to aur Rs ₹ . , ( hazaar do teen bla usne diye ghar pin 400001 phone 98765 43210 saal ke baad quarter".split()
    for _ in range(400):
        text = "".join(rng.choice(stock) + " " * rng.choice((1, 1, 1, 2, 70)) for _ in range(rng.randrange(1, 40)))
        text = text + "bla " * rng.choice((0, 0, 5, 6, 7, 80)) + text
        uncut = [tagger.finish(s, text) for s in tagger.spans_of(text) if not tagger._counted(s, text)]
        assert propose(text) == uncut, text
    gap = "5" + " " * 70 + "-" + " " * 70 + "10 lakh"
    assert [s["low"] for s in propose(gap)] == [s["low"] for s in propose(gap + " zzz" * 240)]


def test_long_text_is_as_its_parts():
    parts = ["usne 5 lakh diye", "aur phir 20k baad", "sava crore"]
    text = (" bla" * 200 + " ").join(parts)
    assert [s["value"] for s in propose(text)] == [500000, 20000, 12500000]
