"""Amounts from tokens: one fold over the token array, all in column expressions.

Tokens are ``array<struct<cls, text, ...>>``.  Numbers merge first (digits, points and commas to one number),
then a fold keeps a running sum, the last unit, the largest unit and a pending number and prefix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import PREFIXES, UNITS, currency_patterns

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed, and present in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_ITEM = "struct<cls:string,v:double>"
_MERGE = f"struct<out:array<{_ITEM}>,buf:string>"
_FOLD = "struct<sum:double,last:double,most:double,unit:string,num:double,pfx:string>"


def _choose(x: Column, table: dict[str, float | str | None], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, value in table.items():
        if value is not None:
            out = F.when(x == name, F.lit(value)).otherwise(out)
    return out


def unit_value(cls: Column) -> Column:
    return _choose(cls, {k: v[0] for k, v in UNITS.items()}, "double")


def unit_name(cls: Column) -> Column:
    return _choose(cls, {k: v[1] for k, v in UNITS.items()}, "string")


def card_value(cls: Column) -> Column:
    return F.when(cls.startswith("CARD_"), F.substring_index(cls, "_", -1).try_cast("double"))


def merged(tokens: Column) -> Column:
    """Numbers, cardinals, prefixes and units in order: array<struct<cls, v>>; blanks go, repeated prefixes count once."""
    number = lambda buf: F.array(F.struct(F.lit("NUM").alias("cls"), F.coalesce(F.replace(buf, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0)).alias("v")))
    none = F.lit(None).cast("string")

    def step(s: Column, t: Column) -> Column:
        flat = F.when(s["buf"].isNull(), s["out"]).otherwise(F.concat(s["out"], number(s["buf"])))
        again = t["cls"].startswith("PFX_") & s["buf"].isNull() & (F.size(s["out"]) > 0) & (F.element_at(s["out"], -1)["cls"] == t["cls"])
        item = F.array(F.struct(t["cls"].alias("cls"), card_value(t["cls"]).alias("v")))
        digits = F.when(t["cls"] == "DIGITS", F.translate(t["text"], "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯", "01234567890123456789")).otherwise(t["text"])
        return (
            F.when(t["cls"] == "SEP", s)
            .when(t["cls"].isin("DIGITS", "DOT", "COMMA"), F.struct(s["out"].alias("out"), F.concat(F.coalesce(s["buf"], F.lit("")), digits).alias("buf")))
            .when(again, s)
            .otherwise(F.struct(F.concat(flat, item).alias("out"), none.alias("buf")))
            .cast(_MERGE)
        )

    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("out"), none.alias("buf")).cast(_MERGE)
    return F.aggregate(tokens, start, step, lambda s: F.when(s["buf"].isNull(), s["out"]).otherwise(F.concat(s["out"], number(s["buf"]))))


def _coefficient(num: Column, pfx: Column) -> Column:
    alone = _choose(pfx, {k: v[0] for k, v in PREFIXES.items()}, "double")
    adds = _choose(pfx, {k: v[1] for k, v in PREFIXES.items()}, "double")
    return F.when(pfx.isNull(), F.coalesce(num, F.lit(1.0))).otherwise(F.coalesce(num + adds, alone))


def amount(items: Column) -> Column:
    """struct<v, unit> of merged items: value and class of the largest unit."""

    def state(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, s[n]).alias(n) for n in ("sum", "last", "most", "unit", "num", "pfx")]).cast(_FOLD)

    none, no_name = F.lit(None).cast("double"), F.lit(None).cast("string")

    def step(s: Column, t: Column) -> Column:
        number = (t["cls"] == "NUM") | t["cls"].startswith("CARD_")
        prefix, unit = t["cls"].startswith("PFX_"), t["cls"].startswith("UNIT_")
        closed = s["sum"] + _coefficient(s["num"], s["pfx"])
        value = unit_value(t["cls"])
        larger = s["most"].isNull() | (value > s["most"])
        total = F.when(s["last"].isNotNull() & (value > s["last"]), s["sum"] * value).otherwise(s["sum"] + _coefficient(s["num"], s["pfx"]) * value)
        return (
            F.when(number & s["num"].isNotNull(), state(s, sum=closed, num=t["v"], pfx=no_name))
            .when(number, state(s, num=t["v"]))
            .when(prefix & s["pfx"].isNotNull(), state(s, sum=closed, num=none, pfx=t["cls"]))
            .when(prefix, state(s, pfx=t["cls"]))
            .when(unit, state(s, sum=total, last=value, most=F.when(larger, value).otherwise(s["most"]), unit=F.when(larger, t["cls"]).otherwise(s["unit"]), num=none, pfx=no_name))
            .otherwise(s)
        )

    start = F.struct(F.lit(0.0).alias("sum"), none.alias("last"), none.alias("most"), no_name.alias("unit"), none.alias("num"), no_name.alias("pfx")).cast(_FOLD)
    pending = lambda s: s["num"].isNotNull() | s["pfx"].isNotNull()
    return F.aggregate(items, start, step, lambda s: F.struct((s["sum"] + F.when(pending(s), _coefficient(s["num"], s["pfx"])).otherwise(0.0)).alias("v"), s["unit"].alias("unit")))


def tidy(v: Column) -> Column:
    """Whole where floating point is but noise away from it, else six decimals."""
    whole = F.rint(v)
    return F.when(F.abs(v - whole) < F.greatest(F.lit(1e-6), F.abs(v) * 1e-9), whole).otherwise(F.round(v, 6))


RESULT = "struct<value:double,low:double,high:double,unit:string>"


def _result(value: Column, low: Column | None = None, high: Column | None = None, unit: Column | None = None) -> Column:
    empty = F.lit(None)
    return F.struct(value.alias("value"), (empty if low is None else low).alias("low"), (empty if high is None else high).alias("high"), (empty if unit is None else unit).alias("unit")).cast(RESULT)


def _is(x: Column, *kinds: str) -> Column:
    out = F.lit(False)
    for kind in kinds:
        out = out | (x["cls"] == kind if kind == "NUM" else x["cls"].startswith(kind))
    return out


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _side_by_side(items: Column) -> Column:
    """Two terms, both with a number and a unit, the second's unit no smaller: a range without connector."""
    every = F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: _is(F.element_at(items, i), "UNIT_"))
    some = lambda a, b: F.exists(F.slice(items, a + 1, F.greatest(b - a - 1, F.lit(0))), lambda x: _is(x, "NUM", "CARD_", "PFX_"))

    def split(units: Column, j: Column) -> Column:
        since = F.when(j > 1, F.element_at(units, F.greatest(j - 1, F.lit(1)))).otherwise(0)

        def values(at: Column, then: Column) -> Column:
            both = F.array(amount(F.slice(items, 1, at))["v"], amount(F.slice(items, at + 1, F.size(items)))["v"])
            ranged = let(both, lambda v: F.when(v[0] < v[1], _result(tidy(v[0]), tidy(v[0]), tidy(v[1]), unit_name(F.element_at(items, at)["cls"]))))
            fits = some(since, at) & some(at, then) & (unit_value(F.element_at(items, then)["cls"]) >= unit_value(F.element_at(items, at)["cls"]))
            return F.when(fits, ranged)

        return let(F.array(F.element_at(units, j), F.element_at(units, j + 1)), lambda p: values(p[0], p[1]))

    return let(every, lambda units: F.when(F.size(units) > 1, _first(F.transform(F.sequence(F.lit(1), F.size(units) - 1), lambda j: split(units, j)))))


def _adjacent_cards(tokens: Column, depth: int) -> Column:
    """Two spelled numbers with only blanks between, the second larger: low drops the second, high the first."""
    every = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: _is(F.element_at(tokens, i), "CARD_"))
    without = lambda i: F.concat(F.slice(tokens, 1, i - 1), F.slice(tokens, i + 1, F.size(tokens)))

    def pair(i: Column, j: Column) -> Column:
        a, b = card_value(F.element_at(tokens, i)["cls"]), card_value(F.element_at(tokens, j)["cls"])
        blank = F.forall(F.slice(tokens, i + 1, F.greatest(j - i - 1, F.lit(0))), lambda t: t["cls"] == "SEP")
        sides = F.transform(F.array(j, i), lambda gone: let(without(gone), lambda t: _single(t, depth - 1)))
        plain = lambda r: r[0]["low"].isNull() & r[1]["low"].isNull() & (r[0]["value"] < r[1]["value"])
        return F.when(blank & (a < b), let(sides, lambda r: F.when(plain(r), _result(r[0]["value"], r[0]["value"], r[1]["value"], r[0]["unit"]))))

    def split(cards: Column, k: Column) -> Column:
        return let(F.array(F.element_at(cards, k), F.element_at(cards, k + 1)), lambda p: pair(p[0], p[1]))

    return let(every, lambda cards: F.when(F.size(cards) > 1, _first(F.transform(F.sequence(F.lit(1), F.size(cards) - 1), lambda k: split(cards, k)))))


def _single(tokens: Column, depth: int) -> Column:
    def ways(items: Column) -> Column:
        found = [_side_by_side(items)]
        if depth > 0:
            found.append(_adjacent_cards(tokens, depth))
        return F.coalesce(*found, let(amount(items), lambda plain: _result(tidy(plain["v"]), unit=unit_name(plain["unit"]))))

    return let(merged(tokens), ways)


def _two(a: Column, b: Column) -> Column:
    """Amounts on both sides of a connector: a falling chain adds up, else low to high, the left taking the right's unit."""
    falling = a["unit"].isNotNull() & b["unit"].isNotNull() & (a["v"] > b["v"])
    left = F.when(a["unit"].isNull() & b["unit"].isNotNull(), a["v"] * unit_value(b["unit"])).otherwise(a["v"])
    ranged = let(F.sort_array(F.array(left, b["v"])), lambda v: let(F.transform(v, tidy), lambda w: _result(w[0], w[0], w[1], unit_name(F.coalesce(a["unit"], b["unit"])))))
    return F.when(falling, _result(tidy(a["v"] + b["v"]), unit=unit_name(a["unit"]))).otherwise(ranged)


def evaluate(tokens: Column, depth: int = 2) -> Column:
    """struct<value, low, high, unit> of a span's tokens; no tokens give 0."""

    def parts(t: Column, at: Column) -> Column:
        return F.array(F.slice(t, 1, F.greatest(at - 1, F.lit(0))), F.filter(F.slice(t, at + 1, F.size(t)), lambda x: x["cls"] != "RANGE"))

    def ranged(sides: Column) -> Column:
        full = F.filter(sides, lambda s: F.size(s) > 0)
        values = F.transform(full, lambda s: amount(merged(s)))
        both = let(values, lambda v: F.when(F.size(v) > 1, _two(v[0], F.get(v, F.lit(1)))).when(F.size(v) < 1, _result(F.lit(0.0))).otherwise(_result(tidy(v[0]["v"]), unit=unit_name(v[0]["unit"]))))
        return F.when(F.size(sides[1]) > 0, both).otherwise(let(sides[0], lambda t: _single(t, depth)))

    at = lambda t: F.array_position(F.transform(t, lambda x: x["cls"]), "RANGE").cast("int")
    split = lambda t: let(at(t), lambda i: F.when(i > 0, parts(t, i)).otherwise(F.array(t, F.slice(t, 1, 0))))
    return let(tokens, lambda t: F.when(F.size(t) < 1, _result(F.lit(0.0))).otherwise(let(split(t), ranged)))


def currency(text: Column, start: Column, end: Column) -> Column:
    """INR if a marker ends within the 8 characters before, or a word starts within the 8 after; text is normalized."""
    before, after = currency_patterns()
    left = F.substring(text, F.greatest(start - 8, F.lit(0)) + 1, F.least(start, F.lit(8)))
    right = F.substring(text, end + 1, F.lit(8))
    return F.when(left.rlike(before) | right.rlike(after), "INR")

