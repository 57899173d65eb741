"""Which spans are no amounts, and which are verified: predicates over token arrays with lexicon flags.

Tokens carry the flags that :meth:`Lexicon.flags` gives; the rules read them and the classes only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GLUE = "O SEP RANGE COMMA DOT".split()
TOKEN = "struct<cls:string,text:string,start:int,end:int,justified:boolean,known:boolean,exact:boolean,near:boolean,ambiguous:boolean,blocked:boolean,ordinary:boolean>"


def _kind(t: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | t["cls"].startswith(p)
    return out


def meaningful(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: _kind(t, "PFX_", "CARD_", "UNIT_", "DIGITS"))


def _sole(tokens: Column) -> Column:
    """The only token that isn't glue, else null."""
    solid = F.filter(tokens, lambda t: ~t["cls"].isin(*GLUE))
    return F.when(F.size(solid) == 1, F.get(solid, F.lit(0)))


def bare_digits(tokens: Column) -> Column:
    """Digits alone, short and without grouping, or as long as a phone number."""
    only = F.exists(tokens, lambda t: t["cls"] == "DIGITS") & ~F.exists(tokens, lambda t: _kind(t, "UNIT_", "PFX_", "CARD_"))
    n = F.aggregate(tokens, F.lit(0), lambda s, t: s + F.when(t["cls"] == "DIGITS", F.length(t["text"])).otherwise(0))
    grouped = F.exists(tokens, lambda t: t["cls"] == "COMMA")
    return only & (((n <= 4) & ~grouped) | (n >= 10))


def lone_ambiguous_unit(tokens: Column) -> Column:
    return F.coalesce(_sole(tokens)["cls"].isin("UNIT_KHARAB", "UNIT_MILLION"), F.lit(False))


def lone_prefix(tokens: Column) -> Column:
    return F.coalesce(_sole(tokens)["cls"].startswith("PFX_"), F.lit(False))


def ordinary_word(tokens: Column) -> Column:
    return F.exists(meaningful(tokens), lambda t: t["ordinary"])


def leading_zero(tokens: Column) -> Column:
    """The first digits have a zero before others, and aren't behind a point."""
    at = F.array_position(F.transform(tokens, lambda t: t["cls"]), "DIGITS").cast("int")
    first = F.get(tokens, at - 1)
    before = F.filter(F.slice(tokens, 1, F.greatest(at - 1, F.lit(0))), lambda t: ~t["cls"].isin("SEP", "COMMA"))
    pointed = F.coalesce(F.try_element_at(before, F.lit(-1))["cls"] == "DOT", F.lit(False))
    return F.coalesce((at > 0) & first["text"].rlike("^[0०૦].") & ~pointed, F.lit(False))


def ambiguous_only(tokens: Column) -> Column:
    """Some token is known, and all known ones are ordinary words as well."""
    known = F.filter(meaningful(tokens), lambda t: t["known"])
    return (F.size(known) > 0) & F.forall(known, lambda t: (t["cls"] != "DIGITS") & t["ambiguous"])


def bare_cardinal(tokens: Column) -> Column:
    """The sole number is a spelled one that isn't an exact form."""
    solid = meaningful(tokens)
    first = F.get(solid, F.lit(0))
    return F.coalesce((F.size(solid) == 1) & first["cls"].startswith("CARD_") & ~first["exact"], F.lit(False))


def blocked_surface(tokens: Column) -> Column:
    return F.exists(meaningful(tokens), lambda t: t["blocked"])


def loose_symbol_unit(tokens: Column) -> Column:
    """A one or two letter ambiguous unit that isn't glued to its digits."""

    def loose(i: Column) -> Column:
        t = F.element_at(tokens, i)
        before = F.when(i > 1, F.element_at(tokens, F.greatest(i - 1, F.lit(1)))["cls"])
        short = t["cls"].startswith("UNIT_") & (F.length(t["text"]) <= 2) & t["ambiguous"] & t["known"]
        return short & ~F.coalesce(before.isin("DIGITS", "DOT", "COMMA"), F.lit(False))

    return (F.size(tokens) > 0) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), loose)


def unknown_unit(tokens: Column) -> Column:
    """No known cardinal or prefix, and a unit that is no unit word, nor one edit from one."""
    solid = meaningful(tokens)
    backed = F.exists(solid, lambda t: _kind(t, "CARD_", "PFX_") & t["known"])
    return ~backed & F.exists(solid, lambda t: t["cls"].startswith("UNIT_") & ~t["near"])


def dropped(tokens: Column, currency: Column) -> Column:
    """Any rule speaks against the span; a currency marker outweighs four of them."""
    weak = bare_digits(tokens) | lone_ambiguous_unit(tokens) | lone_prefix(tokens) | ambiguous_only(tokens)
    strong = ordinary_word(tokens) | blocked_surface(tokens) | bare_cardinal(tokens) | loose_symbol_unit(tokens) | unknown_unit(tokens) | leading_zero(tokens)
    return strong | (weak & currency.isNull())


def verified(tokens: Column) -> Column:
    """Every token is justified, and at least one carries a number or unit."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: t["justified"]) & (F.size(meaningful(tokens)) > 0)
