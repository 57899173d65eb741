"""The arithmetic of :mod:`arithmetic` for one span, in Python.

Column expressions over arrays are interpreted row by row by Spark; where a worker holds the tokens anyway,
as the tagger does, this costs a small part of that.  Both are held against each other by tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from .lexicon import PREFIXES, UNITS

NUMERIC = frozenset("DIGITS COMMA DOT".split())
Item = tuple[str, float]
Result = tuple[float, float | None, float | None, str | None]
_NATIVE = str.maketrans("०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯", "01234567890123456789")


def _float(text: str) -> float:
    try:
        return float(text.translate(_NATIVE).replace(",", ""))
    except ValueError:
        return 0.0


def merge(tokens: Sequence[tuple[str, str]]) -> list[Item]:
    items: list[Item] = []
    open_number: list[str] = []
    for cls, text in [*((c, t) for c, t in tokens if c != "SEP"), ("", "")]:
        if cls in NUMERIC:
            open_number.append(text)
            continue
        if open_number:
            items.append(("NUM", _float("".join(open_number))))
            open_number = []
        if cls.startswith("PFX_") and items and items[-1][0] == cls:
            continue
        if cls:
            items.append((cls, float(cls[5:]) if cls.startswith("CARD_") else 0.0))
    return items


def _scale(number: float | None, prefix: str | None) -> float:
    if prefix is None:
        return 1.0 if number is None else number
    alone, adds = PREFIXES[prefix]
    return alone if number is None or adds is None else number + adds


def amount(items: Sequence[Item]) -> tuple[float, str | None]:
    total, last, top = 0.0, None, None
    number = prefix = None
    for cls, v in items:
        if cls in UNITS:
            size = UNITS[cls][0]
            total = total * size if last is not None and size > last else total + _scale(number, prefix) * size
            top = cls if top is None or size > UNITS[top][0] else top
            last, number, prefix = size, None, None
        elif cls in PREFIXES:
            if prefix is not None:
                total, number = total + _scale(number, prefix), None
            prefix = cls
        elif cls == "NUM" or cls.startswith("CARD_"):
            if number is not None:
                total, prefix = total + _scale(number, prefix), None
            number = v
    return (total if number is None and prefix is None else total + _scale(number, prefix)), top


def tidy(v: float) -> float:
    return float(round(v)) if abs(v - round(v)) < max(1e-6, abs(v) * 1e-9) else round(v, 6)


def _name(cls: str | None) -> str | None:
    return UNITS[cls][1] if cls else None


def _side_by_side(items: list[Item]) -> Result | None:
    ends = [i for i, item in enumerate(items) if item[0] in UNITS]
    for before, here, there in zip([-1, *ends], ends, ends[1:]):
        numbered = all(any(c == "NUM" or c.startswith(("CARD_", "PFX_")) for c, _ in items[a + 1 : b]) for a, b in ((before, here), (here, there)))
        if numbered and UNITS[items[there][0]][0] >= UNITS[items[here][0]][0]:
            low, high = amount(items[: here + 1])[0], amount(items[here + 1 :])[0]
            if low < high:
                return tidy(low), tidy(low), tidy(high), _name(items[here][0])
    return None


def _adjacent_cards(tokens: list[tuple[str, str]]) -> Result | None:
    cards = [i for i, token in enumerate(tokens) if token[0].startswith("CARD_")]
    for i, j in zip(cards, cards[1:]):
        if int(tokens[i][0][5:]) < int(tokens[j][0][5:]) and all(c == "SEP" for c, _ in tokens[i + 1 : j]):
            low, high = (_single(tokens[:gone] + tokens[gone + 1 :]) for gone in (j, i))
            if low[1] is None and high[1] is None and low[0] < high[0]:
                return low[0], low[0], high[0], low[3]
    return None


def _single(tokens: list[tuple[str, str]]) -> Result:
    items = merge(tokens)
    found = _side_by_side(items) or _adjacent_cards(tokens)
    if found:
        return found
    value, unit = amount(items)
    return tidy(value), None, None, _name(unit)


def evaluate(tokens: Sequence[tuple[str, str]]) -> Result:
    """(value, low, high, unit) of a span's (class, text) tokens."""
    at = next((i for i, (cls, _) in enumerate(tokens) if cls == "RANGE"), len(tokens))
    sides = [side for side in (list(tokens[:at]), [t for t in tokens[at + 1 :] if t[0] != "RANGE"]) if side]
    if not sides:
        return 0.0, None, None, None
    if at >= len(tokens) - 1 or len(sides) == 1:
        if sides[0] == list(tokens[:at]):
            return _single(sides[0])
        value, unit = amount(merge(sides[0]))
        return tidy(value), None, None, _name(unit)
    (v, u), (w, x) = (amount(merge(side)) for side in sides)
    if u and x and v > w:
        return tidy(v + w), None, None, _name(u)
    if x and not u:
        v *= UNITS[x][0]
    low, high = tidy(min(v, w)), tidy(max(v, w))
    return low, low, high, _name(u or x)


GLUE = frozenset("O SEP RANGE COMMA DOT".split())


def _counts(cls: str) -> bool:
    return cls == "DIGITS" or cls.startswith(("PFX_", "CARD_", "UNIT_"))


def gate(tokens: Sequence[dict], marked: bool) -> str | None:
    """Name of a rule by which a span is no amount, or None; tokens as :meth:`Lexicon.flags` gives them."""
    solid = [t for t in tokens if _counts(t["cls"])]
    classes = [t["cls"] for t in tokens]
    sole = [c for c in classes if c not in GLUE]
    sole = sole[0] if len(sole) == 1 else ""
    if any(t["ordinary"] for t in solid):
        return "ordinary_word"
    if any(t["blocked"] for t in solid):
        return "blocked_surface"
    if len(solid) == 1 and sole.startswith("CARD_") and not solid[0]["exact"]:
        return "bare_cardinal"
    for before, t in zip(["", *classes], tokens):
        if t["cls"] in UNITS and len(t["text"]) <= 2 and t["ambiguous"] and t["known"] and before not in NUMERIC:
            return "loose_symbol_unit"
    if not any(t["known"] for t in solid if t["cls"].startswith(("CARD_", "PFX_"))) and any(not t["near"] for t in solid if t["cls"] in UNITS):
        return "unknown_unit"
    if "DIGITS" in classes:
        at = classes.index("DIGITS")
        before = [c for c in classes[:at] if c not in ("SEP", "COMMA")]
        if len(tokens[at]["text"]) > 1 and tokens[at]["text"][0] in "0०૦" and before[-1:] != ["DOT"]:
            return "leading_zero"
    if marked:
        return None
    digits = [t for t in solid if t["cls"] == "DIGITS"]
    if digits and len(digits) == len(solid):
        n = sum(len(t["text"]) for t in digits)
        if n >= 10 or (n <= 4 and "COMMA" not in classes):
            return "bare_digits"
    if sole in ("UNIT_KHARAB", "UNIT_MILLION"):
        return "lone_ambiguous_unit"
    if sole.startswith("PFX_"):
        return "lone_prefix"
    known = [t for t in solid if t["known"]]
    if known and all(t["cls"] != "DIGITS" and t["ambiguous"] for t in known):
        return "ambiguous_only"
    return None


def verified(tokens: Sequence[dict]) -> bool:
    return all(t["justified"] for t in tokens) and any(_counts(t["cls"]) for t in tokens)
