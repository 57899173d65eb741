"""Text normalization as column expressions.

NFC has no built-in function: it is an Arrow UDF, whose result is taken where a test finds characters that it may change.
Parsing normalizes inside its own Arrow pass instead.  Offsets count code points of the normalized text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NATIVE = "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯"
_MAY_CHANGE = r"[^\x00-˿ऀ-ऻऽ-ॏ०-ॿ઀-઻ઽ-૿ -⁯₹]"
SCRIPT_DIGITS = {"hi_latn": "0123456789", "hi_deva": NATIVE[:10], "mr_deva": NATIVE[:10], "gu_gujr": NATIVE[10:]}


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    return F.when(text.rlike(_MAY_CHANGE + r"|[नरळक-जडढफय̀-ͯ]़"), F.pandas_udf(_nfc, "string")(text)).otherwise(text)


def normalize_text(text: Column) -> Column:
    """NFC, Indic digits to ASCII, lower case; null stays null."""
    return F.lower(F.translate(nfc(text), NATIVE, "01234567890123456789"))


def clean(text: Column) -> Column:
    """NFC with runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(nfc(text), r"[\s\p{Z}]+", " "))


def dedup_key(text: Column) -> Column:
    """Lower case without anything but word and Indic characters."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_ऀ-ॿ઀-૿]+", "")


def windows(text: Column, size: int = 128, overlap: int = 16) -> Column:
    """(offset, text) of windows of ``size`` characters; an empty text has one empty window."""
    n, stride = F.length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.substring(text, s + 1, F.lit(size)).alias("text")))


def stitch(chars, keys: list[str], position: str = "pos", offset: str = "offset"):
    """Of rows that name the same character, the one from the first window: a sort of all characters; for windows that are still in an array see ``stitched``."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(*keys, position).orderBy(offset)
    return chars.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def stitched(cut: Column) -> Column:
    """The text of an array of windows as ``windows`` makes them, each character from the first window that has it: row by row, nothing is sorted."""

    def own(all_: Column, w: Column, i: Column) -> Column:
        before = F.get(all_, i - 1)
        seen = F.coalesce(before["offset"] + F.length(before["text"]) - w["offset"], F.lit(0))
        return F.substring(w["text"], F.greatest(seen, F.lit(0)) + 1, F.length(w["text"]))

    # the array is bound to a name, as it would be made again for each window
    known = lambda all_: F.get(all_, F.lit(0))["text"].isNotNull()  # noqa: E731  (a null text has one window, without text)
    return F.get(F.transform(F.array(cut), lambda all_: F.when(known(all_), F.array_join(F.transform(all_, lambda w, i: own(all_, w, i)), ""))), F.lit(0))


def indian_grouping(number: Column) -> Column:
    """12,34,567 from an integer."""
    return F.regexp_replace(number.cast("decimal(38,0)").cast("string"), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")


def to_native_digits(text: Column, pack: str) -> Column:
    return F.translate(text, "0123456789", SCRIPT_DIGITS[pack])


def charset(texts, column: str = "text"):
    """ids of characters: padding 0, unknown 1, then all that occur, sorted."""
    from pyspark.sql.window import Window

    chars = texts.select(F.explode(F.split(normalize_text(F.col(column)), "")).alias("ch")).filter("ch <> ''").distinct()
    return chars.select("ch", (F.row_number().over(Window.orderBy("ch")) + 1).alias("id"))
