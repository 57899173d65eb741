"""Amounts in text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calibration
from ..functions.lexicon import normalize
from ..functions.normalize import normalize_text
from ..runtime import ship
from .tagger import amounts, propose, propose_spans

AMOUNT = (
    "struct<span:string,start:int,end:int,value:double,range_low:double,range_high:double,unit:string,currency:string,confidence:double,"
    "raw_confidence:double,verified:boolean,classes:array<string>,tokens:array<struct<cls:string,text:string>>>"
)
Knots = tuple[Sequence[float], Sequence[float]]


def amounts_of(text: Column, normal: Column, spans: Column, strict: bool = False, min_confidence: float | None = None, knots: Knots | None = None) -> Column:
    """The proposed spans that no gate drops, as amounts."""
    same = F.length(text) == F.length(normal)

    def one(s: Column) -> Column:
        shown = F.when(same, F.substring(text, s["start"] + 1, s["end"] - s["start"])).otherwise(s["text"])
        solid = F.filter(s["tokens"], lambda t: t["cls"] != "SEP")
        fields = {
            "span": shown, "start": s["start"], "end": s["end"], "value": s["value"], "range_low": s["low"], "range_high": s["high"], "unit": s["unit"], "currency": s["currency"],
            "confidence": calibration.calibrate(s["raw_confidence"], knots), "raw_confidence": s["raw_confidence"], "verified": s["verified"],
            "classes": F.transform(solid, lambda t: t["cls"]),
            "tokens": F.transform(s["tokens"], lambda t: F.struct(t["cls"].alias("cls"), t["text"].alias("text"))),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(AMOUNT)

    keep = lambda s: s["gate"].isNull() & (s["verified"] if strict else F.lit(True))
    out = F.transform(F.filter(spans, keep), one)
    return out if min_confidence is None else F.filter(out, lambda a: a["confidence"] >= min_confidence)


def _parse(text: pd.Series) -> pd.Series:
    return text.map(amounts)


def parser():
    """text -> array of amounts that no gate drops: normalization, proposal, gates and values in one Arrow pass."""
    return F.pandas_udf(_parse, f"array<{AMOUNT}>")


def _chosen(found: Column, strict: bool = False, min_confidence: float | None = None, knots: Knots | None = None) -> Column:
    if knots is not None:
        found = F.transform(found, lambda a: a.withField("confidence", calibration.calibrate(a["raw_confidence"], knots)))
    if strict:
        found = F.filter(found, lambda a: a["verified"])
    return found if min_confidence is None else F.filter(found, lambda a: a["confidence"] >= min_confidence)


def parse_df(df: DataFrame, column: str = "text", out: str = "amounts", tagger: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """df with an array of amounts; works on streams too.  Options: strict, min_confidence, knots.  A null text has none.

    A ``tagger`` makes spans of normalized texts; without one, the lexicon's does all in one pass.
    """
    ship(df.sparkSession)
    text = F.col(column).cast("string")
    if tagger is None:
        return df.withColumn(out, _chosen(parser()(text), **options))
    return df.withColumn("_normal", normalize_text(text)).withColumn("_spans", tagger(F.col("_normal"))).withColumn(out, amounts_of(text, F.col("_normal"), F.col("_spans"), **options)).drop("_normal", "_spans")


def parse_column(text: Column, **options) -> Column:
    """The same as one expression."""
    return _chosen(parser()(text), **options)


def explode_amounts(df: DataFrame, column: str = "text", **options) -> DataFrame:
    """A row per amount, its fields as columns; rows without amounts go."""
    return parse_df(df, column, "_amounts", **options).select("*", F.inline("_amounts")).drop("_amounts")


def _normal(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalize(t))


def _proposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else propose(normalize(t)))


def register(spark: SparkSession) -> None:
    """SQL functions of a text: normalize_amount_text, propose_amounts (spans before the gates, with the gate that drops each)
    and parse_amounts (as :func:`parse_df`), for ``LATERAL VIEW inline(parse_amounts(text))``."""
    from .tagger import SPAN

    ship(spark)
    spark.udf.register("normalize_amount_text", F.pandas_udf(_normal, "string"))
    spark.udf.register("propose_amounts", F.pandas_udf(_proposed, f"array<{SPAN}>"))
    spark.udf.register("parse_amounts", parser())


def model_info() -> dict:
    """What tags by default."""
    from ..functions.lexicon import CLASSES, PACKS, lexicon

    return {"tagger": "lexicon", "packs": list(PACKS), "classes": len(CLASSES), "surfaces": len(lexicon().forms)}
