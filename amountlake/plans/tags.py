"""Queries for decoding of character tags, readers and the normal form of windows.

Texts, tags and classes are made from numbers; the SQL gets spans from the same numbers, never from the text.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators.decode import decode_tags
from ..operators.parse import explode_amounts, parse_df
from ..runtime import ship
from ..sources import files
from .amounts import pick, query, spread, table, whole

Piece = tuple[Column, str, str]
_UNIT = ("UNIT_HAZAAR", "UNIT_LAKH", "UNIT_CRORE")
#: length of the unit, in SQL
_LEN = "(CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 5 END)"


def _n(shift: int = 0) -> Column:
    return whole(10 + (F.col("p_partkey") + shift) % 90)


def _word() -> Column:
    return pick(F.col("p_partkey") % 3, "hazaar", "lakh", "crore")


def _class(name: str) -> Column:
    return pick(F.col("p_partkey") % 3, *_UNIT) if name == "UNIT" else F.lit(name)


def _tags(text: Column, form: str) -> Column:
    """Tags of a piece: ``B`` begins and goes on, ``I`` goes on, ``O`` is outside; longer forms say it by character, the last for the rest."""
    code = {"O": 0, "B": 1, "I": 2}
    rest = code["I" if form[-1] == "B" else form[-1]]
    first = F.array(*[F.lit(code[x]) for x in form])
    return F.slice(F.concat(first, F.array_repeat(F.lit(rest), F.length(text))), F.lit(1), F.length(text))


def spans(spark: SparkSession, sf_dir: str, *pieces: Piece) -> DataFrame:
    """p_partkey, n (spans), and start, end and classes of the first, from tagged pieces."""
    ship(spark)
    text = F.concat(*[p[0] for p in pieces])
    bio = F.concat(*[_tags(p[0], p[2]) for p in pieces])
    classes = F.concat(*[F.array_repeat(_class(p[1]), F.length(p[0])) for p in pieces])
    found = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", decode_tags(text, bio, classes).alias("found"))
    first = F.get("found", F.lit(0))
    return found.select("p_partkey", F.size("found").cast("long").alias("n"), first["start"].cast("long").alias("first"), first["end"].cast("long").alias("last"), F.array_join(first["classes"], " ").alias("classes"))


def _sql(n: str, first: str, last: str, classes: str) -> str:
    names = "CASE p_partkey % 3 WHEN 0 THEN 'UNIT_HAZAAR' WHEN 1 THEN 'UNIT_LAKH' ELSE 'UNIT_CRORE' END"
    parts = " || ' ' || ".join(names if c == "UNIT" else f"'{c}'" for c in classes.split())
    return f"SELECT p_partkey, ({n})::BIGINT AS n, ({first})::BIGINT AS first, ({last})::BIGINT AS last, {parts} AS classes FROM part"


def _decoded(name: str, sql: str, *pieces: tuple[Column | str, str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = [(F.lit(t) if isinstance(t, str) else t(), c, form) for t, c, form in pieces]
        return spans(spark, sf_dir, *made)

    run.__name__ = name
    query(sql)(run)


_WHOLE = _sql("1", "4", f"7 + {_LEN}", "DIGITS UNIT")
#: one character outside within a span is bridged
_decoded("q_decode_gap", _WHOLE, ("kul ", "O", "O"), (_n, "DIGITS", "B"), (" ", "SEP", "I"), (_word, "UNIT", "IOI"), (" diye", "O", "O"))
#: a span swallows the rest of a run of digits
_decoded("q_decode_digits", _sql("1", "4", "6", "DIGITS"), ("kul ", "O", "O"), (_n, "DIGITS", "BO"), (" diye", "O", "O"))
#: and of a word whose characters agree
_decoded("q_decode_word", _WHOLE, ("kul ", "O", "O"), (_n, "DIGITS", "B"), (" ", "SEP", "I"), (_word, "UNIT", "IIIO"), (" diye", "O", "O"))
#: tags that go on without a beginning are no span
_decoded("q_decode_begin", _sql("1", f"12 + {_LEN}", f"15 + 2 * {_LEN}", "DIGITS UNIT"), ("kul ", "O", "O"), (_n, "DIGITS", "I"), (" ", "SEP", "I"), (_word, "UNIT", "I"), (" aur ", "O", "O"), (_n, "DIGITS", "B"), (" ", "SEP", "I"), (_word, "UNIT", "I"))
#: digits are digits whatever their class, blanks are separators
_decoded("q_decode_class", _WHOLE, ("kul ", "O", "O"), (_n, "UNIT", "B"), (" ", "UNIT", "I"), (_word, "UNIT", "I"))
#: a mark between digits is a point, a comma, or a range
_decoded("q_decode_point", _sql("1", "0", f"6 + {_LEN}", "DIGITS DOT DIGITS UNIT"), (_n, "DIGITS", "B"), (".", "SEP", "I"), (_n, "DIGITS", "I"), (" ", "SEP", "I"), (_word, "UNIT", "I"))
_decoded("q_decode_dash", _sql("1", "0", f"6 + {_LEN}", "DIGITS RANGE DIGITS UNIT"), (_n, "DIGITS", "B"), ("-", "SEP", "I"), (_n, "DIGITS", "I"), (" ", "SEP", "I"), (_word, "UNIT", "I"))
#: halves of a range around a connecting word are one span
_decoded("q_decode_range", _sql("1", "0", f"8 + {_LEN}", "DIGITS RANGE DIGITS UNIT"), (_n, "DIGITS", "B"), (" ", "O", "O"), ("se", "RANGE", "O"), (" ", "O", "O"), (_n, "DIGITS", "B"), (_word, "UNIT", "I"))
#: an amount cut at a blank is one span
_decoded("q_decode_cut", _WHOLE, ("kul ", "O", "O"), (_n, "DIGITS", "B"), (" ", "O", "O"), (_word, "UNIT", "B"))
#: a year behind a unit is not part of the amount
_decoded("q_decode_year", _WHOLE, ("kul ", "O", "O"), (_n, "DIGITS", "B"), (" ", "SEP", "I"), (_word, "UNIT", "I"), (" ", "SEP", "I"), ("1995", "DIGITS", "I"))
#: separators at the edges go
_decoded("q_decode_edges", _WHOLE, ("kul", "O", "O"), (" ", "SEP", "B"), (_n, "DIGITS", "I"), (" ", "SEP", "I"), (_word, "UNIT", "I"), (" ", "SEP", "I"), ("diye", "O", "O"))


def _folder(spark: SparkSession) -> str:
    """A place to write to that all tasks can read."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/amountlake/{uuid.uuid4().hex}-files" if shared else f"file://{tempfile.mkdtemp(prefix='amountlake-')}/files"


_LINES = "SELECT c_custkey AS id, c_name || ' ke paas ' || (10 + c_custkey % 90) || ' lakh' AS text FROM customer"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" ke paas "), whole(10 + F.col("c_custkey") % 90), F.lit(" lakh")).alias("text"))


@query("SELECT c_custkey % 3 AS part, 'hi_latn' AS lang, c_name || ' ke paas ' || (10 + c_custkey % 90) || ' lakh' AS text, (10 + c_custkey % 90) * 1e5 AS value FROM customer")
def q_read_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines written as JSON in folders by part, and read back."""
    out = _folder(spark)
    span = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), ((10 + F.col("id") % 90) * 1e5).alias("value"))
    files.write_jsonl(_lines(spark, sf_dir).select("text", F.lit("hi_latn").alias("lang"), F.array(span).alias("spans"), (F.col("id") % 3).alias("part")), out, ["part"])
    back = [files.read_jsonl(spark, f"{out}/part={i}").withColumn("part", F.lit(i).cast("long")) for i in range(3)]
    return back[0].unionByName(back[1]).unionByName(back[2]).select("part", "lang", "text", F.get("spans", F.lit(0))["value"].alias("value"))


@query(_LINES.replace("c_custkey AS id, ", ""))
def q_read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second field of tab-separated lines."""
    out = _folder(spark)
    _lines(spark, sf_dir).select(F.concat_ws("\t", "id", "text", F.lit("more")).alias("value")).write.text(out)
    return files.read_tsv_second(spark, out)


@query(_LINES.replace("c_custkey AS id, ", ""))
def q_read_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of gzip files, without blanks at their ends."""
    out = _folder(spark)
    _lines(spark, sf_dir).select(F.concat("text", F.lit("  "))).write.option("compression", "gzip").text(out)
    return files.read_lines(spark, out, 4)


@query(_LINES.replace("c_custkey AS id, ", "'chat_hi' AS source, 'hi_latn' AS lang, "))
def q_read_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested Parquet field, through the catalog of sources."""
    out = _folder(spark)
    chat = next(s for s in files.CATALOG if s.id == "chat_hi")
    _lines(spark, sf_dir).select(F.struct(F.col("text").alias("hi_en"), F.lit("x").alias("en")).alias("translation")).write.parquet(f"{out}/{chat.path}")
    return files.load_all(spark, [chat], out).select("source", "lang", "text")


@query("SELECT count(*) AS n, 10::BIGINT AS limited FROM customer")
def q_source_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's limit of lines: few rows are its purpose."""
    out = _folder(spark)
    source = next(s for s in files.CATALOG if s.id == "roman_hi")
    _lines(spark, sf_dir).select(F.concat_ws("\t", "id", "text").alias("value")).write.text(f"{out}/{source.path}")
    counted = files.load(spark, source, out).agg(F.count("*").alias("n"))
    return counted.crossJoin(files.load(spark, source, out, 10).agg(F.count("*").alias("limited")))  # one row each


@query("SELECT c_custkey, c_name || ' | ' || c_custkey AS text FROM customer")
def q_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of overlapping windows, the first window's of each, put together again."""
    text = F.concat("c_name", F.lit(" | "), whole(F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", normalize.stitched(normalize.windows(text, 8, 3)).alias("text"))


@query("SELECT p_partkey, (10 + p_partkey % 90) * 1e5 AS value, p_partkey % 2 = 0 AS verified FROM part")
def q_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit one letter off is found and valued, but not verified."""
    unit = F.when(F.col("p_partkey") % 2 == 0, "lakh").otherwise("laakhh")
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(_n(), F.lit(" "), unit).alias("text"))
    return explode_amounts(df).select("p_partkey", "value", "verified")


@query("SELECT p_partkey, 1::BIGINT AS n, (1 - p_partkey % 2)::BIGINT AS n_strict, (1 - p_partkey % 2)::BIGINT AS n_sure FROM part")
def q_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict parsing keeps verified amounts, a least confidence the sure ones."""
    unit = F.when(F.col("p_partkey") % 2 == 0, "lakh").otherwise("laakhh")
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(_n(), F.lit(" "), unit).alias("text"))
    df = parse_df(parse_df(parse_df(df), out="strict", strict=True), out="sure", min_confidence=0.95)
    return df.select("p_partkey", *[F.size(c).cast("long").alias(n) for c, n in (("amounts", "n"), ("strict", "n_strict"), ("sure", "n_sure"))])


@query("SELECT p_partkey, (10 + p_partkey % 90) * 1e5 AS value FROM part WHERE p_partkey % 3 = 0")
def q_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parse_amounts in SQL drops what the gates drop: a phone number and an ordinary word."""
    from ..operators.parse import register

    register(spark)
    text = pick(F.col("p_partkey") % 3, "%s lakh", "9876543210 par", "kharab hai")
    df = table(spark, sf_dir, "part").select("p_partkey", F.replace(text, F.lit("%s"), _n()).alias("text"))
    return spark.sql("SELECT p_partkey, a.value FROM {df} LATERAL VIEW inline(parse_amounts(text)) a", df=df)

