"""Queries over the test tables for the library's operators.

Texts are made from numeric columns; the SQL gets the expected results from the numbers, never from the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arithmetic, calibration, gates, normalize
from ..functions.lexicon import lexicon
from ..operators import corpus, metrics, synth
from ..operators.parse import parse_df
from ..operators.tagger import with_flags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows over all cores, before a pass in Python that costs far more than moving them: a file of few row groups would be few tasks, of any size."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)


def pick(index: Column, *words: str) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def whole(c: Column) -> Column:
    return c.cast("long").cast("string")


def first_amount(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n (amounts), and the first amount's fields."""
    a = F.get("amounts", F.lit(0))
    fields = [a[f].alias(f) for f in ("value", "range_low", "range_high", "unit", "currency", "verified")]
    return parse_df(df).select(*keys, F.size("amounts").cast("long").alias("n"), *fields)


def card_words(spark: SparkSession, pack: str) -> DataFrame:
    """n, word: a plain spelling of each number."""
    lex = lexicon()
    best: dict[int, str] = {}
    for surface, cls in sorted(lex.by_pack[pack].items()):
        if cls.startswith("CARD_") and not surface.isdigit():
            n = int(cls[5:])
            if n not in best or (best[n] in lex.ambiguous and surface not in lex.ambiguous):
                best[n] = surface
    return spark.createDataFrame(sorted(best.items()), "n long, word string")


@query("SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS value, 'INR' AS currency, true AS verified FROM orders")
def q_grouped_rupees(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("kul Rs "), normalize.indian_grouping(F.floor("o_totalprice")), F.lit(" diye")).alias("text"))
    return first_amount(df, "o_orderkey").select("o_orderkey", "value", "currency", "verified")


_UNIT_SQL = "CASE p_partkey % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e5 ELSE 1e7 END"
_NAME_SQL = "CASE p_partkey % 3 WHEN 0 THEN 'hazaar' WHEN 1 THEN 'lakh' ELSE 'crore' END"


def _key() -> Column:
    return F.col("p_partkey")


def _low() -> Column:
    return whole(1 + _key() % 40)


def _high() -> Column:
    return whole(2 + _key() % 40 + _key() % 9)


def _unit_word() -> Column:
    return pick(_key() % 3, "hazaar", "lakh", "crore")


@query(
    "SELECT l_orderkey, l_linenumber, floor(l_quantity) * CASE l_linenumber % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e5 ELSE 1e7 END AS value, "
    "CASE l_linenumber % 3 WHEN 0 THEN 'hazaar' WHEN 1 THEN 'lakh' ELSE 'crore' END AS unit FROM lineitem"
)
def q_symbol_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("total "), whole(F.floor("l_quantity")), pick(F.col("l_linenumber") % 3, "k", "L", "cr")).alias("text"))
    return first_amount(df, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "value", "unit")


@query(f"SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 WHEN 3 THEN 1.25 WHEN 4 THEN 1.5 WHEN 5 THEN 2.5 ELSE 0.5 END * {_UNIT_SQL} AS value, {_NAME_SQL} AS unit FROM part")
def q_prefix_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = pick(_key() % 7, "paav", "aadha", "paune", "sava", "dedh", "dhai", "saadhe")
    return first_amount(table(spark, sf_dir, "part").select("p_partkey", F.concat(word, F.lit(" "), _unit_word()).alias("text")), "p_partkey").select("p_partkey", "value", "unit")


@query(f"SELECT p_partkey, (2 + p_partkey % 97 + CASE p_partkey % 4 WHEN 0 THEN -0.25 WHEN 1 THEN 0.25 ELSE 0.5 END) * {_UNIT_SQL} AS value FROM part")
def q_prefix_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = pick(_key() % 4, "paune", "sava", "saadhe", "sadhe")
    return first_amount(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", word, whole(2 + _key() % 97), _unit_word()).alias("text")), "p_partkey").select("p_partkey", "value")


def _cards(pack: str, unit: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "part").withColumn("n", 1 + _key() % 99).join(F.broadcast(card_words(spark, pack)), "n")  # 99 rows at most
        return first_amount(df.select("p_partkey", F.concat_ws(" ", "word", F.lit(unit)).alias("text")), "p_partkey").select("p_partkey", "value", "unit", "verified")

    run.__name__ = f"q_card_words_{pack}"
    return run


for _pack, _unit in (("hi_latn", "lakh"), ("hi_deva", "लाख"), ("mr_deva", "लाख"), ("gu_gujr", "લાખ")):
    query("SELECT p_partkey, (1 + p_partkey % 99) * 1e5 AS value, 'lakh' AS unit, true AS verified FROM part")(_cards(_pack, _unit))


@query("SELECT p_partkey, (1 + p_partkey % 90) * 1e7 + (1 + p_partkey % 99) * 1e5 AS value, 'crore' AS unit FROM part")
def q_chain_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(whole(1 + _key() % 90), F.lit(" crore "), whole(1 + _key() % 99), F.lit(" lakh")).alias("text"))
    return first_amount(df, "p_partkey").select("p_partkey", "value", "unit")


@query("SELECT p_partkey, (1 + p_partkey % 90) * 1e10 AS value, 'crore' AS unit FROM part")
def q_chain_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_amount(table(spark, sf_dir, "part").select("p_partkey", F.concat(whole(1 + _key() % 90), F.lit(" hazaar crore")).alias("text")), "p_partkey").select("p_partkey", "value", "unit")


_RANGE_SQL = "SELECT p_partkey, (1 + p_partkey % 40) * 1e5 AS value, (1 + p_partkey % 40) * 1e5 AS range_low, (2 + p_partkey % 40 + p_partkey % 9) * 1e5 AS range_high, 'lakh' AS unit FROM part"


def _ranged(text: Column) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return first_amount(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey").select("p_partkey", "value", "range_low", "range_high", "unit")

    return run


@query(_RANGE_SQL)
def q_range_shared_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(F.concat(_low(), pick(_key() % 2, "-", " se "), _high(), F.lit(" lakh")))(spark, sf_dir)


@query(_RANGE_SQL)
def q_range_both_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(F.concat(_low(), F.lit(" lakh se "), _high(), F.lit(" lakh")))(spark, sf_dir)


@query(_RANGE_SQL)
def q_range_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(F.concat(_low(), F.lit(" lakh "), _high(), F.lit(" lakh")))(spark, sf_dir)


@query("SELECT p_partkey, (1 + p_partkey % 40) * 1e5 + (1 + p_partkey % 40) * 1e3 AS value, NULL::DOUBLE AS range_low, NULL::DOUBLE AS range_high, 'lakh' AS unit FROM part")
def q_range_falling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(F.concat(_low(), F.lit(" lakh - "), _low(), F.lit(" hazaar")))(spark, sf_dir)


@query("SELECT p_partkey, (1 + p_partkey % 40) * 1e3 AS value, (1 + p_partkey % 40) * 1e3 AS range_low, (2 + p_partkey % 40 + p_partkey % 9) * 1e3 AS range_high FROM part")
def q_range_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = card_words(spark, "hi_latn")
    df = table(spark, sf_dir, "part").withColumns({"a": 1 + _key() % 40, "b": 2 + _key() % 40 + _key() % 9})
    df = df.join(F.broadcast(words.withColumnsRenamed({"n": "a", "word": "x"})), "a").join(F.broadcast(words.withColumnsRenamed({"n": "b", "word": "y"})), "b")
    return first_amount(df.select("p_partkey", F.concat_ws(" ", "x", "y", F.lit("hazaar")).alias("text")), "p_partkey").select("p_partkey", "value", "range_low", "range_high")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR length(c_custkey::VARCHAR) > 4 THEN 1 ELSE 0 END::BIGINT AS n FROM customer")
def q_currency_exempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(key % 2 == 0, "usne Rs. ").otherwise("kamra "), whole(key), F.lit(" tha")).alias("text"))
    return first_amount(df, "c_custkey").select("c_custkey", "n")


_PHRASES = (
    ("9876543210 par", False), ("gj05 cd", False), ("dhai saal", False), ("pune mein", False), ("so gaya", False), ("3 hours", False), ("1996 k baad", False),
    ("kharab hai", False), ("lakhon log", False), ("das kharab", True), ("2 mil", True), ("20 hazzar", True), ("5 lakh", True), ("1,00,000 diye", True), ("2.5l tak", True),
)


@query("SELECT p_partkey, (CASE WHEN p_partkey % 15 IN (" + ", ".join(str(i) for i, (_, kept) in enumerate(_PHRASES) if kept) + ") THEN 1 ELSE 0 END)::BIGINT AS n FROM part")
def q_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_amount(table(spark, sf_dir, "part").select("p_partkey", pick(_key() % 15, *[p for p, _ in _PHRASES]).alias("text")), "p_partkey").select("p_partkey", "n")


def _token(cls: Column | str, text: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(cls).alias("cls"), as_column(text).alias("text"))


@query("SELECT p_partkey, (1 + p_partkey % 99) * 1e7 + (p_partkey % 1000) * 1e3 + 0.5 * 1e2 AS value, 'crore' AS unit FROM part")
def q_native_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array(
        _token(F.concat(F.lit("CARD_"), whole(1 + _key() % 99)), "x"), _token("SEP", " "), _token("UNIT_CRORE", "crore"), _token("DIGITS", whole(_key() % 1000)), _token("UNIT_HAZAAR", "k"),
        _token("PFX_AADHA", "aadha"), _token("UNIT_SAU", "sau"),
    )
    out = table(spark, sf_dir, "part").select("p_partkey", arithmetic.amount(arithmetic.merged(tokens)).alias("a"))
    return out.select("p_partkey", arithmetic.tidy(F.col("a.v")).alias("value"), arithmetic.unit_name(F.col("a.unit")).alias("unit"))


@query(
    "SELECT p_partkey, (p_partkey % 1000 <= 9999 AND length((p_partkey * 37)::VARCHAR) <= 4) OR length((p_partkey * 37)::VARCHAR) >= 10 AS bare, "
    "false AS lone, true AS verified FROM part"
)
def q_native_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..runtime import ship

    ship(spark)
    df = table(spark, sf_dir, "part").select("p_partkey", with_flags(F.array(_token("DIGITS", whole(_key() * 37)))).alias("t"))
    return df.select("p_partkey", gates.bare_digits(F.col("t")).alias("bare"), gates.lone_prefix(F.col("t")).alias("lone"), gates.verified(F.col("t")).alias("verified"))


@query("SELECT p_partkey, p_partkey::VARCHAR AS text FROM part")
def q_native_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = F.when(_key() % 2 == 0, normalize.to_native_digits(whole(_key()), "hi_deva")).otherwise(normalize.to_native_digits(whole(_key()), "gu_gujr"))
    return table(spark, sf_dir, "part").select("p_partkey", normalize.normalize_text(pack).alias("text"))


@query("""
SELECT doc_id, CASE WHEN length(text) <= 128 THEN 1 ELSE 1 + ceil((length(text) - 128) / 112.0) END::BIGINT AS n_windows,
       (length(text) + 16 * (CASE WHEN length(text) <= 128 THEN 0 ELSE ceil((length(text) - 128) / 112.0) END))::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL""")
def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", normalize.windows(F.col("text")).alias("w"))
    n = F.aggregate("w", F.lit(0).cast("long"), lambda s, w: s + F.length(w["text"]))
    return df.select("doc_id", F.size("w").cast("long").alias("n_windows"), n.alias("n_chars"))


_KNOTS = ([0.1, 0.4, 0.7, 0.9], [0.05, 0.3, 0.8, 0.95])


@query("""
SELECT event_id, CASE WHEN r <= 0.1 THEN 0.05 WHEN r <= 0.4 THEN 0.05 + 0.25 * (r - 0.1) / (0.4 - 0.1) WHEN r <= 0.7 THEN 0.3 + 0.5 * (r - 0.4) / (0.7 - 0.4)
       WHEN r <= 0.9 THEN 0.8 + 0.15 * (r - 0.7) / (0.9 - 0.7) ELSE 0.95 END::DECIMAL(12, 8) AS confidence FROM (SELECT event_id, ((event_id % 100) / 100.0)::DOUBLE AS r FROM events)""")
def q_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (F.col("event_id") % 100) / F.lit(100.0)
    return table(spark, sf_dir, "events").select("event_id", calibration.calibrate(raw, _KNOTS).cast("decimal(12,8)").alias("confidence"))


@query("""
WITH p AS (SELECT ((doc_id * 7) % 20) / 20.0::DOUBLE AS x, avg(quality::DOUBLE) AS y, count(*) AS n FROM labels GROUP BY 1),
s AS (SELECT a.x AS a, b.x AS b, sum(c.y * c.n) / sum(c.n) AS m FROM p a JOIN p b ON a.x <= b.x JOIN p c ON c.x BETWEEN a.x AND b.x GROUP BY 1, 2),
lo AS (SELECT p.x, s.a, min(s.m) AS m FROM p JOIN s ON s.a <= p.x AND s.b >= p.x GROUP BY 1, 2)
SELECT x AS raw, round(max(m), 9) AS fitted FROM lo GROUP BY 1""")
def q_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "labels").select((((F.col("doc_id") * 7) % 20) / 20.0).alias("raw"), F.col("quality").alias("correct"))
    xs, ys = calibration.fit_isotonic(records)
    return spark.createDataFrame([(x, round(y, 9)) for x, y in zip(xs, ys)], "raw double, fitted double")


_GOLD_SQL = "g AS (SELECT o_orderkey AS ex, o_orderkey % 7 AS s, o_orderkey % 7 + 5 AS e, o_orderkey % 50 AS v FROM orders WHERE o_orderkey % 5 <> 0)"
_PRED_SQL = (
    "p AS (SELECT o_orderkey AS ex, o_orderkey % 7 + CASE WHEN o_orderkey % 11 = 0 THEN 1 WHEN o_orderkey % 13 = 0 THEN 9 ELSE 0 END AS s, "
    "o_orderkey % 7 + 5 + CASE WHEN o_orderkey % 13 = 0 THEN 9 ELSE 0 END AS e, o_orderkey % 50 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS v, "
    "(o_orderkey % 100) / 100.0 AS raw, o_orderkey % 2 = 0 AS verified FROM orders WHERE o_orderkey % 3 <> 0)"
)


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    none = F.lit(None).cast("double")
    gold = orders.filter(k % 5 != 0).select(k.alias("ex"), (k % 7).alias("start"), (k % 7 + 5).alias("end"), (k % 50).cast("double").alias("value"), none.alias("low"), none.alias("high"))
    far = F.when(k % 13 == 0, 9).otherwise(0)
    pred = orders.filter(k % 3 != 0).select(
        k.alias("ex"), (k % 7 + F.when(k % 11 == 0, 1).otherwise(far)).alias("start"), (k % 7 + 5 + far).alias("end"), (k % 50 + F.when(k % 17 == 0, 1).otherwise(0)).cast("double").alias("value"),
        none.alias("low"), none.alias("high"), ((k % 100) / 100.0).alias("raw"), (k % 2 == 0).alias("verified"),
    )
    return orders.select(k.alias("ex"), (k % 4).alias("file")), gold, pred


@query(f"""
WITH {_GOLD_SQL}, {_PRED_SQL}, n AS (
  SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_pred, count(*) AS n_exact, count(*) FILTER (WHERE g.v = p.v) AS n_right FROM g JOIN p USING (ex, s, e))
SELECT *, n_exact / n_pred::DOUBLE AS precision, n_exact / n_gold::DOUBLE AS recall, n_right / n_gold::DOUBLE AS value_accuracy,
       round(2.0 * n_exact / (n_gold + n_pred), 12) AS f1 FROM n""")
def q_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, pred = _spans(spark, sf_dir)
    return metrics.span_scores(gold, pred).withColumn("f1", F.round("f1", 12))


@query(f"""
WITH {_GOLD_SQL}, {_PRED_SQL}, h AS (
  SELECT g.ex, max(CASE WHEN g.s = p.s AND g.e = p.e THEN 1 ELSE 0 END) AS x, max(CASE WHEN g.s = p.s AND g.e = p.e AND g.v = p.v THEN 1 ELSE 0 END) AS r, count(p.ex) AS m
  FROM g LEFT JOIN p ON g.ex = p.ex AND p.s < g.e AND g.s < p.e GROUP BY g.ex)
SELECT CASE WHEN r = 1 THEN 'right' WHEN x = 1 THEN 'wrong_value' WHEN m > 0 THEN 'wrong_boundary' ELSE 'missed' END AS kind, count(*) AS n FROM h GROUP BY 1
UNION ALL SELECT 'spurious', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ex = p.ex AND p.s < g.e AND g.s < p.e)""")
def q_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, pred = _spans(spark, sf_dir)
    return metrics.misses(gold, pred)


@query(f"""
WITH {_GOLD_SQL}, {_PRED_SQL}
SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS n_negatives, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0) AS n_false""")
def q_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.negatives(*_spans(spark, sf_dir))


@query(f"""
WITH {_GOLD_SQL}, {_PRED_SQL}, v AS (SELECT * FROM p WHERE verified), n AS (
  SELECT (SELECT count(*) FROM g) AS n_gold, count(*) AS n_covered, count(*) FILTER (WHERE g.v = v.v) AS n_right FROM g JOIN v USING (ex, s, e))
SELECT *, (SELECT count(*) FROM v WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ex = v.ex AND v.s < g.e AND g.s < v.e)) AS n_spurious,
       n_covered / n_gold::DOUBLE AS coverage, n_right / n_covered::DOUBLE AS value_accuracy FROM n""")
def q_strict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, pred = _spans(spark, sf_dir)
    return metrics.strict_scores(gold, pred)


_RECORDS_SQL = f"""{_GOLD_SQL}, {_PRED_SQL}, r AS (
  SELECT p.ex, p.raw, p.verified, max(CASE WHEN g.s = p.s AND g.e = p.e AND g.v = p.v THEN 1 ELSE 0 END) AS correct, CASE WHEN count(g.ex) = 0 THEN 1 ELSE 0 END AS spurious
  FROM p LEFT JOIN g ON g.ex = p.ex AND p.s < g.e AND g.s < p.e GROUP BY ALL)"""


@query(f"""
WITH {_RECORDS_SQL}
SELECT t.threshold, count(*) AS kept, sum(correct) / (SELECT count(*) FROM g)::DOUBLE AS coverage, sum(correct) / count(*)::DOUBLE AS precision
FROM r JOIN (VALUES (0.0::DOUBLE), (0.5), (0.7), (0.9)) t(threshold) ON raw >= threshold GROUP BY 1""")
def q_confidence_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, pred = _spans(spark, sf_dir)
    return metrics.confidence_curve(metrics.confidence_records(gold, pred), gold.count())


@query(f"""
WITH {_RECORDS_SQL}, b AS (SELECT *, least(floor(raw::DOUBLE * 10), 9)::INT AS bin FROM r), t AS (
  SELECT 'all' AS tier, bin, count(*) AS n, avg(correct) AS precision, avg(spurious) AS spurious FROM b GROUP BY bin
  UNION ALL SELECT CASE WHEN verified THEN 'verified' ELSE 'unverified' END, bin, count(*), avg(correct), avg(spurious) FROM b GROUP BY bin, verified)
SELECT tier, bin, n, round(precision, 9) AS precision, round(spurious, 9) AS spurious FROM t""")
def q_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, pred = _spans(spark, sf_dir)
    return calibration.reliability(metrics.confidence_records(gold, pred)).withColumns({c: F.round(c, 9) for c in ("precision", "spurious")})


@query(f"""
WITH {_GOLD_SQL}, {_PRED_SQL}, m AS (SELECT coalesce(g.ex, p.ex) % 4 AS file, g.ex IS NOT NULL AS ig, p.ex IS NOT NULL AS ip, g.v = p.v AS ok FROM g FULL JOIN p ON g.ex = p.ex AND g.s = p.s AND g.e = p.e)
SELECT file, count(*) FILTER (WHERE ig) AS n_gold, count(*) FILTER (WHERE ip) AS n_pred, count(*) FILTER (WHERE ig AND ip) AS n_exact, count(*) FILTER (WHERE ok) AS n_right FROM m GROUP BY ROLLUP (file)""")
def q_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_file(*_spans(spark, sf_dir))


@query("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(coalesce(stddev_samp(c_acctbal), 0), 6) AS stdev FROM customer GROUP BY 1")
def q_seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.seed_spread(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").withColumns({c: F.round(c, 6) for c in ("mean", "stdev")})


@query("""
WITH r AS (SELECT s_suppkey AS place, 'c' || (s_suppkey % 4) AS config, s_acctbal / 10000.0 AS val, (s_suppkey * 7 % 10) / 10.0::DOUBLE AS f1, s_suppkey % 3 AS fp FROM supplier),
b AS (SELECT config FROM r GROUP BY 1 ORDER BY avg(val) DESC, min(place) LIMIT 1),
t AS (SELECT r.*, max(val) OVER () AS top FROM r JOIN b USING (config))
SELECT config, place, f1 FROM t WHERE top - val <= 0.005 ORDER BY f1 DESC, fp, place LIMIT 1""")
def q_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(k.alias("place"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("config"), (F.col("s_acctbal") / 10000.0).alias("val"), (k * 7 % 10 / 10.0).alias("f1"), (k % 3).alias("fp"))
    return metrics.winner(runs).select("config", "place", "f1")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'DIGITS+UNIT_LAKH' WHEN o_orderkey % 7 = 0 THEN 'PFX_SAVA+UNIT_LAKH' ELSE 'CARD_' || (1 + o_orderkey % 20) END AS pattern FROM orders)
SELECT pattern, count(*) AS n, min(o_orderkey)::VARCHAR AS sample FROM r GROUP BY 1 ORDER BY n DESC, pattern LIMIT 8""")
def q_top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pattern = F.when(k % 3 == 0, "DIGITS+UNIT_LAKH").when(k % 7 == 0, "PFX_SAVA+UNIT_LAKH").otherwise(F.concat(F.lit("CARD_"), whole(1 + k % 20)))
    return metrics.top_patterns(table(spark, sf_dir, "orders").select(pattern.alias("pattern"), whole(k).alias("text"), k.alias("place")), k=8)


@query("""
SELECT CASE u WHEN 0 THEN 'UNIT_HAZAAR' WHEN 1 THEN 'UNIT_LAKH' WHEN 2 THEN 'UNIT_CRORE' ELSE 'DIGITS' END AS cls, count(*) AS n, CASE WHEN u = 3 THEN count(DISTINCT p_partkey % 50) ELSE 1 END::BIGINT AS surfaces
FROM (SELECT p_partkey, p_partkey % 3 AS u FROM part UNION ALL SELECT p_partkey, 3 FROM part) GROUP BY u""")
def q_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.concat(whole(2 + _key() % 50), F.lit(" "), _unit_word()).alias("text"))
    return metrics.class_histogram(parse_df(df).select(F.inline("amounts")))


@query("SELECT count(*) AS n, count(*) AS n_verified, 1.0::DOUBLE AS mean, 0::BIGINT AS b0, 0::BIGINT AS b1, 0::BIGINT AS b2, count(*) AS b3 FROM part")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.concat(whole(2 + _key() % 50), F.lit(" "), _unit_word()).alias("text"))
    return metrics.summary(parse_df(df).select(F.inline("amounts")))


@query("""
WITH k AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+', '', 'g') AS key FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id) AS n FROM k WHERE key <> '')
SELECT doc_id FROM n WHERE n = 1""")
def q_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_by_key(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id")


@query("""
SELECT conv_id, turn FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM conversations)
WHERE length(t) <= 128 AND len(regexp_extract_all(t, '[^ ]+')) BETWEEN 3 AND 40""")
def q_length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.length_band(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 6 END AS score, p_partkey % 4 <> 0 AS positive FROM part""")
def q_line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pick(_key() % 4, "aaj mausam accha", "flat 20k mein", "usko sava lakh mile", "bill ₹ 500")
    return corpus.score_lines(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey").select("p_partkey", "score", "positive")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'value_mismatch' WHEN p_partkey % 4 = 2 THEN 'phrase_not_found' WHEN p_partkey % 4 = 3 THEN 'unknown_token:zoop' END AS reason FROM part""")
def q_checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(whole(2 + _key()), F.when(_key() % 4 == 3, " zoop").otherwise("k"))
    claimed = (2 + _key()) * 1000.0 + F.when(_key() % 4 == 1, 5).otherwise(0)
    phrase = F.struct(F.when(_key() % 4 == 2, "kuch aur").otherwise(said).alias("phrase"), claimed.alias("value"), F.lit(None).cast("array<double>").alias("range"))
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("usne "), said, F.lit(" diye")).alias("text"), F.lit("hi_latn").alias("lang"), F.array(phrase).alias("phrases"))
    return corpus.verify_lines(lines, order=("p_partkey",)).select("p_partkey", "reason")


@query()
def q_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labelled spans of synthetic lines the parser finds with their value, by language."""
    rows = synth.generate(spark, table(spark, sf_dir, "part").count())
    found = parse_df(rows)
    right = F.size(F.filter("spans", lambda s: F.exists("amounts", lambda a: (a["start"] == s["start"]) & (a["end"] == s["end"]) & (a["value"] == s["value"]))))
    return found.groupBy("lang").agg(F.sum(F.size("spans")).alias("n_spans"), F.sum(right).alias("n_right"), F.count("*").alias("n_lines"))


@query()
def q_document_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in whole documents."""
    return parse_df(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size("amounts").alias("n"))


@query()
def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded uniform sample per language: the operator's purpose is to keep few rows."""
    return corpus.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), 50, "17", ["lang"]).select("doc_id", "lang")
