"""Span metrics as joins and aggregates.

Gold and predictions are rows ``ex, start, end, value, low, high`` (predictions also ``raw, confidence, verified``);
examples are rows ``ex`` with any grouping columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = ["ex", "start", "end"]
CATEGORIES = ("digits", "words", "range", "currency", "long", "mixed_script", "prefix", "multi_unit", "symbol_unit")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _equal(g: str = "g", p: str = "p") -> Column:
    """Values agree, and ranges where gold has one."""
    c = lambda side, name: F.col(f"{side}.{name}")
    ranged = c(g, "low").isNull() | (c(g, "low").eqNullSafe(c(p, "low")) & c(g, "high").eqNullSafe(c(p, "high")))
    return F.coalesce((c(g, "value") == c(p, "value")) & ranged, F.lit(False))


def matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer join on the exact span: in_gold, in_pred, right."""
    g, p = gold.withColumn("_g", F.lit(True)).alias("g"), pred.withColumn("_p", F.lit(True)).alias("p")
    on = (F.col("g.ex") == F.col("p.ex")) & (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    both = g.join(p, on, "full_outer")
    pick = [F.coalesce(f"g.{c}", f"p.{c}").alias(c) for c in SPAN]
    return both.select(*pick, F.col("g._g").isNotNull().alias("in_gold"), F.col("p._p").isNotNull().alias("in_pred"), _equal().alias("right"))


def span_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """n_gold, n_pred, n_exact, n_right, precision, recall, f1, value_accuracy over all examples."""
    n = matched(gold, pred).agg(
        F.count_if("in_gold").alias("n_gold"), F.count_if("in_pred").alias("n_pred"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("n_exact"), F.count_if("right").alias("n_right")
    )
    n = n.withColumns({"precision": _ratio(F.col("n_exact"), F.col("n_pred")), "recall": _ratio(F.col("n_exact"), F.col("n_gold")), "value_accuracy": _ratio(F.col("n_right"), F.col("n_gold"))})
    return n.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.ex") == F.col(f"{b}.ex")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def misses(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """kind, n of missed, boundary and value errors of gold spans, and of spurious predictions."""
    g, p = gold.alias("g"), pred.alias("p")
    exact = (F.col("g.ex") == F.col("p.ex")) & (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end"))
    hit = g.join(p, _overlaps("g", "p"), "left").groupBy("g.ex", "g.start", "g.end").agg(F.max(F.coalesce(exact, F.lit(False))).alias("exact"), F.max(F.coalesce(exact & _equal(), F.lit(False))).alias("right"), F.max(F.col("p.ex").isNotNull()).alias("met"))
    kind = F.when(F.col("right"), "right").when(F.col("exact"), "wrong_value").when(F.col("met"), "wrong_boundary").otherwise("missed")
    spurious = p.join(g, _overlaps("g", "p"), "left_anti").select(F.lit("spurious").alias("kind"))
    return hit.select(kind.alias("kind")).unionByName(spurious).groupBy("kind").agg(F.count("*").alias("n"))


def strict_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """coverage, value_accuracy (of covered) and spurious of verified predictions."""
    sure = pred.filter("verified")
    n = matched(gold, sure).agg(F.count_if("in_gold").alias("n_gold"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("n_covered"), F.count_if("right").alias("n_right"))
    lone = sure.alias("p").join(gold.alias("g"), _overlaps("g", "p"), "left_anti").agg(F.count("*").alias("n_spurious"))
    return n.crossJoin(lone).withColumns({"coverage": _ratio(F.col("n_covered"), F.col("n_gold")), "value_accuracy": _ratio(F.col("n_right"), F.col("n_covered"))})  # one row each


def negatives(examples: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """n_negatives and n_false: examples without gold, and those of them with a prediction."""
    none = examples.select("ex").join(gold.select("ex").distinct(), "ex", "left_anti")
    return none.join(pred.select("ex").distinct().withColumn("hit", F.lit(True)), "ex", "left").agg(F.count("*").alias("n_negatives"), F.count_if("hit").alias("n_false"))


def categories(classes: Column, text: Column, ranged: Column, currency: Column) -> Column:
    """Array of category names of a span; one with several counts in each."""
    has = lambda p: F.exists(classes, lambda c: c.startswith(p))
    units = F.filter(classes, lambda c: c.startswith("UNIT_"))
    tests = {
        "digits": has("DIGITS"), "words": has("CARD_") | has("PFX_"), "range": ranged, "currency": currency.isNotNull(), "long": F.length(text) >= 20,
        "mixed_script": text.rlike("[a-z]") & text.rlike("[ऀ-ॿ઀-૿]"), "prefix": has("PFX_"), "multi_unit": F.size(units) >= 2, "symbol_unit": text.rlike(r"(?i)(^|[\d\s.])(k|l|m|b|cr|bn|mn|lpa|lac)$"),
    }
    return F.array_compact(F.array(*[F.when(tests[name], name) for name in CATEGORIES]))


def confidence_records(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """raw, verified, correct, spurious of each prediction."""
    g, p = gold.alias("g"), pred.alias("p")
    exact = (F.col("g.start") == F.col("p.start")) & (F.col("g.end") == F.col("p.end")) & _equal()
    keys = ["p.ex", "p.start", "p.end", "p.raw", "p.verified"]
    return p.join(g, _overlaps("g", "p"), "left").groupBy(*keys).agg(F.max(F.coalesce(exact, F.lit(False))).alias("correct"), (~F.max(F.col("g.ex").isNotNull())).alias("spurious")).select("raw", "verified", "correct", "spurious")


def confidence_curve(records: DataFrame, n_gold: int, thresholds: tuple[float, ...] = (0.0, 0.5, 0.7, 0.9), column: str = "raw") -> DataFrame:
    """threshold, kept, coverage, precision."""
    steps = records.select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), (F.col(column)).alias("c"), "correct").filter("c >= threshold")
    out = steps.groupBy("threshold").agg(F.count("*").alias("kept"), F.count_if("correct").alias("right"))
    return out.select("threshold", "kept", _ratio(F.col("right"), F.lit(n_gold)).alias("coverage"), _ratio(F.col("right"), F.col("kept")).alias("precision"))


def by_file(examples: DataFrame, gold: DataFrame, pred: DataFrame, file: str = "file") -> DataFrame:
    """Counts per file and, with file null, of all."""
    found = matched(gold, pred).join(examples.select("ex", file), "ex")
    return found.rollup(file).agg(F.count_if("in_gold").alias("n_gold"), F.count_if("in_pred").alias("n_pred"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("n_exact"), F.count_if("right").alias("n_right"))


def matrix(scores: DataFrame, row: str = "file", column: str = "model", value: str = "value_accuracy") -> DataFrame:
    return scores.groupBy(row).pivot(column).agg(F.first(value))


def seed_spread(runs: DataFrame, group: str = "config", value: str = "score") -> DataFrame:
    return runs.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))


def winner(runs: DataFrame, band: float = 0.005) -> DataFrame:
    """Of rows config, val, f1, fp, place: the config with the best mean val; in it, of those within ``band`` of its best the one
    with the best f1, then the fewest fp, then the first."""
    means = runs.groupBy("config").agg(F.avg("val").alias("mean"), F.min("place").alias("first"))
    best = means.withColumn("n", F.row_number().over(Window.orderBy(F.desc("mean"), "first"))).filter("n = 1").select("config")
    top = runs.join(best, "config").withColumn("top", F.max("val").over(Window.partitionBy("config")))
    order = Window.partitionBy("config").orderBy(F.desc_nulls_last("f1"), F.asc_nulls_last("fp"), "place")
    return top.filter(F.col("top") - F.col("val") <= band).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "top")


def top_patterns(rows: DataFrame, pattern: str = "pattern", sample: str = "text", place: str = "place", k: int = 10) -> DataFrame:
    """The k commonest patterns with the first sample of each."""
    return rows.groupBy(pattern).agg(F.count("*").alias("n"), F.min_by(sample, place).alias("sample")).orderBy(F.desc("n"), pattern).limit(k)


def summary(amounts: DataFrame) -> DataFrame:
    """n, n_verified, mean confidence and counts in four confidence buckets, of rows with confidence and verified."""
    c = F.col("confidence")
    buckets = {"b0": c < 0.5, "b1": (c >= 0.5) & (c < 0.7), "b2": (c >= 0.7) & (c < 0.9), "b3": c >= 0.9}
    return amounts.agg(F.count("*").alias("n"), F.count_if("verified").alias("n_verified"), F.avg("confidence").alias("mean"), *[F.count_if(b).alias(n) for n, b in buckets.items()])


def class_histogram(amounts: DataFrame) -> DataFrame:
    """cls, n, surfaces (distinct) over the tokens of amounts."""
    each = amounts.select(F.explode("tokens").alias("t")).filter("t.cls <> 'SEP'")
    return each.groupBy(F.col("t.cls").alias("cls")).agg(F.count("*").alias("n"), F.count_distinct("t.text").alias("surfaces"))


def triage(reports: DataFrame) -> DataFrame:
    """reports (text, expected_value): whether the parse still misses it, and a gold line for it."""
    from .parse import parse_df

    out = parse_df(reports)
    same = F.exists("amounts", lambda a: a["value"] == F.col("expected_value"))
    spans = F.transform("amounts", lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["value"].alias("value")))
    return out.select("text", "expected_value", (~F.coalesce(same, F.lit(False))).alias("reproduces"), F.to_json(F.struct("text", spans.alias("spans"))).alias("gold_line"))
