"""Isotonic calibration of confidences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_ENDS = [0.0, 1.0]


def pav(values: Sequence[float], weights: Sequence[float] | None = None) -> list[float]:
    """The nondecreasing sequence nearest to values in weighted squares; equal neighbours pool."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights or [1.0] * len(values)):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return [v for v, _, n in blocks for _ in range(n)]


def fit_isotonic(records: DataFrame, raw: str = "raw", outcome: str = "correct", digits: int = 6) -> tuple[list[float], list[float]]:
    """Scores and fitted values; ties pool first, so what is collected is a row per distinct rounded score."""
    rows = records.filter(F.col(raw).isNotNull()).groupBy(F.round(raw, digits).alias("x")).agg(F.avg(F.col(outcome).cast("double")).alias("y"), F.count("*").alias("n")).orderBy("x").collect()
    return [r["x"] for r in rows], pav([r["y"] for r in rows], [r["n"] for r in rows])


def fit_breakpoints(xs: Sequence[float], ys: Sequence[float], most: int = 32) -> tuple[list[float], list[float]]:
    """Knots at the middles of constant blocks and at the ends, thinned to ``most`` where they deviate least."""
    if not xs:
        return _ENDS, _ENDS
    if len(xs) == 1:
        return _ENDS, [ys[0]] * 2
    knots, a = [], 0
    for b in range(1, len(xs) + 1):
        if b == len(xs) or ys[b] != ys[a]:
            knots.append(((xs[a] + xs[b - 1]) / 2, ys[a]))
            a = b
    if knots[0][0] > xs[0]:
        knots.insert(0, (xs[0], ys[0]))
    if knots[-1][0] < xs[-1]:
        knots.append((xs[-1], ys[-1]))
    while len(knots) > max(2, most):
        off = [abs(p[1] + (n[1] - p[1]) * (k[0] - p[0]) / (n[0] - p[0]) - k[1]) for p, k, n in zip(knots, knots[1:], knots[2:])]
        del knots[off.index(min(off)) + 1]
    out_x, out_y = [knots[0][0]], [knots[0][1]]
    for x, y in knots[1:]:
        if x > out_x[-1]:
            out_x.append(x)
            out_y.append(max(y, out_y[-1]))
    return out_x, out_y


def interpolate(raw: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear through the knots, flat beyond them."""
    out = F.lit(float(ys[-1]))
    for x0, y0, x1, y1 in reversed(list(zip(xs, ys, xs[1:], ys[1:]))):
        out = F.when(raw <= x1, F.lit(float(y0)) + F.lit(float(y1 - y0)) * (raw - F.lit(float(x0))) / F.lit(float(x1 - x0))).otherwise(out)
    return F.when(raw.isNull(), F.lit(None).cast("double")).when(raw <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def calibrate(raw: Column, knots: tuple[Sequence[float], Sequence[float]] | None = None) -> Column:
    """Null stays null; without knots a score is clamped to 0 to 1."""
    if knots is None:
        return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
    return interpolate(raw, *knots)


def reliability(records: DataFrame) -> DataFrame:
    """tier, bin, n, precision, spurious of all, verified and unverified records in ten bins, the last closed."""
    binned = records.withColumn("bin", F.least(F.floor(F.col("raw") * 10), F.lit(9)).cast("int"))
    tier = F.when(F.grouping("verified") == 1, "all").when(F.col("verified"), "verified").otherwise("unverified")
    grouped = binned.groupingSets([("bin",), ("bin", "verified")], "bin", "verified")
    return grouped.agg(tier.alias("tier"), F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("precision"), F.avg(F.col("spurious").cast("double")).alias("spurious")).select("tier", "bin", "n", "precision", "spurious")
