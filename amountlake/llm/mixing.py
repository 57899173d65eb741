"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's key is ``-ln(u) / quality``, with u uniform from a hash of its doc_id; in key order the
documents of a source are a weighted sample without replacement.  A source whose target is several
times its size first gives that many complete epochs; the rest of the target is filled in key order
by a prefix sum of sizes.

The prefix sum needs no sort of a source.  Keys fall into slices of equal probability, and sizes are
summed by (source, slice); running sums over these few rows find the slices of each source near which
the budget ends: from the one it ends in to the first that is sure to lie beyond what the passes below may reach.
Documents of earlier slices are in, of later ones out; only those between are
sorted: ``per_slice`` of them on average, and as many more as hold four times the words of the source's largest
document.  So the result does not depend on ``per_slice``.  There a document too large for what is left is skipped,
twice at most, so that the sum comes near the budget.  A source with a third of all rows is split like any other.

Targets: sources, in code-point order with null last, get ``weights`` in turn and share ``share`` of
all sizes; a target stops at ``most`` times its source's size and the excess goes to the others by weight.
With sources sorted by cap over weight that is one running sum over the table of sources (one row each).

Defined results: a null or empty text has size 0 and is never taken; with no sizes at all every
target is 0.  A null doc_id takes u from its text.  Rows that tie in key, id and text are alike in all
they show.  Repeated rows are sampled together, each counted; if the budget ends among them, some are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize

JUNK = "%&*$#!@^~|<>{}="


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """1 for text without junk symbols, falling to 1/21 for nothing else."""
    n = F.length(text)
    return F.coalesce((n + 1) / (n + 1 + 20 * (n - F.length(F.translate(text, JUNK, "")))), F.lit(1.0))


def uniform(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """In (0, 1), from 48 bits of an md5 of seed and doc_id, or of the text's md5 where there is no doc_id."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), named))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size -> + weight, target.  One row per source in, one out."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    df = df.withColumns(
        {
            "total": F.sum("source_size").over(every) * F.lit(float(share)),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("capped")) / F.col("left")
    df = df.withColumn("level", F.when(F.col("cap") > level * F.col("weight"), level))
    df = df.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return df.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _slice(key: Column, n: Column) -> Column:
    """Slices of the key's range, even under exponential keys, in key order."""
    return F.least(F.floor((1 - F.exp(-key)) * n), n - 1).cast("long")


def _fill(rows: DataFrame, passes: int = 3) -> DataFrame:
    """Add ``more``: 1 for the rows that fill the budget ``rest`` from ``before`` on, in key order.

    Where a document would overrun, a pass skips it and the next goes on behind it; in the last
    pass the document that the budget ends in is taken if at least half of it fits.
    """
    group = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "_t")
    running = group.rowsBetween(Window.unboundedPreceding, 0)
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"more": F.lit(0), "open": F.col("size") > 0})
    for turn in range(passes):
        spent = F.col("before") + F.sum(F.col("more") * F.col("size")).over(every)
        rows = rows.withColumn("upto", spent + F.sum(F.when(F.col("open"), F.col("size")).otherwise(0)).over(running))
        need = F.col("upto") - (F.col("size") / 2.0 if turn == passes - 1 else 0)
        rows = rows.withColumn("fits", F.col("open") & (need <= F.col("rest")))
        rows = rows.withColumn("over", F.sum(F.when(F.col("open") & ~F.col("fits"), 1).otherwise(0)).over(running))
        rows = rows.withColumn("more", F.when(F.col("fits"), 1).otherwise(F.col("more")))
        rows = rows.withColumn("open", F.col("open") & ~F.col("fits") & (F.col("over") > 1))
    return rows.drop("open", "upto", "fits", "over")


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    return -F.log(uniform(doc_id, text, seed)) / text_quality(text)


class Plan:
    """What a mix decides: ``goal`` has a row per source, ``near`` the documents that were sorted."""

    def __init__(self, docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, per_slice: int) -> None:
        text = F.col("text").cast("string")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_size(text).alias("size"), _key(F.col("doc_id"), text, seed).alias("key"), F.xxhash64(text).alias("_t"))
        self.rows = materialize(rows, "sizes")
        sources = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"), F.ceil(F.count("*") / per_slice).alias("n"))
        sources = materialize(sources, "sources")
        goal = source_targets(sources.select("source", "source_size"), weights, share, most)
        epochs = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) + 1e-12)
        goal = goal.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
        goal = goal.join(sources.select(F.col("source").alias("_s"), "largest", "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        goal = materialize(goal, "targets")
        sums = self.rows.join(_of(goal.select("source", "n")), F.col("source").eqNullSafe(F.col("_s")))
        sums = sums.groupBy("source", _slice(F.col("key"), F.col("n")).alias("slice")).agg(F.sum("size").alias("in_slice"))
        before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("in_slice").over(before), F.lit(0)))
        sums = sums.join(_of(goal.select("source", "rest", "largest")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        ends = (F.col("rest") > 0) & (F.col("before") + F.col("in_slice") > F.col("rest")) & (F.col("before") < F.col("rest") + 4 * F.col("largest"))
        edges = sums.filter(ends).groupBy("source").agg(F.min("slice").alias("low"), F.max("slice").alias("high"), F.min("before").alias("before"))
        #: slices below ``low`` are in where there is a rest; with no slice the budget ends in, all of them are
        full = F.when(F.col("rest") > 0, F.col("n")).otherwise(0)
        goal = goal.join(_of(edges), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        self.goal = materialize(goal.withColumns({"low": F.coalesce("low", full), "high": F.coalesce("high", F.lit(-1))}), "plan")
        placed = self.place(self.rows)
        near = _fill(placed.filter("edge").select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", "before", "key", "_t"))
        self.near = materialize(near, "near")

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows with source and key: + what the source's plan is, and whether the row is ``sure`` to be in or was sorted (``edge``)."""
        placed = rows.join(_of(self.goal), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        at = _slice(F.col("key"), F.col("n"))
        return placed.withColumns({"sure": at < F.col("low"), "edge": (at >= F.col("low")) & (at <= F.col("high"))})


def _of(sources: DataFrame) -> DataFrame:
    return sources.withColumnRenamed("source", "_s")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 0, per_slice: int = 20_000) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of documents."""
    plan = Plan(docs, weights, share, most, seed, per_slice)
    sure = plan.place(plan.rows).filter(~F.col("edge")).withColumn("more", F.col("sure").cast("int"))
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs", "more"]
    both = sure.select(*columns).unionByName(plan.near.select(*columns))
    both = both.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("more")).otherwise(0).cast("long"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 0, per_slice: int = 20_000) -> DataFrame:
    """The rows of documents the mix takes, each as often as it is taken.

    The plan of each source says for most documents whether they are in, so documents are not shuffled: only those
    that were sorted meet their own rows again.
    """
    plan = Plan(docs, weights, share, most, seed, per_slice)
    text = F.col("text").cast("string")
    full = text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), "source", text.alias("text")).filter(full)
    rows = plan.place(rows.withColumn("key", _key(F.col("_id"), F.col("text"), seed)))
    sure = rows.filter(~F.col("edge")).select("_row", (F.col("epochs") + F.col("sure").cast("int")).alias("copies"))
    # rows that agree in id and text are taken a number of times in all, which each of them carries a share of
    order = ["_d", "_h"]
    taken = plan.near.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_h"), F.col("source").alias("_from")).agg(F.sum("more").alias("_more"), F.count("*").alias("_rows"))
    nth = F.row_number().over(Window.partitionBy(*order, "_from").orderBy("_d"))
    near = rows.filter("edge").withColumn("_t", F.xxhash64("text")).join(taken, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_from")))
    more = F.when(F.col("_more") == F.col("_rows"), 1).otherwise((nth <= F.col("_more")).cast("int"))
    near = near.withColumn("more", more).select("_row", (F.col("epochs") + F.col("more")).alias("copies"))
    every = sure.unionByName(near).filter("copies > 0")
    return every.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("_row.*")
