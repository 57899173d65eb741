"""Amounts of a stream: parsing has no state, so a stream is parsed as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import dedup_key
from ..operators.parse import parse_df


def parse_stream(stream: DataFrame, column: str = "text", **options) -> DataFrame:
    return parse_df(stream, column, **options)


def distinct_lines(stream: DataFrame, time: str, delay: str, column: str = "text") -> DataFrame:
    """The first line of each key within the watermark."""
    return stream.withWatermark(time, delay).withColumn("_key", dedup_key(F.col(column))).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_totals(stream: DataFrame, time: str, delay: str, window: str, column: str = "text") -> DataFrame:
    """window, unit, n, total of amounts by event time."""
    rows = parse_df(stream.withWatermark(time, delay), column, "_a").select(time, F.inline("_a"))
    return rows.groupBy(F.window(time, window), "unit").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def write_amounts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
