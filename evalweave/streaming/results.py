"""Structured Streaming over result records: deduplication within a watermark, running and windowed pass rates.

An extension: results arrive over hours, some twice and some late. The same plans run on a batch table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON Lines files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def first_deliveries(rows: DataFrame, time: str, key: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """The first delivery of each key; state is kept for ``delay`` after the latest time seen."""
    marked = rows.withWatermark(time, delay)
    return marked.dropDuplicatesWithinWatermark(list(key)) if rows.isStreaming else rows.dropDuplicates(list(key))


def windowed_rates(rows: DataFrame, time: str, by: Sequence[str], passed: str, width: str = "1 hour", slide: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """Results and pass rate per window and group; a window closes ``delay`` after its end (None: a watermark is set)."""
    marked = rows.withWatermark(time, delay) if rows.isStreaming and delay else rows
    window = F.window(time, width, slide) if slide else F.window(time, width)
    ok = F.coalesce(F.col(passed), F.lit(False)).cast("double")
    out = marked.groupBy(window.alias("w"), *by).agg(F.count("*").alias("results"), F.round(F.avg(ok), 6).alias("pass_rate"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "results", "pass_rate")


def running_rates(rows: DataFrame, by: Sequence[str], passed: str) -> DataFrame:
    """Results and pass rate per group so far (update mode)."""
    return rows.groupBy(*by).agg(F.count("*").alias("results"), F.avg(F.coalesce(F.col(passed), F.lit(False)).cast("double")).alias("pass_rate"))
