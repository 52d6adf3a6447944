"""Task fan-out with resumable results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fan_out(problems: DataFrame, completions: int) -> DataFrame:
    """Every problem once for each completion index: a narrow explode, no join."""
    return problems.withColumn("completion_index", F.explode(F.sequence(F.lit(0), F.lit(completions - 1))))


def done_keys(results: DataFrame, key: Sequence[str], failed: Column | None = None) -> DataFrame:
    """Keys of finished results; with ``failed``, rows for which it holds don't count as finished."""
    kept = results if failed is None else results.where(~F.coalesce(failed, F.lit(False)))
    return kept.select(*key).distinct()


def pending(tasks: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Tasks without a finished result. Tasks with a null in the key are always pending."""
    return tasks.join(done, list(key), "left_anti")


def passed_only(generations: DataFrame, results: DataFrame, key: Sequence[str], passed: str) -> DataFrame:
    """Generations of which a result passed."""
    return generations.join(results.where(F.coalesce(F.col(passed), F.lit(False))).select(*key).distinct(), list(key), "left_semi")


def with_lookup(rows: DataFrame, lookup: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with the columns of a lookup table, null where it has none. The table must have one row a key."""
    return rows.join(lookup, list(key), "left")


def first_problems(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in order."""
    return rows.orderBy(*order).limit(n)


def tallies(results: DataFrame, by: Sequence[str], status: str, error: str) -> DataFrame:
    """Completed, failed and retried rows per group."""
    from evalweave.functions.code import is_retryable

    return results.groupBy(*by).agg(F.count("*").alias("completed"), F.count_if(F.col(status) != "success").alias("failed"), F.count_if(is_retryable(F.col(error))).alias("retryable"))
