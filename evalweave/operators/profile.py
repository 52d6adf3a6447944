"""Schema profiles of JSON records: presence, types, samples and candidate fields, in the JVM by VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import is_natural_language, test_field_reasons
from evalweave.operators.drift import json_type


def records(rows: DataFrame, by: Sequence[str], raw: str) -> DataFrame:
    """One row for each key of each JSON object: ``by``, key, value (VARIANT). Lines that are no object give none."""
    parsed = rows.select(*by, F.try_parse_json(raw).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).where("key is not null").select(*by, "key", "value")


def profile(rows: DataFrame, by: Sequence[str], raw: str) -> DataFrame:
    """Per key and JSON type: occurrences, and the shortest and longest of strings."""
    fields = records(rows, by, raw).withColumn("json_type", F.coalesce(json_type(F.schema_of_variant("value")), F.lit("null")))
    length = F.when(F.col("json_type") == "string", F.length(F.col("value").cast("string")))
    return fields.groupBy(*by, "key", "json_type").agg(F.count("*").alias("n"), F.min(length).alias("min_length"), F.max(length).alias("max_length"))


def samples(rows: DataFrame, by: Sequence[str], raw: str, order: Sequence[str], n: int = 3, width: int = 200) -> DataFrame:
    """The first ``n`` values of each key in ``order``, cut to ``width``; null values are no samples."""
    from pyspark.sql import Window

    fields = records(rows, [*by, *order], raw).where(F.schema_of_variant("value") != "VOID").withColumn("text", F.col("value").cast("string"))
    window = Window.partitionBy(*by, "key").orderBy(*order)
    cut = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    return fields.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n).select(*by, "key", "place", cut.alias("sample"))


def candidates(rows: DataFrame, by: Sequence[str], raw: str, position: str, first: int = 5) -> DataFrame:
    """Keys that look like prompts or tests in the ``first`` records of each group (a profiling rule of the format), with
    the reasons and in how many groups."""
    fields = records(rows.where(F.col(position) < first), by, raw)
    text = F.try_variant_get("value", "$", "string")
    found = fields.select(*by, "key", F.coalesce(is_natural_language(text), F.lit(False)).alias("prompt"), test_field_reasons(F.col("key"), text).alias("reasons"))
    each = found.groupBy(*by, "key").agg(F.max(F.col("prompt").cast("int")).alias("prompt"), F.array_sort(F.collect_set(F.when(F.length("reasons") > 0, F.col("reasons")))).alias("reasons"))
    return each.groupBy("key").agg(F.sum("prompt").alias("prompt_groups"), F.count_if(F.size("reasons") > 0).alias("test_groups"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))), " | ").alias("reasons"))
