"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the left rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 200


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot_share: int = HOT_SHARE, counted: DataFrame | None = None) -> DataFrame:
    """Equi-join on the column ``on`` (``inner`` or ``left``), safe for hot keys of ``left``.

    Rows of ``left`` are counted by key with map-side combining. Keys above 1/``hot_share`` of all rows (by that
    definition fewer than ``hot_share`` keys, so broadcasting them is bounded) are spread over salts; only their rows of
    ``right`` are repeated, once a salt. All other keys take salt 0. Null keys never match; in a left join their rows are
    added after the join, so they don't meet in one task either. ``counted``: a table with the same keys as often as
    ``left`` has them, to be counted in its place where ``left`` is dear to compute.
    """
    if how == "left":
        matched = salted_join(left.where(F.col(on).isNotNull()), right, on, "__left", hot_share, counted)
        return matched.unionByName(left.where(F.col(on).isNull()), allowMissingColumns=True)
    how = "left" if how == "__left" else how
    counted = left if counted is None else counted
    total = counted.count()
    if total == 0:
        return left.join(right, on, how)
    hot_rows = max(1, total // hot_share)
    hot = (
        counted.where(F.col(on).isNotNull())
        .groupBy(on)
        .count()
        .where(F.col("count") > hot_rows)
        .select(F.col(on).alias("__hot"), F.ceil(F.col("count") / hot_rows).cast("int").alias("__salts"))
    )
    spread = left.join(F.broadcast(hot), F.col(on) == F.col("__hot"), "left").withColumn("__salt", _salt(left, F.col("__salts")))
    copies = right.join(F.broadcast(hot), F.col(on) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))))
    return spread.drop("__hot", "__salts").join(copies.drop("__hot", "__salts"), [on, "__salt"], how).drop("__salt")


def _salt(df: DataFrame, salts: Column) -> Column:
    plain = [F.col(f"`{n}`") for n, t in df.dtypes if not t.startswith(("map", "variant"))]
    return F.when(salts.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*plain), salts).cast("int"))
