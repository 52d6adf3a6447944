"""Operation distributions: centroids, Jensen-Shannon divergence, comparison of conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histograms(rows: DataFrame, by: Sequence[str], solution: str, op: str) -> DataFrame:
    """Share of each operation within its solution: ``by``, solution, op, p. Null operations are left out."""
    counts = rows.where(F.col(op).isNotNull()).groupBy(*by, solution, op).agg(F.count("*").alias("n"))
    return _shares(counts, by, solution, op)


def histograms_from_maps(rows: DataFrame, by: Sequence[str], solution: str, ops: str) -> DataFrame:
    """The same from a map of counts for each solution; null and empty maps are left out."""
    counts = rows.select(*by, solution, F.explode(ops).alias("op", "n")).where("n > 0")
    return _shares(counts, by, solution, "op")


def _shares(counts: DataFrame, by: Sequence[str], solution: str, op: str) -> DataFrame:
    return counts.select(*by, solution, F.col(op).alias("op"), (F.col("n") / F.sum("n").over(Window.partitionBy(*by, solution))).alias("p"))


def centroids(shares: DataFrame, by: Sequence[str], solution: str, least_solutions: int = 1) -> DataFrame:
    """Mean share of each operation over all solutions of a group, absent ones as zero: ``by``, op, q, n_solutions."""
    sizes = shares.groupBy(*by).agg(F.count_distinct(solution).alias("n_solutions")).where(F.col("n_solutions") >= least_solutions)
    sums = shares.groupBy(*by, "op").agg(F.sum("p").alias("sum_p"))
    return sums.join(sizes, list(by)).select(*by, "op", (F.col("sum_p") / F.col("n_solutions")).alias("q"), "n_solutions")


def mean_divergence(shares: DataFrame, centers: DataFrame, by: Sequence[str], solution: str) -> DataFrame:
    """Mean Jensen-Shannon divergence (base 2) of a group's solutions from their centroid, with sizes.

    Only operations that a solution has are joined: an absent one adds q/2, so all of them together add half of what the
    present ones leave of the centroid.
    """
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    each = shares.join(centers, [*by, "op"]).groupBy(*by, solution).agg((F.sum(0.5 * p * F.log2(p / m) + 0.5 * q * F.log2(q / m)) + 0.5 * (1 - F.sum(q))).alias("d"))
    vocabulary = centers.groupBy(*by).agg(F.count("*").alias("vocabulary"))
    return each.groupBy(*by).agg(F.count("*").alias("n_solutions"), F.round(F.avg(F.greatest(F.coalesce(F.nanvl("d", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))), 6).alias("jsd")).join(vocabulary, list(by))


def cross_divergence(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Divergence and distance of two centroids of each group that both sides have: ``by``, cross_jsd, cross_l2.

    Operations of one side only count as zero on the other; both sides are scaled to sum to one.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        total = F.sum("q").over(Window.partitionBy(*by))
        return df.select(*by, "op", (F.col("q") / total).alias(name))

    common = left.select(*by).distinct().join(right.select(*by).distinct(), list(by))
    both = side(left, "p").join(side(right, "r"), [*by, "op"], "full_outer").fillna(0.0, ["p", "r"]).join(common, list(by), "left_semi")
    p, r = F.col("p"), F.col("r")
    m = (p + r) / 2
    part = F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0) + F.when(r > 0, 0.5 * r * F.log2(r / m)).otherwise(0.0)
    return both.groupBy(*by).agg(F.round(F.greatest(F.sum(part), F.lit(0.0)), 6).alias("cross_jsd"), F.round(F.sqrt(F.sum((p - r) * (p - r))), 6).alias("cross_l2"))
