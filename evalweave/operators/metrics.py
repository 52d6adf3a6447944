"""Pass metrics: deduplication policies, pass@k, rates, failure buckets, comparison of conditions, bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Fixed value: how a file name tells its condition.
CONDITION = r"\.(iso_[a-z_]+|iso|synonym_[0-9]+|deadcode)\.jsonl$"


def condition(source_file: Column) -> Column:
    """The condition that a file name tells, ``original`` if none."""
    found = F.regexp_extract(source_file, CONDITION, 1)
    return F.when(F.length(found) > 0, found).otherwise("original")


def variant(iso_applied: Column, iso_variant: Column) -> Column:
    """iso, iso_enc_only, iso_dec_only, or null for plain rows."""
    return F.when(F.coalesce(iso_applied, F.lit(False)), F.coalesce(iso_variant, F.lit("iso")))


def dedupe(df: DataFrame, key: Sequence[Column], order: Sequence[Column], policy: str = "last") -> DataFrame:
    """One row for each key: the ``first`` or ``last`` in ``order`` (ascending columns), or all with ``none``.

    Null keys are a key. Spark limits the groups before the shuffle, so a hot key costs one row a task.
    """
    if policy == "none":
        return df
    if policy not in ("first", "last"):
        raise ValueError("policy is first, last or none")
    ranked = [c.desc_nulls_last() if policy == "last" else c.asc_nulls_last() for c in order]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*ranked))).where("__rank = 1").drop("__rank")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate of passing with one of k attempts, of which c in n passed; k is cut to n."""
    tries = F.sequence(F.lit(0), F.least(n, F.lit(k)).cast("int") - 1)
    miss = F.aggregate(tries, F.lit(1.0), lambda acc, i: acc * ((n - c - i) / (n - i)))
    return F.when(n - c < F.least(n, F.lit(k)), 1.0).otherwise(1 - miss)


def per_problem(runs: DataFrame, by: Sequence[str], problem: str, passed: str) -> DataFrame:
    """n attempts and c passes of each problem. A null pass is no pass."""
    return runs.groupBy(*by, problem).agg(F.count("*").cast("int").alias("n"), F.count_if(F.coalesce(F.col(passed), F.lit(False))).cast("int").alias("c"))


def pass_rates(problems: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Means over problems of pass@k, and the raw rate over attempts."""
    scores = [F.round(F.avg(pass_at_k(F.col("n"), F.col("c"), k)), 6).alias(f"pass_at_{k}") for k in ks]
    return problems.groupBy(*by).agg(F.count("*").alias("num_problems"), F.sum("n").alias("total_samples"), F.sum("c").alias("total_passed"), *scores, F.round(F.sum("c") / F.sum("n"), 6).alias("raw_pass_rate"))


def first_and_any(runs: DataFrame, by: Sequence[str], problem: str, attempt: str, passed: str) -> DataFrame:
    """Share of problems whose attempt 0 passed (of those that have one), and of those where any passed."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    each = runs.groupBy(*by, problem).agg(F.max((F.col(attempt) == 0).cast("int")).alias("has_first"), F.max(((F.col(attempt) == 0) & ok).cast("int")).alias("first_ok"), F.max(ok.cast("int")).alias("any_ok"))
    first = F.sum("first_ok") / F.when(F.sum("has_first") > 0, F.sum("has_first"))
    return each.groupBy(*by).agg(F.count("*").alias("problems"), F.round(F.coalesce(first, F.lit(0.0)), 6).alias("pass_first"), F.round(F.avg("any_ok"), 6).alias("pass_any"))


def bucket_shares(rows: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    """Share of each bucket among the rows of its group."""
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("n"))
    return counts.select(*by, bucket, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6).alias("share"))


def error_rates(rows: DataFrame, by: Sequence[str], error: str, code: str) -> DataFrame:
    """Share of rows with an error message, and of blank code among the others."""
    blank = F.col(code).isNull() | F.coalesce(F.col(code).rlike(r"^[ \t\n\r\f]*$"), F.lit(False))
    clean = F.col(error).isNull()
    return rows.groupBy(*by).agg(F.count("*").alias("completions"), F.round(F.avg((~clean).cast("double")), 6).alias("api_error_rate"), F.round(F.avg(F.when(clean, blank.cast("double"))), 6).alias("empty_code_rate"))


def paired(scores: DataFrame, by: Sequence[str], condition_col: str, base: str, problem: str, score: str) -> DataFrame:
    """Scores of each condition beside those of ``base`` for the problems that both have."""
    left = scores.where(F.col(condition_col) == base).select(*by, problem, F.col(score).alias("base_score"))
    return scores.where(F.col(condition_col) != base).join(left, [*by, problem]).select(*by, condition_col, problem, "base_score", F.col(score).alias("cond_score"))


def bucket_deltas(shares: DataFrame, by: Sequence[str], condition_col: str, base: str, bucket: str) -> DataFrame:
    """Share of every bucket under each condition and under ``base``, 0 where a side has none, and the difference."""
    base_rows = shares.where(F.col(condition_col) == base).select(*by, bucket, F.col("share").alias("base_share"))
    others = shares.where(F.col(condition_col) != base)
    names = others.select(*by, condition_col).distinct()
    all_buckets = names.join(shares.select(*by, bucket).distinct(), list(by))
    own = others.select(*by, condition_col, bucket, F.col("share").alias("cond_share"))
    out = all_buckets.join(own, [*by, condition_col, bucket], "left").join(base_rows, [*by, bucket], "left").fillna(0.0, ["base_share", "cond_share"])
    return out.where("base_share > 0 or cond_share > 0").withColumn("delta", F.round(F.col("cond_share") - F.col("base_share"), 6))


def rate_changes(rates: DataFrame, by: Sequence[str], condition_col: str, base: str, rate: str) -> DataFrame:
    """Change of a rate under each condition against ``base``: ``by``, condition, change; only where both have one."""
    before = rates.where(F.col(condition_col) == base).select(*by, F.col(rate).alias("__base"))
    return rates.where(F.col(condition_col) != base).join(before, list(by)).select(*by, condition_col, F.round(F.col(rate) - F.col("__base"), 6).alias("change"))


def diagnosis(deltas: DataFrame, by: Sequence[str], rates: DataFrame) -> DataFrame:
    """What the changes of the buckets point to, per group, joined by semicolons.

    Interface: parse and format errors up by more than .10; inefficiency: timeouts by more than .05; algorithm: assertion
    failures by more than .10; robust: pass@k (``rates``: ``by``, change) changes by less than .05. Without a rate a group is
    not robust.
    """

    def change(*names: str) -> Column:
        return F.sum(F.when(F.col("bucket").isin(*names), F.col("delta")).otherwise(0.0))

    sums = deltas.groupBy(*by).agg(change("PARSE_ERROR", "OUTPUT_FORMAT_ERROR").alias("interface"), change("TIMEOUT").alias("timeouts"), change("ASSERTION_FAIL").alias("asserts"))
    marks = F.concat_ws("; ", F.when(F.col("interface") > 0.10, "interface"), F.when(F.col("timeouts") > 0.05, "inefficiency"), F.when(F.col("asserts") > 0.10, "algorithm"), F.when(F.abs("change") < 0.05, "robust"))
    return sums.join(rates, list(by), "left").select(*by, marks.alias("diagnosis"))


# ---- bootstrap

#: A prime below 2^31: draws are taken modulo it.
PRIME = 2147483647
#: Pairs of one group that one call weighs; larger groups are dealt into several, whose sums are added.
GROUP_PAIRS = 1 << 16


def poisson_limits(most: int = 12) -> list[int]:
    """Draws below the k-th limit stand for fewer than k + 1 events at a mean of one."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(most):
        total += term
        term /= k + 1
        out.append(round(total * PRIME))
    return out


def draw_line(*key: Column, seed: int = 42) -> tuple[Column, Column]:
    """Step and start of a key's draws: at replicate r it draws (step r + start) mod ``PRIME``. The same in every engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))
    step, start = (F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return step % (PRIME - 1) + 1, start % PRIME


def bootstrap(pairs: DataFrame, by: Sequence[str], problem: Sequence[str], replicates: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Paired resampling for groups of any size: n_problems, orig, cond, diff, ci_lo, ci_hi for each group.

    Each pair has Poisson(1) weights, one a replicate, which stand for drawing with replacement; the interval agrees with it as
    groups grow. Weights hang on seed, problem and replicate alone, not on partitions or order: draws of different problems
    are independent, and those of one problem are spread evenly over the replicates. Groups are dealt into shares of
    ``GROUP_PAIRS``, each weighed as one matrix product; what moves on is three sums a replicate and share. Null group
    keys are groups; an empty table gives an empty result.
    """
    means = pairs.groupBy(*by).agg(F.count("*").alias("n_problems"), *(F.round(100 * x, 6).alias(n) for n, x in (("orig", F.avg("base_score")), ("cond", F.avg("cond_score")), ("diff", F.avg("cond_score") - F.avg("base_score")))))
    step, start = draw_line(*(F.col(c) for c in problem), seed=seed)
    keyed = pairs.select(F.struct(*by).alias("group"), "base_score", "cond_score", step.alias("step"), start.alias("start"))
    shares = keyed.join(means.select(F.struct(*by).alias("group"), F.ceil(F.col("n_problems") / GROUP_PAIRS).alias("of")), "group")
    shares = shares.select(*(F.col(f"group.{c}").alias(c) for c in by), "base_score", "cond_score", "step", "start", F.pmod(F.xxhash64("step", "start"), F.col("of")).alias("share"))
    limits = np.array(poisson_limits())
    columns = list(by)

    def weigh(pairs_: pa.Table) -> pa.Table:
        step, start, base, cond = (pairs_.column(c).to_numpy() for c in ("step", "start", "base_score", "cond_score"))
        sums = np.zeros((3, replicates))
        values = np.stack([np.ones(len(step)), base, cond])
        r = np.arange(replicates)
        for a in range(0, len(step), 64):
            draws = (step[a : a + 64, None] * r + start[a : a + 64, None]) % PRIME
            weight = np.zeros(draws.shape, np.int8)
            for limit in limits:
                over = draws >= limit
                if not over.any():
                    break
                weight += over
            sums += values[:, a : a + 64] @ weight.astype(float)
        lists = {c: pa.ListArray.from_arrays(pa.array([0, replicates], pa.int32()), pa.array(x)) for c, x in zip("wxy", sums)}
        return pa.table({c: pairs_.column(c).slice(0, 1) for c in columns} | lists)

    schema = shares.select(*by).schema
    for c in "wxy":
        schema = schema.add(c, ArrayType(DoubleType()))
    parts = shares.groupBy(*by, "share").applyInArrow(weigh, schema)
    sums = parts.select(*by, F.posexplode(F.arrays_zip("w", "x", "y")).alias("b", "s"))
    each = sums.groupBy(*by, "b").agg(F.sum("s.w").alias("w"), F.sum("s.x").alias("x"), F.sum("s.y").alias("y")).where("w > 0")
    diff = 100 * F.col("y") / F.col("w") - 100 * F.col("x") / F.col("w")
    ci = each.groupBy(*by).agg(F.round(F.percentile(diff, F.lit(alpha / 2)), 6).alias("ci_lo"), F.round(F.percentile(diff, F.lit(1 - alpha / 2)), 6).alias("ci_hi"))
    joined = means.select(F.struct(*by).alias("group"), "n_problems", "orig", "cond", "diff").join(ci.select(F.struct(*by).alias("group"), "ci_lo", "ci_hi"), "group")
    return joined.select(*(F.col(f"group.{c}").alias(c) for c in by), "n_problems", "orig", "cond", "diff", "ci_lo", "ci_hi")


def with_significance(intervals: DataFrame) -> DataFrame:
    """Whether an interval leaves out zero, and the change relative to the base in percent."""
    relative = F.when(F.col("orig") > 0, F.round(100 * F.col("diff") / F.col("orig"), 6)).otherwise(0.0)
    return intervals.withColumn("significant", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)).withColumn("relative", relative)


def grid(intervals: DataFrame, by: Sequence[str], condition_col: str, rates: DataFrame, rate: str) -> DataFrame:
    """Every combination of the keys and conditions that occur, with its rate and, where there is one, its interval.

    ``by`` and condition, rate, ci_lo, ci_hi, shown: the rate in percent with the interval of its change, ``-`` where the
    grid has no result. The dimensions are the distinct values of each key, spread out in one row: no join.
    """
    names = (*by, condition_col)
    cells = rates.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in names))
    for c in names:
        cells = cells.withColumn(c, F.explode(c))
    found = rates.select(*by, condition_col, F.round(100 * F.col(rate), 6).alias("rate"))
    out = cells.join(found, [*by, condition_col], "left").join(intervals.select(*by, condition_col, "ci_lo", "ci_hi"), [*by, condition_col], "left")
    number = F.format_string("%.1f", F.round("rate", 1))
    interval = F.format_string(" [%+.1f, %+.1f]", F.round("ci_lo", 1), F.round("ci_hi", 1))
    return out.withColumn("shown", F.when(F.col("rate").isNull(), "-").when(F.col("ci_lo").isNull(), number).otherwise(F.concat(number, interval)))
