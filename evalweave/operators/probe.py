"""Contamination probing by likelihood shift: samples, contexts, scoring, scores per dataset, separation of seen and unseen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.text import strip
from evalweave.operators.skew import salted_join
from evalweave.session import materialize


def hash_order(text: Column, seed: int) -> Column:
    """A key that puts texts into an order that depends on seed and text only."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), text), 256)


def hash_sample(texts: DataFrame, text: str, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``n`` first texts in hash order, per group. A top-n: groups are cut to n before the shuffle."""
    if not by:
        return texts.orderBy(hash_order(F.col(text), seed), text).limit(n)
    window = Window.partitionBy(*by).orderBy(hash_order(F.col(text), seed), text)
    return texts.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def capped_scan(rows: DataFrame, position: str, keep: Column, cap: int, n: int) -> DataFrame:
    """Of the first ``cap`` rows by position those that ``keep``, and of these the first ``n``: in this order."""
    head = rows.orderBy(position).limit(max(cap, n))
    return head.where(keep).orderBy(position).limit(n)


#: Texts of a stretch of a ring.
STRETCH = 4096


def contexts(pool: DataFrame, by: Sequence[str], row_id: str, text: str, k: int, seeds: int, seed: int) -> DataFrame:
    """``k`` other texts of the group for every text and seed: ``by``, row_id, seed, place, context_id.

    For each seed the distinct texts of a group are put in a ring by hash, and a text's contexts are the k after it: n log n
    instead of the pairs of a group, and never the text itself or a copy of it (equal 128-bit hashes). context_id is the
    smallest id of the texts that equal the context. Groups with k texts or fewer give all others. Only ids and hashes are
    moved. Rings are cut into stretches of about ``STRETCH`` texts (up to 256 of them), so a group may be of any size; the
    result does not hang on the cuts. Null groups are groups; blank texts have no place in a ring.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("seed").cast("string"), F.col("__text")))
    named = pool.where(F.length(strip(F.col(text))) > 0).select(F.struct(*by).alias("group"), F.col(row_id).alias("id"), F.col(text).alias("__text"), F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    places = materialize(named.select("group", "id", "seed", hashed.alias("h")))
    ring = places.groupBy("group", "seed", "h").agg(F.min("id").alias("rep"))
    parts = places.groupBy("group", "seed").agg(F.least(F.ceil(F.count("*") / STRETCH), F.lit(256)).alias("parts"))
    number = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")  # rises with the hash
    ring = ring.join(parts, ["group", "seed"]).withColumn("stretch", F.shiftright(number * F.col("parts"), 32)).drop("parts")
    inside = Window.partitionBy("group", "seed", "stretch").orderBy("h")
    ahead = ring.select("*", *(F.lead("rep", j).over(inside).alias(f"c{j}") for j in range(1, k + 1)), F.row_number().over(inside).alias("r"))
    # The ends of a stretch go on with the heads of the stretches that follow: at most k + 1 ids of each stretch.
    heads = ahead.where(F.col("r") <= k + 1).groupBy("group", "seed").agg(F.array_sort(F.collect_list(F.struct("stretch", "r", "rep"))).alias("heads"))
    own = F.array_compact(F.array(*(F.col(f"c{j}") for j in range(1, k + 1))))
    closed = ahead.where(F.col(f"c{k}").isNotNull()).select("group", "seed", "h", own.alias("cs"))
    ends = ahead.where(F.col(f"c{k}").isNull()).select("group", "seed", "h", "stretch", "rep", own.alias("own")).join(heads, ["group", "seed"])
    after = F.concat(F.filter("heads", lambda x: x["stretch"] > F.col("stretch")), F.filter("heads", lambda x: x["stretch"] <= F.col("stretch")))
    more = F.filter(F.transform(after, lambda x: x["rep"]), lambda i: (i != F.col("rep")) & ~F.array_contains("own", i))
    ends = ends.select("group", "seed", "h", F.slice(F.concat("own", more), 1, k).alias("cs"))
    chosen = closed.unionByName(ends).select(F.struct("group", "seed", "h").alias("place_key"), "cs")
    rows = salted_join(places.select("id", F.struct("group", "seed", "h").alias("place_key")), chosen, "place_key")
    out = rows.select(*(F.col(f"place_key.group.{c}").alias(c) for c in by), F.col("id").alias(row_id), F.col("place_key.seed").alias("seed"), F.posexplode("cs").alias("place", "context_id"))
    return out


def with_context_text(chosen: DataFrame, pool: DataFrame, row_id: str, text: str) -> DataFrame:
    """The result of ``contexts`` with the texts of the contexts as ``context``; ids are unique in ``pool``."""
    return salted_join(chosen, pool.select(F.col(row_id).alias("context_id"), F.col(text).alias("context")), "context_id")


def token_counts(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """How often each word occurs in its group: ``by``, token, n."""
    words = texts.select(*by, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_]+"), F.lit(0))).alias("token"))
    return words.groupBy(*by, "token").agg(F.count("*").alias("n"))


def unigram_scores(rows: DataFrame, by: Sequence[str], row_id: str, text: str, chosen: DataFrame, weight: float = 0.3) -> DataFrame:
    """Mean log-probabilities of each text with and without its contexts: ``by``, row_id, seed, base_mean, icl_mean.

    ``chosen`` is the result of ``contexts`` over ``rows``, whose ids are unique. The offline stand-in for a scoring model:
    without context a word has its smoothed frequency in the whole table, with context a mixture of that and its frequency
    in the context. Words are counted once a text and serve as text and as context; only words that a text shares with
    its contexts move a second time. Frequent words, and texts that are the context of many copies, are salted.
    """
    found = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_]+"), F.lit(0)))
    words = materialize(rows.select(F.col(row_id).alias("id"), found.alias("token")).groupBy("id", "token").agg(F.count("*").alias("k")))
    corpus = words.groupBy("token").agg(F.sum("k").alias("cn"))
    size = corpus.agg(F.sum("cn").alias("total"), F.count("*").alias("vocab"))
    prob = materialize(corpus.join(F.broadcast(size)).select("token", ((F.col("cn") + 1) / (F.col("total") + F.col("vocab"))).alias("p")))
    scored = materialize(salted_join(words, prob, "token").select("id", "token", "k", "p"))
    away = F.log((1 - weight) * F.col("p"))
    own = materialize(scored.groupBy("id").agg(F.sum(F.col("k") * F.log("p")).alias("plain"), F.sum(F.col("k") * away).alias("away"), F.sum("k").alias("n")))
    links = materialize(chosen.select(*by, F.col(row_id).alias("id"), "seed", "context_id"))
    totals = links.join(own.select(F.col("id").alias("context_id"), F.col("n").alias("xn")), "context_id").groupBy(*by, "id", "seed").agg(F.sum("xn").alias("xtotal"))
    shown = salted_join(links.select("id", "seed", "context_id"), words.withColumnRenamed("id", "context_id"), "context_id").groupBy("id", "seed", "token").agg(F.sum("k").alias("xn"))
    both = scored.join(shown, ["id", "token"]).join(totals.select("id", "seed", "xtotal"), ["id", "seed"])
    gain = both.groupBy("id", "seed").agg(F.sum(F.col("k") * (F.log(weight * F.col("xn") / F.col("xtotal") + (1 - weight) * F.col("p")) - away)).alias("gain"))
    out = totals.join(own, "id").join(gain, ["id", "seed"], "left")
    return out.select(*by, F.col("id").alias(row_id), "seed", (F.col("plain") / F.col("n")).alias("base_mean"), ((F.col("away") + F.coalesce("gain", F.lit(0.0))) / F.col("n")).alias("icl_mean"))


def shifts(scores: DataFrame, by: Sequence[str], row_id: str) -> DataFrame:
    """Mean over seeds of the shift that context brings to each text."""
    return scores.groupBy(*by, row_id).agg(F.avg(F.col("icl_mean") - F.col("base_mean")).alias("delta"), F.avg("base_mean").alias("base_mean"), F.avg("icl_mean").alias("icl_mean"), F.count("*").alias("n_seeds"))


def contamination(deltas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of texts that context makes less likely (strictly), and how many texts there are."""
    return deltas.groupBy(*by).agg(F.round(F.avg((F.col("delta") < 0).cast("double")), 6).alias("score"), F.count("*").alias("n_samples"), F.round(F.avg("delta"), 6).alias("mean_delta"))


def mean_logprob(values: Column, ignored: int = 0) -> Column:
    """Mean of an array of log-probabilities; the first ``ignored`` are left out where more follow. Nulls don't count."""
    kept = F.filter(F.when(F.size(values) > ignored, F.slice(values, F.lit(ignored + 1), F.greatest(F.size(values) - ignored, F.lit(0)))).otherwise(values), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def auc(scores: DataFrame, by: Sequence[str], score: str, seen: str, buckets: int = 256) -> DataFrame:
    """Probability that a seen score exceeds an unseen one, ties as half; null where a side is empty.

    By counts of distinct scores and running sums, so linear in the scores; no pairs are formed. The scores of a group are
    cut into ``buckets`` stretches of equal width, ranked in each, and the stretches are summed up, so that no group has to
    be ordered in one task. Null scores and null sides are left out; null groups are groups.
    """
    rows = scores.where(F.col(score).isNotNull() & F.col(seen).isNotNull())
    keys = [F.col(c) for c in by] or [F.lit(0)]
    names = [f"__g{i}" for i in range(len(keys))]
    levels = rows.groupBy(*(k.alias(n) for k, n in zip(keys, names)), F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(seen)).alias("a"), F.count_if(~F.col(seen)).alias("b"))
    ends = levels.groupBy(*(F.col(n).alias(f"e{n}") for n in names)).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"e{n}"))
    placed = levels.join(ends, same).select(*names, "s", "a", "b", F.coalesce(F.try_divide((F.col("s") - F.col("lo")) * buckets, F.col("hi") - F.col("lo")), F.lit(0.0)).cast("int").alias("bucket"))
    inside = Window.partitionBy(*names, "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("lower", F.coalesce(F.sum("b").over(inside), F.lit(0)))
    stretches = ranked.groupBy(*names, "bucket").agg(F.sum(F.col("a") * (F.col("lower") + F.col("b") / 2)).alias("wins"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    below = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("lower", F.coalesce(F.sum("b").over(below), F.lit(0)))
    sums = stretches.groupBy(*names).agg(F.sum(F.col("wins") + F.col("a") * F.col("lower")).alias("wins"), F.sum("a").alias("n_seen"), F.sum("b").alias("n_unseen"))
    return sums.select(*(F.col(n).alias(c) for n, c in zip(names, by)), "n_seen", "n_unseen", F.round(F.when((F.col("n_seen") > 0) & (F.col("n_unseen") > 0), F.col("wins") / (F.col("n_seen") * F.col("n_unseen"))), 8).alias("auc"))


def separation(scores: DataFrame, by: Sequence[str], score: str, seen: str) -> DataFrame:
    """Means and ends of seen and unseen scores in percent, and the gap between the lowest seen and the highest unseen."""
    s = 100 * F.col(score)
    yes, no = F.when(F.col(seen), s), F.when(~F.col(seen), s)
    return scores.groupBy(*by).agg(
        F.round(F.avg(yes), 6).alias("seen_mean"), F.round(F.min(yes), 6).alias("seen_min"), F.round(F.avg(no), 6).alias("unseen_mean"), F.round(F.max(no), 6).alias("unseen_max"), F.round(F.min(yes) - F.max(no), 6).alias("separation_gap")
    )


def ignore_window(base_tokens: Column, icl_tokens: Column, ignored: int = 10, short: int = 20, least: int = 3) -> Column:
    """How many first tokens of a comparison are left out: ``ignored``, but where a side has fewer than ``short`` tokens a
    quarter of the shorter side, ``least`` at most."""
    fewer = F.least(F.size(base_tokens), F.size(icl_tokens))
    return F.when(fewer < short, F.least(F.lit(least), F.floor(fewer / 4).cast("int"))).otherwise(ignored)


def token_differences(rows: DataFrame, keep: Sequence[str], base: str, icl: str) -> DataFrame:
    """The token-difference experiment: ``keep``, place, token, base, icl, diff, cumulative.

    ``base`` and ``icl`` are arrays of (token, logprob) of one text without and with context. Both lose the first tokens of the
    ignore window (a side that is no longer than it loses none) and are compared as far as the shorter goes. Null arrays
    give no rows. The running sum is taken inside the row.
    """
    window = ignore_window(F.col(base), F.col(icl))

    def after(side: str) -> Column:
        return F.when(F.size(side) > window, F.slice(side, window + 1, F.greatest(F.size(side) - window, F.lit(0)))).otherwise(F.col(side))

    n = F.least(F.size("__a"), F.size("__b"))
    steps = F.transform(F.arrays_zip(F.slice("__a", F.lit(1), n).alias("a"), F.slice("__b", F.lit(1), n).alias("b")), lambda x, i: F.struct(i.alias("place"), x["b"]["token"].alias("token"), x["a"]["logprob"].alias("base"), x["b"]["logprob"].alias("icl")))
    cut = rows.where(F.col(base).isNotNull() & F.col(icl).isNotNull()).select(*keep, after(base).alias("__a"), after(icl).alias("__b"))
    each = cut.select(*keep, F.inline(steps)).withColumn("diff", F.col("icl") - F.col("base"))
    running = Window.partitionBy(*keep).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*keep, "place", "token", "base", "icl", F.round("diff", 6).alias("diff"), F.round(F.sum("diff").over(running), 6).alias("cumulative"))


def box_summary(scores: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """What a box plot shows of each group: n, low and high whisker, quartiles, and the outliers beyond 1.5 quartile ranges.

    Quartiles are interpolated; whiskers are the outermost scores inside the range; null scores are left out.
    """
    rows = scores.where(F.col(score).isNotNull()).select(F.struct(*by).alias("group"), F.col(score).cast("double").alias("s"))
    quarter = rows.groupBy("group").agg(*(F.percentile("s", F.lit(q)).alias(f"q{k}") for k, q in ((1, 0.25), (2, 0.5), (3, 0.75))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("s") >= F.col("q1") - reach) & (F.col("s") <= F.col("q3") + reach)
    joined = rows.join(quarter, "group").groupBy("group", "q1", "q2", "q3").agg(F.count("*").alias("n"), F.min(F.when(inside, F.col("s"))).alias("low"), F.max(F.when(inside, F.col("s"))).alias("high"), F.count_if(~inside).alias("outliers"))
    return joined.select(*(F.col(f"group.{c}").alias(c) for c in by), "n", *(F.round(c, 6).alias(c) for c in ("low", "q1", "q2", "q3", "high")), "outliers")


def cumulative_difference(base: DataFrame, other: DataFrame, by: Sequence[str], position: str, value: str, ignored: int = 0) -> DataFrame:
    """Running sum of other minus base along the positions that both have, from ``ignored`` on."""
    joined = base.select(*by, position, F.col(value).alias("x")).join(other.select(*by, position, F.col(value).alias("y")), [*by, position]).where(F.col(position) >= ignored)
    running = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*by, position, F.round(F.col("y") - F.col("x"), 6).alias("diff"), F.round(F.sum(F.col("y") - F.col("x")).over(running), 6).alias("cumulative"))
