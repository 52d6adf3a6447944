"""Messages delivered more than once: keep exactly one copy of each.

Identifiers are split by their aggregated frequency (map-side combined counts). The only copy of an identifier passes
directly; only rows of repeated identifiers are ranked; the union of both is the result, over stored and new messages
together. The rank is cut at 1 by a window group limit, which Spark applies before the shuffle as well, so an identifier
that holds a third of all rows reaches its task as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.session import table


def split_by_frequency(messages: DataFrame, key: Sequence[Column], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(row ids of messages whose identifier occurs once, rows of repeated identifiers).

    The rows are told apart by the unique column ``row_id``, which no identifier can skew.
    """
    names = [f"__k{i}" for i in range(len(key))]
    keyed = messages.select("*", *(k.alias(n) for k, n in zip(key, names)))
    single = keyed.groupBy(*names).agg(F.count("*").alias("__n"), F.min(row_id).alias("__only")).where("__n = 1").select(F.col("__only").alias(row_id))
    return single, keyed.join(single, row_id, "left_anti")


def _best(repeated: DataFrame, names: list[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*names).orderBy(*order)
    return repeated.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank", *names)


def exactly_once(new: DataFrame, key: Sequence[Column], order: Sequence[Column], row_id: str, stored: DataFrame | None = None, has_key: Column | None = None) -> DataFrame:
    """The messages of ``stored`` and ``new`` with one copy of each identifier, the first in ``order``.

    ``key`` are the parts of the identifier; a null part equals a null part. Rows for which ``has_key`` is not true have no
    identifier and all stay. Ties in ``order`` leave one copy all the same. An empty table gives an empty result. Columns
    that only one of the tables has are null in the rows of the other; names starting with ``__`` are reserved.
    """
    everything = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
    known = F.lit(True) if has_key is None else F.coalesce(has_key, F.lit(False))
    named = everything.where(known)
    names = [f"__k{i}" for i in range(len(key))]
    single, repeated = split_by_frequency(named, key, row_id)
    passed = named.join(single, row_id, "left_semi")
    return passed.unionByName(_best(repeated, names, order)).unionByName(everything.where(~known))


def surplus(new: DataFrame, key: Sequence[Column], order: Sequence[Column], row_id: str, stored: DataFrame | None = None, has_key: Column | None = None) -> DataFrame:
    """The rows that ``exactly_once`` drops. Rows are told apart by ``row_id``."""
    everything = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
    named = everything if has_key is None else everything.where(has_key)
    names = [f"__k{i}" for i in range(len(key))]
    _, repeated = split_by_frequency(named, key, row_id)
    best = _best(repeated, names, order).select(row_id)
    return repeated.drop(*names).join(best, row_id, "left_anti")


def result_key() -> list[Column]:
    """The identifier of a test result: one completion of one row of a source file."""
    return [F.col("dataset"), F.col("model"), F.col("source_file"), F.col("row_index"), F.coalesce("completion_index", F.lit(0))]


def latest() -> list[Column]:
    """The order in which deliveries are preferred."""
    return [F.desc_nulls_last("received_at"), F.desc_nulls_last("delivery_id")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surplus deliveries of unittest_results."""
    rows = table(spark, sf_dir, "unittest_results").select("delivery_id", "received_at", "dataset", "model", "source_file", "row_index", "completion_index")
    return surplus(rows, result_key(), latest(), "delivery_id", has_key=F.col("row_index").isNotNull()).select("delivery_id")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per completion, over stored and new deliveries together (here: odd and even delivery ids)."""
    rows = table(spark, sf_dir, "unittest_results").select("delivery_id", "received_at", "dataset", "model", "source_file", "row_index", "completion_index", "pass", "status")
    is_new = F.col("delivery_id") % 2 == 0
    kept = exactly_once(rows.where(is_new), result_key(), latest(), "delivery_id", stored=rows.where(~is_new), has_key=F.col("row_index").isNotNull())
    return kept.select("delivery_id", "dataset", "model", "source_file", "row_index", "completion_index", "pass", "status")


_RANKED = """select *, row_number() over (partition by dataset, model, source_file, row_index, coalesce(completion_index, 0)
  order by received_at desc nulls last, delivery_id desc) rn from unittest_results where row_index is not null"""

SQL = {
    "p1_found": f"select delivery_id from ({_RANKED}) x where rn > 1",
    "p1_kept": f"""select delivery_id, dataset, model, source_file, row_index, completion_index, pass, status from ({_RANKED}) x where rn = 1
union all select delivery_id, dataset, model, source_file, row_index, completion_index, pass, status from unittest_results where row_index is null""",
}
QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept}
