"""Source files that do not parse: derivative parsing of every text, with an exact check of what it rejects.

One narrow pass: no shuffle, no driver work. ``derivative.parse`` gives the verdict on each text and names the failing token.
Only texts that hold constructs outside its grammar (``beyond``) are put to Python's own parser; how many these are is part of
the rates.
"""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.derivative import Outcome, parse
from evalweave.session import spread, table

FIELDS = ("generated_solution", "generated_solution_clean")


def check(text: str) -> tuple[bool, Outcome]:
    """Whether a text is a valid module, and what the derivative parser found."""
    out = parse(text)
    if not out.beyond:
        return out.valid, out
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True, out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False, out


def parse_outcomes(df: DataFrame, keep: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each text of ``fields`` that is not blank: ``keep``, field_name, valid, failure, token, line, beyond.

    failure is null for valid texts, ``truncated`` where all tokens fit and the text may not end there, else ``invalid``
    with the number (from 0) and the line (from 1) of the failing token. Nulls and blank texts give no row; repeated rows
    give repeated rows; texts of any length are parsed whole; columns not named in ``keep`` are ignored.
    """
    src = spread(df.select(*keep, *fields))
    out_schema = src.select(*keep).schema.add("field_name", "string").add("valid", "boolean").add("failure", "string").add("token", "integer").add("line", "integer").add("beyond", "boolean")

    def run(batches):
        for batch in batches:
            for field in fields:
                rows, found = [], []
                for k, text in enumerate(batch.column(field).to_pylist()):
                    if text is not None and text.strip():
                        rows.append(k)
                        found.append(check(text))
                at = pa.array(rows, pa.int64())
                failed = [None if ok else "truncated" if o.truncated else "invalid" for ok, o in found]
                hit = [f == "invalid" and o.token >= 0 for f, (_, o) in zip(failed, found)]
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(c).take(at) for c in keep}
                    | {
                        "field_name": pa.array([field] * len(rows), pa.string()),
                        "valid": pa.array([ok for ok, _ in found], pa.bool_()),
                        "failure": pa.array(failed, pa.string()),
                        "token": pa.array([o.token if h else None for h, (_, o) in zip(hit, found)], pa.int32()),
                        "line": pa.array([o.line if h else None for h, (_, o) in zip(hit, found)], pa.int32()),
                        "beyond": pa.array([bool(o.beyond) for _, o in found], pa.bool_()),
                    }
                )

    return src.mapInArrow(run, out_schema)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of generations that are no valid Python module."""
    return parse_outcomes(table(spark, sf_dir, "generations"), ["generation_id"]).where("not valid").select("generation_id", "field_name")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, invalid and truncated ones, and the invalid share, per repository (dataset, source file), language and field."""
    spelled = F.lower(F.trim(F.element_at("row_meta", "language")))
    language = F.when(spelled.isin("py", "python", "python3"), "python").otherwise(spelled)
    df = table(spark, sf_dir, "generations").withColumn("language", language)
    found = parse_outcomes(df, ["dataset", "source_file", "language"])
    return found.groupBy("dataset", "source_file", "language", "field_name").agg(
        F.count("*").alias("texts"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("failure") == "truncated").alias("truncated"), F.count_if("beyond").alias("by_interpreter"), F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("invalid_share")
    )
