"""JSON Lines: reading with stable line numbers and account of bad lines, and the layout of result folders."""

from __future__ import annotations

import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Every physical line of text files: source_file, row_index (from 0, blank lines counted), raw.

    Splits of a file are numbered by the offset of their block and the order inside it; the numbers of lines before a split
    come from one small aggregation, so no file has to pass through one task.
    """
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), F.col("value").alias("raw"))
    numbered = rows.withColumn("place", F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("part", F.shiftright("mid", 33))
    # A partition may hold several blocks, so a block's first place is subtracted.
    blocks = numbered.groupBy("path", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", "first", before.alias("before"))
    return numbered.join(starts, ["path", "block"]).select("path", "source_file", (F.col("before") + F.col("mid") - F.col("first")).alias("row_index"), "raw")


def read_records(spark: SparkSession, schema: StructType | str, *paths: str) -> DataFrame:
    """Parsed lines with ``source_file`` and ``row_index``; blank and malformed lines are left out, but keep their numbers."""
    lines = read_lines(spark, *paths)
    parsed = lines.where(F.length(F.trim("raw")) > 0).withColumn("r", F.from_json("raw", schema, {"mode": "PERMISSIVE"})).where(F.try_parse_json("raw").isNotNull())
    return parsed.select("source_file", "row_index", "r.*")


def line_account(lines: DataFrame, raw: str = "raw", by: str = "source_file") -> DataFrame:
    """Lines, blank lines and malformed lines of each file."""
    blank = F.length(F.trim(raw)) == 0
    return lines.groupBy(by).agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & F.try_parse_json(raw).isNull()).alias("malformed"))


def read_all(spark: SparkSession, schema: StructType | str, *paths: str) -> DataFrame:
    """All records of many files as one bag; columns that a file lacks are null. Blank and malformed lines give no record;
    ``line_account`` over ``read_lines`` counts them."""
    return read_records(spark, schema, *paths)


def point_lookup(wanted: DataFrame, records: DataFrame, key: Sequence[str] = ("source_file", "row_index")) -> DataFrame:
    """Records at given places."""
    return wanted.join(records, list(key), "left")


def resume_keys(spark: SparkSession, path: str, key: Sequence[str] = ("problem_id", "completion_index"), skip_failed: bool = False) -> DataFrame:
    """Keys of results written so far; none if nothing is there yet. ``skip_failed`` leaves out rows with an error message."""
    schema = ", ".join(f"{k} {'int' if k.endswith('index') else 'string'}" for k in key)
    try:
        rows = spark.read.schema(schema + ", error_message string").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return (rows.where("error_message is null") if skip_failed else rows).select(*key).distinct()


# ---- places, resolved on the driver


def dataset_files(root: str, dataset: str) -> list[str]:
    """The JSON Lines files of a dataset in name order: its folder in any case, with or without ``original`` below."""
    base = Path(root)
    if not base.is_dir():
        return []
    folder = next((p for p in sorted(base.iterdir()) if p.is_dir() and p.name.lower() == dataset.lower()), None)
    if folder is None:
        return []
    inner = folder / "original"
    return sorted(str(p) for p in (inner if inner.is_dir() else folder).glob("*.jsonl"))


def variant_files(root: str, dataset: str, source_file: str, variant: str | None) -> str | None:
    """The file of a variant of a dataset file, with or without ``.iso`` in its name; null if there is none."""
    base = Path(root)
    folder = next((p for p in sorted(base.iterdir()) if p.is_dir() and p.name.lower() == dataset.lower()), None) if base.is_dir() else None
    if folder is None:
        return None
    names = [source_file, source_file.replace(".iso.jsonl", ".jsonl"), source_file.replace(".jsonl", ".iso.jsonl")]
    places = [folder / variant] if variant else [folder / "original", folder]
    return next((str(p / n) for p in places for n in names if (p / n).is_file()), None)


def result_models(root: str, leave_out: Sequence[str] = ("reports", "plots")) -> list[str]:
    """Models with results: the folders below ``root``."""
    return sorted(p.name for p in Path(root).iterdir() if p.is_dir() and p.name not in leave_out) if os.path.isdir(root) else []


def output_path(root: str, model: str, dataset: str, variant: str | None, source_file: str, temperature: float, completions: int) -> str:
    """Where generations of a source file are written."""
    import re

    safe = re.sub(r"[^0-9A-Za-z_\-.]", "_", model)
    folder = f"{dataset}_{variant}" if variant else dataset
    return f"{root}/{safe}/{folder}/generations/{Path(source_file).stem}__temp{temperature}__n{completions}.jsonl"


def load_config(path: str) -> dict:
    """A YAML configuration."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def schema_report(spark: SparkSession, path: str) -> DataFrame:
    """A schema report (one JSON object)."""
    return spark.read.option("multiLine", True).json(path)


def probe_results(spark: SparkSession, root: str) -> DataFrame:
    """Scores of probe runs: model_key, dataset, type, score, n_samples.

    Files of single datasets come first; a model without any has those of its summary. Broken files and null scores are
    left out.
    """
    schema = "model string, dataset string, type string, score double, n_samples int, scores array<struct<Dataset:string,Type:string,Score:double>>, _corrupt_record string"
    files = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/*.json").withColumn("path", F.input_file_name())
    files = files.withColumn("model_key", F.element_at(F.split("path", "/"), -2)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    single = files.where("name <> 'summary.json' and score is not null").select("model_key", "dataset", "type", "score", "n_samples")
    summary = files.where("name = 'summary.json'").select("model_key", "n_samples", F.inline("scores")).select("model_key", F.col("Dataset").alias("dataset"), F.col("Type").alias("type"), F.col("Score").alias("score"), "n_samples")
    return single.unionByName(summary.join(single.select("model_key").distinct(), "model_key", "left_anti").where("score is not null"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with header."""
    return spark.read.option("header", True).schema(schema).csv(path)
