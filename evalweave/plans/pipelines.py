"""The stages as jobs: rewrite, generate, test, report, probe. ``spark-submit evalweave/plans/pipelines.py STAGE ...``"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.code import BUCKETS, assemble_prompt, compose_script, compose_submission, prompt_with_fallback, stable_id
from evalweave.functions.integers import transform
from evalweave.functions.text import context_text
from evalweave.operators import probe as P
from evalweave.operators import tasks as K
from evalweave.operators.rewriting import ADAPTERS, Adapter, only_rewritten, rewrite_dataset
from evalweave.plans.providers import CompletionProvider, EchoProvider, HashLogprobs, HttpCompletions, LogprobProvider, Retrying, generate, in_rounds, run_test_lists, run_tests, score
from evalweave.sources import sinks

MODES = ("iso", "iso_enc_only", "iso_dec_only")


def with_report(adapter: Adapter, report: dict | None) -> Adapter:
    """An adapter that takes its prompt from the field a schema report recommends, if it does."""
    wanted = ((report or {}).get("recommended") or {}).get("prompt_field")
    return replace(adapter, prompt=wanted) if wanted else adapter


def first_rows(rows: DataFrame, position: str, max_rows: int | None) -> DataFrame:
    """Rows of the first physical lines; blank and bad lines count."""
    return rows if max_rows is None else rows.where(F.col(position) < max_rows)


def first_problems(tasks: DataFrame, order: Sequence[str], max_problems: int | None) -> DataFrame:
    """The tasks of the first problems that have a prompt."""
    return tasks if max_problems is None else tasks.orderBy(*order).limit(max_problems)


def problem_id(dataset: Column, given: Column, source_file: Column, row_index: Column) -> Column:
    """The id under which conditions are compared: by row for mbpp, whose own ids are no text."""
    return F.when(dataset == "mbpp", F.concat(F.lit("mbpp_"), row_index.cast("string"))).otherwise(stable_id(given, source_file, row_index))


def selected_tests(iso: Column, transformed: Column, original: Column) -> Column:
    """The encoded tests of a rewritten row, if it has any, else the original ones."""
    return F.when(F.coalesce(iso, F.lit(False)) & (F.size(transformed) > 0), transformed).otherwise(original)


def build_tasks(rows: DataFrame, dataset: str, adapter: Adapter, model: str, completions: int, done: DataFrame | None = None, iso: bool = False, max_problems: int | None = None) -> DataFrame:
    """One row for each completion still to be generated. ``rows`` have source_file and row_index besides the dataset's columns.

    Problems without a prompt are left out, as no task can be made of them.
    """
    prompt = prompt_with_fallback(*(F.col(c) for c in dict.fromkeys(["prompt_with_contract" if iso else adapter.prompt, adapter.prompt]) if c in rows.columns))
    ready = rows.withColumn("__p", prompt).where(F.col("__p.prompt") != "")
    ready = first_problems(ready, ("source_file", "row_index"), max_problems)
    starter = F.col(adapter.starter) if adapter.starter else None
    tests = F.col("test_list") if "test_list" in rows.columns else None
    tasks = ready.select(
        F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), F.lit(completions).alias("n_generations"),
        problem_id(F.lit(dataset), F.col(adapter.problem_id).cast("string"), F.col("source_file"), F.col("row_index")).alias("problem_id"),
        "source_file", "row_index", assemble_prompt(F.col("__p.prompt"), F.lit(iso), starter, tests).alias("prompt_used"), F.lit(not iso).alias("is_original"), F.create_map(F.lit("prompt_source"), F.col("__p.source")).alias("row_meta"),
    )
    tasks = K.fan_out(tasks, completions)
    return tasks if done is None else K.pending(tasks, done, ("problem_id", "completion_index"))


def bucket_position(bucket: Column) -> Column:
    """Place of a failure bucket in reports; unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, BUCKETS)), bucket)
    return F.when(at > 0, at).otherwise(len(BUCKETS) + 1)


def same_sample_size(scores: DataFrame, n_samples: int) -> DataFrame:
    """Scores of runs with as many samples; 0 keeps all."""
    return scores if n_samples == 0 else scores.where(F.col("n_samples") == n_samples)


def first_successes(rows: DataFrame, by: Sequence[str], order: Column, ok: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each group that succeeded."""
    from pyspark.sql import Window

    good = rows.where(ok)
    return good.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__rank") <= n).drop("__rank")


def probe(texts: DataFrame, by: Sequence[str], row_id: str, text: str, provider: LogprobProvider, n_samples: int, k: int = 3, seeds: int = 1, seed: int = 42, ignored: int = 0) -> DataFrame:
    """Shift of each sampled text under contexts of its own dataset, by a scoring provider: ``by``, row_id, delta, means.

    Texts are taken in hash order until ``n_samples`` of them could be scored, ten times as many being tried.
    """
    tried = P.hash_sample(texts.where(F.length(F.trim(text)) > 0), text, 10 * n_samples, seed, by)
    base = score(tried.select(*by, row_id, text), text, None, provider).select(*by, row_id, P.mean_logprob(F.col("logprobs.logprob"), ignored).alias("base_mean"))
    chosen = P.with_context_text(P.contexts(tried, by, row_id, text, k, seeds, seed), tried, row_id, text)
    shown = chosen.groupBy(*by, row_id, "seed").agg(F.array_sort(F.collect_list(F.struct("place", "context"))).alias("cs"))
    full = tried.join(shown, [*by, row_id]).select(*by, row_id, "seed", text, context_text(F.transform("cs", lambda x: x["context"]), F.col(text)).alias("full"))
    icl = score(full, "full", text, provider).select(*by, row_id, "seed", P.mean_logprob(F.col("logprobs.logprob"), ignored).alias("icl_mean"))
    found = P.shifts(icl.join(base, [*by, row_id]).where("icl_mean is not null and base_mean is not null"), by, row_id)
    ranked = found.join(tried.select(*by, row_id, P.hash_order(F.col(text), seed).alias("h")), [*by, row_id])
    return first_successes(ranked, by, F.col("h"), F.lit(True), n_samples).drop("h")


def family_summary(scores: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per model and corpus family: AUC, means and gap of its seen and unseen sources. ``scores``: model, source, score."""
    rows = scores.join(catalogue, "source")
    return P.auc(rows, ("model", "family"), "score", "is_seen").join(P.separation(rows, ("model", "family"), "score", "is_seen"), ["model", "family"])


#: What a record of a test result holds.
RESULT = ("dataset", "model", "temperature", "problem_id", "completion_index", "source_file", "row_index", "iso_family", "iso_seed", "iso_params", "status", "pass", "error", "time_s", "timeout")


def test_records(rows: DataFrame, dataset: str, timeout_s: float = 10.0, done: DataFrame | None = None, allow: bool = False) -> DataFrame:
    """Results of testing the answers of one data set, without those already ``done`` (problem_id, completion_index).

    ``rows`` are answers beside the columns of their problem: bigobench ones have tests (public, private, generated), run in
    order until one fails; effibench ones a starter and a runner, mbpp ones imports and asserts, run as one script. Columns
    of a record that ``rows`` lack are null.
    """
    todo = rows if done is None else K.pending(rows, done, ("problem_id", "completion_index"))
    if dataset == "bigobench":
        out = run_test_lists(todo.withColumn("__tests", ADAPTERS[dataset].tests()), "generated_solution", "__tests", timeout_s, allow=allow)
    else:
        answer = F.coalesce("generated_solution", F.lit(""))
        script = compose_submission(answer, F.col("starter_code_python3"), F.coalesce("test_runner_python3", F.lit(""))) if dataset == "effibench" else compose_script(answer, F.col("test_imports"), F.col("test_list"))
        out = run_tests(todo.withColumn("__script", F.when(F.length(F.trim(answer)) > 0, script)), "__script", timeout_s=timeout_s, allow=allow)
        out = out.withColumn("pass", F.col("status") == "success").withColumn("timeout", F.col("status") == "timeout")
    out = out.withColumn("dataset", F.lit(dataset))
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in RESULT))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("stage", choices=("rewrite", "generate", "test", "report", "probe"))
    parser.add_argument("--input", required=True, help="a Parquet table")
    parser.add_argument("--output", required=True)
    parser.add_argument("--dataset", choices=sorted(ADAPTERS), default="effibench")
    parser.add_argument("--family", default="affine_int")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--completions", type=int, default=5)
    parser.add_argument("--max-problems", type=int)
    parser.add_argument("--only-rewritten", action="store_true", help="generate only for rows whose rewriting was applied")
    parser.add_argument("--url", help="a chat-completions server; offline completions without it")
    parser.add_argument("--model", default="offline")
    parser.add_argument("--key-variable", help="environment variable of the workers that holds the server's key")
    parser.add_argument("--rounds", type=int, default=1, help="shares in which completions are generated and appended")
    parser.add_argument("--timeout", type=float, default=10.0)
    parser.add_argument("--allow-run", action="store_true", help="the test stage runs code from the data; only in a sandbox")
    parser.add_argument("--dry-run", action="store_true", help="print the plan and three rows, write nothing")
    mode = parser.add_mutually_exclusive_group()
    mode.add_argument("--encode-only", action="store_true")
    mode.add_argument("--decode-only", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"evalweave {args.stage}").getOrCreate()
    rows = spark.read.parquet(args.input)
    adapter = ADAPTERS[args.dataset]
    if args.stage == "rewrite":
        out = rewrite_dataset(rows, adapter, transform(args.family, args.seed), args.seed, "iso_enc_only" if args.encode_only else "iso_dec_only" if args.decode_only else "iso")
    elif args.stage == "generate":
        if args.only_rewritten:
            rows = only_rewritten(rows)
        rows = rows.withColumn("row_index", F.col(adapter.row_index).cast("bigint"))
        rows = rows if "source_file" in rows.columns else rows.withColumn("source_file", F.lit(args.dataset))
        provider: CompletionProvider = Retrying(HttpCompletions(args.url, args.model, key_variable=args.key_variable)) if args.url else EchoProvider()
        tasks = build_tasks(rows, args.dataset, adapter, args.model, args.completions, max_problems=args.max_problems, iso=args.only_rewritten)
        if args.rounds > 1 and not args.dry_run:
            in_rounds(tasks, ("problem_id", "completion_index"), args.rounds, lambda t: generate(t, "prompt_used", provider), lambda t: sinks.write_jsonl(t, args.output, append=True))
            return
        out = generate(tasks, "prompt_used", provider)
    elif args.stage == "test":
        out = test_records(rows, args.dataset, args.timeout, allow=args.allow_run)
    elif args.stage == "probe":
        out = P.contamination(probe(rows.select(F.lit(args.dataset).alias("dataset"), F.col(adapter.row_index).alias("row_id"), F.col(adapter.prompt).alias("text")), ("dataset",), "row_id", "text", HashLogprobs(), 100), ("dataset",))
    else:
        out = rows.groupBy("dataset", "model", "status").agg(F.count("*").alias("n"))
    if args.dry_run:
        out.explain("formatted")
        out.limit(3).show()
    else:
        sinks.write_jsonl(out, args.output)


if __name__ == "__main__":
    main()
