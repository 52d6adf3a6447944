"""Dataset rewriting: adapters bring the test sets of all datasets to one shape, transforms rewrite them with proof."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.code import split_assert
from evalweave.functions.integers import Transform, append_contract, encode_only_contract, exact, roundtrip_proof

#: One shape for the tests of all datasets.
TESTS = "array<struct<kind:string,input:string,output:string>>"


def _of_kind(kind: str) -> Column:
    pairs = F.coalesce(F.col(f"tests.{kind}"), F.array().cast("array<struct<input:string,output:string>>"))
    return F.transform(pairs, lambda t: F.struct(F.lit(kind).alias("kind"), t["input"].alias("input"), t["output"].alias("output")))


@dataclass(frozen=True)
class Adapter:
    """Where a dataset keeps its prompt, tests and id."""

    name: str
    prompt: str
    problem_id: str
    row_index: str
    starter: str | None = None

    def tests(self) -> Column:
        """All tests of a row, in order, as ``TESTS``; null test sets as none."""
        if self.name == "bigobench":
            kinds = [_of_kind(k) for k in ("public_tests", "private_tests", "generated_tests")]
            return F.concat(*kinds).cast(TESTS)
        if self.name == "effibench":
            listed = F.from_json("generated_tests", "array<struct<input:string,output:string>>")
            return F.transform(F.coalesce(listed, F.array().cast("array<struct<input:string,output:string>>")), lambda t: F.struct(F.lit("generated").alias("kind"), t["input"].alias("input"), t["output"].alias("output"))).cast(TESTS)
        parts = F.transform(F.coalesce(F.col("test_list"), F.array().cast("array<string>")), lambda t: F.struct(split_assert(t).alias("a"), t.alias("t")))
        return F.transform(parts, lambda x: F.struct(F.lit("assert").alias("kind"), F.when(x["a"]["function"] != "", x["a"]["args"]).otherwise(x["a"]["call"]).alias("input"), x["a"]["expected"].alias("output"))).cast(TESTS)


ADAPTERS = {
    "bigobench": Adapter("bigobench", "description", "problem_id", "solution_no"),
    "effibench": Adapter("effibench", "prompt", "id", "_src_line", "starter_code_python3"),
    "mbpp": Adapter("mbpp", "prompt", "task_id", "task_id"),
}


def map_tests(tests: Column, t: Transform, inputs: bool = True) -> Column:
    """Tests with rewritten outputs, and inputs unless only outputs are to be encoded."""
    return F.transform(tests, lambda x: F.struct(x["kind"].alias("kind"), (t.forward(x["input"]) if inputs else x["input"]).alias("input"), t.forward(x["output"]).alias("output")))


def map_tests_exactly(tests: Column, t: Transform, inputs: bool = True) -> Column:
    """The same by Python's integers, for tests with long runs of digits."""
    ins = F.transform(tests, lambda x: x["input"])
    both = F.arrays_zip(tests.alias("t"), (exact(ins, t) if inputs else ins).alias("i"), exact(F.transform(tests, lambda x: x["output"]), t).alias("o"))
    return F.transform(both, lambda x: F.struct(x["t"]["kind"].alias("kind"), x["i"].alias("input"), x["o"].alias("output")))


def rewrite_assert(test: Column, t: Transform, args: Column | None = None, expected: Column | None = None) -> Column:
    """An assert with arguments and expected value rewritten; other text stays. ``args`` and ``expected``: these two as
    rewritten by ``exact``, for asserts with long runs of digits."""
    a = split_assert(test)
    args, expected = t.forward(a["args"]) if args is None else args, t.forward(a["expected"]) if expected is None else expected
    call = F.when(a["function"] != "", F.concat(a["function"], F.lit("("), args, F.lit(")"))).otherwise(a["call"])
    return F.when((a["call"] != "") & (a["expected"] != ""), F.concat(F.lit("assert "), call, F.lit(" == "), expected)).otherwise(test)


def rewrite_asserts(df: DataFrame, test: str, out: str, t: Transform) -> DataFrame:
    """``df`` with ``out``: the assert ``test`` rewritten, exact for integers of any length."""
    long = t.is_long(F.col(test))
    a = split_assert(F.col(test))
    rows = df.where(long).withColumn("__pair", exact(F.array(a["args"], a["expected"]), t))
    return df.where(~long).withColumn(out, rewrite_assert(F.col(test), t)).unionByName(rows.withColumn(out, rewrite_assert(F.col(test), t, F.col("__pair")[0], F.col("__pair")[1])).drop("__pair"))


def io_samples(tests: Column) -> Column:
    """All inputs and outputs in order, without nulls."""
    return F.filter(F.flatten(F.transform(tests, lambda x: F.array(x["input"], x["output"]))), lambda s: s.isNotNull())


def decoded_examples(plain: Column, encoded: Column, n: int = 2, width: int = 120) -> Column:
    """A block with the first inputs that changed, encoded and plain; empty if none did."""
    pairs = F.filter(F.arrays_zip(plain.alias("p"), encoded.alias("e")), lambda x: (x["p"]["input"] != x["e"]["input"]) & (F.length(x["p"]["input"]) > 0))

    def cut(s: Column) -> Column:
        return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit(" ..."))).otherwise(s)

    shown = F.transform(F.slice(pairs, 1, n), lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n  Encoded:  "), cut(x["e"]["input"]), F.lit("\n  Decoded:  "), cut(x["p"]["input"])))
    # Fixed value: the wording.
    head = "### Decoded-Input Examples\nBelow are example decoded inputs so you can verify your decoding.\nApply the same decoding to all test inputs; return ONLY encoded outputs.\n\n"
    return F.when(F.size(pairs) > 0, F.concat(F.lit(head), F.array_join(shown, "\n"))).otherwise("")


def rewrite_dataset(df: DataFrame, adapter: Adapter, t: Transform, seed: int, mode: str = "iso", most_chars: int | None = None) -> DataFrame:
    """``df`` with prompt_with_contract, tests_transformed, iso_applied, iso_family, iso_seed, iso_params, iso_variant, iso_proof.

    ``mode``: ``iso`` encodes inputs and outputs; ``iso_enc_only`` outputs only; ``iso_dec_only`` encodes both and shows
    decoded examples. Rows whose tests have more than ``most_chars`` characters pass unchanged, with iso_applied false.
    Rows with integers too long for expressions take the exact way; all others are one narrow projection in the JVM. No row
    is dropped; the proof is over what was done to the row.
    """
    rows = df.withColumn("__tests", adapter.tests())
    long = F.exists(io_samples(F.col("__tests")), lambda s: t.is_long(s))
    if not t.long_run:
        return _rewritten(rows, df.columns, adapter, t, seed, mode, most_chars, False)
    return _rewritten(rows.where(~long), df.columns, adapter, t, seed, mode, most_chars, False).unionByName(_rewritten(rows.where(long), df.columns, adapter, t, seed, mode, most_chars, True))


def _rewritten(rows: DataFrame, columns: list[str], adapter: Adapter, t: Transform, seed: int, mode: str, most_chars: int | None, long: bool) -> DataFrame:
    samples = io_samples(F.col("__tests"))
    size = F.aggregate(samples, F.lit(0), lambda a, s: a + F.length(s))
    fits = F.lit(True) if most_chars is None else size <= most_chars
    if long:
        rows = rows.withColumn("__new", map_tests_exactly(F.col("__tests"), t, mode != "iso_enc_only"))
        rows = rows.withColumn("__forward", exact(F.slice(samples, 1, 10), t))
        rows = rows.withColumn("__back", exact(F.col("__forward"), t, back=True))
        proof = roundtrip_proof(samples, t, forward=F.col("__forward"), inverse=F.col("__back"))
    else:
        rows = rows.withColumn("__new", map_tests(F.col("__tests"), t, mode != "iso_enc_only"))
        proof = roundtrip_proof(samples, t)
    new = F.col("__new")
    contract = encode_only_contract(t) if mode == "iso_enc_only" else t.contract()
    prompt = append_contract(F.coalesce(F.col(adapter.prompt), F.lit("")), contract)
    if mode == "iso_dec_only":
        help_text = decoded_examples(F.col("__tests"), new)
        prompt = F.concat(prompt, F.when(help_text != "", F.concat(F.lit("\n"), help_text)).otherwise(""))
    params = F.create_map(*(x for k, v in t.params.items() for x in (F.lit(k), F.lit(str(v))))) if t.params else F.create_map().cast("map<string,string>")
    return rows.select(
        *columns,
        F.when(fits, prompt).otherwise(F.col(adapter.prompt)).alias("prompt_with_contract"),
        F.when(fits, new).otherwise(F.col("__tests")).alias("tests_transformed"),
        fits.alias("iso_applied"), F.lit(t.name).alias("iso_family"), F.lit(seed).cast("bigint").alias("iso_seed"),
        params.alias("iso_params"), F.lit(mode).alias("iso_variant"), proof.alias("iso_proof"),
    )


def only_rewritten(rows: DataFrame, original: bool = False) -> DataFrame:
    """Rows whose rewriting was applied; of the ``original`` data set all rows, since the filter is none of it."""
    return rows if original else rows.where(F.coalesce(F.col("iso_applied"), F.lit(False)))


def rewrite_counters(rewritten: DataFrame, by: str) -> DataFrame:
    """Rows, rewritten ones, proven ones and oversized ones per ``by``, and in total (null)."""
    return rewritten.rollup(by).agg(F.count("*").alias("total"), F.count_if("iso_applied").alias("iso_applied"), F.count_if(F.col("iso_proof.roundtrip_ok")).alias("roundtrip_ok"), F.count_if(~F.col("iso_applied")).alias("skipped_large"))
