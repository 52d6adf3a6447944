"""Column functions against plain Python and hand-made values."""

import random

import pytest
from pyspark.sql import functions as F

from evalweave.functions import code as C
from evalweave.functions import integers as I
from evalweave.functions import text as T

PIECES = ["0", "1", "27", "9", "-", ".", " ", "x", "\n", "12", "-8", ",", "[", "]", "007", "99999999999", "1" * 40]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("name,seed", [("affine_int", 42), ("affine_int", 1), ("cubic_int", 42), ("base_conv", 1), ("delimiter_rewrite", 0), ("delimiter_rewrite", 1), ("delimiter_rewrite", 42), ("identity", 0)])
def test_transforms_equal_python(spark, name, seed):
    t = I.transform(name, seed)
    df = spark.createDataFrame([(x,) for x in [*texts(), None, ""]], "t string")
    for back in (False, True):
        for r in I.apply_transform(df, "t", "out", t, back).collect():
            assert r.out == (None if r.t is None else t.python(r.t, back)), (name, back, r.t)


@pytest.mark.parametrize("name", ["affine_int", "cubic_int", "basek_int"])
def test_roundtrip_of_many_integers(spark, name):
    t = I.transform(name, 42)
    df = spark.range(-5000, 5000).select(F.col("id").cast("string").alias("s"))
    assert df.where(t.inverse(t.forward(F.col("s"))) != F.col("s")).count() == 0


def test_sampled_parameters_and_micro_values():
    assert I.sample_params("affine_int", 42) == {"a": 2, "b": -94} and I.sample_params("affine_int", 1) == {"a": 3, "b": 45}
    assert I.sample_params("cubic_int", 42) == {"c": 31} and I.sample_params("delimiter_rewrite", 42) == {"style": 2}
    t = I.transform("affine_int", params={"a": 2, "b": 3})
    assert t.python("5-3 1.5 is 12. x7 -7 007") == "13-9 1.5 is 12. x17 -11 17"
    assert I.transform("basek_int", 1).python("42") == "66" and I.transform("basek_int", 1).python("66 255", True) == "42 255"
    assert I.transform("cubic_int", params={"c": 31}).python("156 157", True) == "5 157"
    with pytest.raises(ValueError):
        I.transform("nothing", 1)


def test_proof_and_contracts(spark):
    t = I.transform("affine_int", params={"a": 2, "b": 3})
    df = spark.createDataFrame([(["1 2", "007"],), (["5"] * 12,), (None,)], "s array<string>")
    proofs = [r.p for r in df.select(I.roundtrip_proof(F.col("s"), t).alias("p")).collect()]
    assert [p.roundtrip_ok for p in proofs] == [False, True, True] and [p.n_checked for p in proofs] == [2, 10, 0] and len(proofs[1].examples) == 5
    assert "x' = 2*x + 3" in t.contract() and "x' - 3) / 2" in t.contract()
    got = spark.range(1).select(I.append_contract(F.lit("p"), "C").alias("a"), I.with_examples("C", F.array(F.lit("it's\n")), F.array(F.lit("x" * 90))).alias("b"), I.python_repr(F.lit("a\\b'\"")).alias("r")).first()
    assert got.a == "p\n\nC" and got.b == f"C\nConcrete examples from this problem:\n- Sample input 1: \"it's\\n\"\n- Sample output 1: {('x' * 80 + '...')!r}\n" and got.r == repr("a\\b'\"")


def test_chunks_and_cleaning(spark):
    one = spark.createDataFrame([("ab " * 500,), ("",), (None,)], "t string")
    rows = one.select(T.char_chunks(F.col("t")).alias("c"), T.word_chunks(F.col("t")).alias("w"), T.strip_html(F.lit("<p>a  <b>b</b></p>")).alias("h")).collect()
    assert [len(c) for c in rows[0].c] == [599, 599] and len(rows[0].w) == 5 and rows[0].h == "a b"
    assert rows[1].c == [] and rows[1].w == []


def test_match_score_and_alignment(spark):
    df = spark.createDataFrame([("Abc d", "abcx"), ("", "a"), ("a", ""), (None, None), ("abc", "abc")], "g string, e string")
    assert [r.s for r in df.select(T.match_score(F.col("g"), F.col("e")).alias("s")).collect()] == [0.75, 0.0, 0.0, 0.0, 1.0]
    tokens = F.array(*map(F.lit, ["The", " cat", " sat", " on", " the", " cat"]))
    got = spark.range(1).select(T.suffix_start(tokens, F.lit("the cat")).alias("a"), T.suffix_start(tokens, F.lit("zzz")).alias("b"), T.char_suffix_start(tokens, F.lit("the cat")).alias("c"), T.subsequence_start(tokens, F.array(F.lit(" on"), F.lit(" the"))).alias("d"), T.subsequence_start(tokens, F.array(F.lit("q"))).alias("e")).first()
    assert tuple(got) == (4, 0, 4, 2, None)
    many = spark.createDataFrame([([" a", "b ", "\n", "c", " ", "b c", " "], "b c"), (["x"] * 3000 + ["y"], "x y"), ([], "a"), (["a"], ""), (["ab", "ab"], "abab")], "t array<string>, s string")
    norm = lambda x: " ".join(x.split())
    for r in many.select("t", "s", T.suffix_start("t", F.col("s")).alias("a")).collect():
        assert r.a == max([k for k in range(len(r.t)) if r.s and norm("".join(r.t[k:])).endswith(norm(r.s))], default=0)


def test_fuzzing(spark):
    words = spark.createDataFrame([("cat", ["feline"]), ("returns", ["yields"])], "word string, synonyms array<string>")
    df = spark.createDataFrame([(1, "The Cat returns (the cat_x) x."), (2, None), (3, "")], "i int, t string")
    rows = {r.i: r for r in T.fuzz_synonyms(df, "t", "i", 1.0, 5, words).collect()}
    assert rows[1].fuzzed == "The Feline yields (the cat_x) x." and rows[1].n_replaced == 2
    assert rows[2].fuzzed is None and rows[2].n_replaced == 0 and rows[3].fuzzed == ""
    assert T.fuzz_synonyms(df, "t", "i", 0.0, 5, words).agg(F.sum("n_replaced")).first()[0] == 0
    long = "the CAT returns; cat returns Returns cat " * 5
    df2 = spark.createDataFrame([(k, long) for k in range(4)] + [(9, None)], "i int, t string")
    ways = []
    for most in (1000, 1):
        T.MAP_WORDS = most
        ways.append(sorted(tuple(r) for r in T.fuzz_synonyms(df2, "t", "i", 0.5, 5, words).select("i", F.coalesce("fuzzed", F.lit("-")), "n_replaced").collect()))
    T.MAP_WORDS = 1000
    assert ways[0] == ways[1] and len({n for _, _, n in ways[0]}) > 2
    totals = {r.i: (r.rows, r.replacements) for r in T.fuzz_totals(T.fuzz_synonyms(df, "t", "i", 1.0, 5, words), ["i"]).collect()}
    assert totals == {1: (1, 2), 2: (1, 0), 3: (1, 0), None: (3, 2)}
    code = df.select(T.insert_dead_code(F.col("t"), F.col("i"), 3, 1).alias("d")).first().d
    assert code.startswith("The Cat") and sum(b in code for b in T.DEAD_CODE) == 3


def test_code_functions(spark):
    cases = ["```python\nx=1\n```\n```python\nlonger=22\n```", "```\nplain\n```", " bare ", None, "```py\na\n```"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.c for r in df.select(C.extract_code(F.col("t")).alias("c")).collect()] == ["longer=22", "plain", "bare", "", "a"]
    a = spark.range(1).select(C.split_assert(F.lit("assert f(1, [2]) == {3: 4}")).alias("a")).first().a
    assert tuple(a) == ("f(1, [2])", "f", "1, [2]", "{3: 4}")
    assert C.backoff(0, 0) == 1.0 and C.backoff(10, 1) == 78.0 and C.backoff(0, -1) == 0.7
    assert C.head_lines('"""d"""\nimport os\nx = 1\nfrom a import b\ny') == 4 and C.head_lines("import os\nx = (") == 1
    assert C.core_operations("import os\n\nx = 1\n")["STORE_NAME"] == 1 and C.core_operations("x = (") is None and C.core_operations(" ") is None
    two = C.core_operations("import a\ndef f(x):\n    return [g(i) for i in x]\n")
    assert two["RETURN_VALUE"] >= 1 and two["MAKE_FUNCTION"] == 1 and "IMPORT_NAME" not in two and "CACHE" not in two
    codes = spark.createDataFrame([("", None, "c"), (None, None, None), ("a", "b", "c")], "a string, b string, c string")
    assert [r.o for r in codes.select(C.first_code(*map(F.col, "abc")).alias("o")).collect()] == ["c", "", "a"]
    marked = spark.createDataFrame([("import os\nx = 1",), ("",)], "c string").select(C.inject_marker("c").alias("m")).collect()
    assert marked[0].m.code_with_marker.splitlines()[1] == C.MARKER and marked[0].m.core_start_line == 3


@pytest.mark.parametrize(
    "row,bucket",
    [
        (("success", True, None, False, "x", None), "PASS"), (("success", True, None, False, " ", None), "EMPTY_CODE"), (("success", True, None, False, "x", "429"), "API_ERROR"),
        (("timeout", False, "", True, "x", None), "TIMEOUT"), (("test_failure", False, "AssertionError: 1", False, "x", None), "ASSERTION_FAIL"), (("execution_error", False, "IndexError: list index out of range", None, "x", None), "PARSE_ERROR"),
        (("execution_error", False, "wrong format", None, "x", None), "OUTPUT_FORMAT_ERROR"), (("execution_error", False, "KeyError", None, "x", None), "RUNTIME_ERROR"), (("test_failure", False, None, None, "x", None), "UNKNOWN_FAIL"),
        ((None, None, None, None, None, None), "EMPTY_CODE"), (("test_failure", False, "odd", None, "x", None), "RUNTIME_ERROR"),
    ],
)
def test_failure_buckets(spark, row, bucket):
    df = spark.createDataFrame([row], "status string, pass boolean, error string, timeout boolean, code string, api string")
    assert df.select(C.failure_bucket(*(F.col(c) for c in df.columns)).alias("b")).first().b == bucket


def test_submission(spark):
    df = spark.createDataFrame([("class S:\n    def f(self):", "return 1\nx"), (None, "y"), ("def f():", "def f():\n    return 2")], "s string, c string")
    got = [r.o for r in df.select(C.compose_submission(F.col("c"), F.col("s"), F.lit("A\n==Code Submission==\nB")).alias("o")).collect()]
    assert got == ["A\nclass S:\n    def f(self):\n        return 1\n        x\n\nB", "A\ny\nB", "A\ndef f():\n    return 2\nB"]
