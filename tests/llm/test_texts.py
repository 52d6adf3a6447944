"""Syntax, truncation, defects, packing and reading levels: against Python's own parser, hand-made cases and held-out data."""

import ast
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm import derivative, packing, pairs, reading, syntax, truncation
from evalweave.llm.language import language

GOOD = '''import os
from typing import (List,
    Dict)

@decorate(1, *a, k=2, **b)
class A(B, metaclass=M):
    """Doc."""
    x: int = 3
    def f(self, a, /, b=1, *args: int, c, d=2, **kw) -> List[int]:
        global g
        for i, (j, *k) in enumerate(x if y else z):
            if i and not j or k is not None and 3 not in k: continue
            elif (n := len(k)) > 2:
                pass
            else:
                break
        else:
            return [q for q in range(3) if q], {**a, 'b': 1}, {1, *c}, (y for y in z)
        try:
            with open(f) as h, (yield) as m:
                raise ValueError from None
        except (A, B) as e:
            del a[0], b.c
        finally:
            assert x, 'm'
        return lambda *a, k=1: a[1:2, ::3, ...]
async def g():
    async with a as b:
        await c
    return [x async for x in y]
x = y = z = 1; x += 2
while True: x @= 0x1F + 1_000 - .5e-3j ** -2
print("a" 'b' r"\\d" """c
d""", end='')
type X[T] = list[T]
def h[T: int](x: T): ...
match = case = 1
if x:
\tpass
a = b if c else d
x[a:=1]
try: pass
except* E: pass
'''
BAD = ["print x", "x = ", "def f(:", "f() = 1", "x + 1 = 2", "return = 1", "a b", "if x\n    y", "for x in y:\nz", "  x", "if x:\n    y\n  z", "if x:\n\ty\n        z", "x = (1, 2", "x = 1)", "'abc", '"""abc', "x = 0777", "1abc", "a ? b", "class A {", "def f(a=1, b): pass", "f(a=1, b)", "del f()", "x = [for y in z]", "lambda x=1, y: 0", "import a.b as", "from . import", "<<<<<<< HEAD\nx = 1", "x = 5 6", "else: x", "try:\n    x", "async x", "a, b: int = 1", "None = 1", "x := 1", "f(**a, *b)", "\ufffd", "x = '\n'", "(*a)", "{**a for a in b}", "def f(*): pass", "with a as f(): pass", "x = yield = 1", "not = 1", "a not b", "with open(f) as h, as m: pass"]


def valid(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


def test_derivatives_accept_and_reject_like_python():
    assert valid(GOOD) and derivative.parse(GOOD).valid
    for text in BAD:
        assert not valid(text), text
        assert not syntax.check(text)[0], text
        assert not derivative.parse(text).valid, text


def test_every_prefix_agrees_with_python():
    for cut in range(len(GOOD)):
        part = GOOD[:cut]
        assert syntax.check(part)[0] == valid(part), part[-60:]


def test_token_edits_agree_with_python():
    rng = random.Random(5)
    parts = [p for p in derivative.TOKENS.findall(GOOD)]
    wrong = 0
    for _ in range(1500):
        out = list(parts)
        for _ in range(rng.randint(1, 2)):
            k = rng.randrange(len(out))
            how = rng.random()
            out[k : k + 1] = [] if how < 0.4 else [out[k], rng.choice(parts)] if how < 0.7 else [rng.choice(parts)]
        text = " ".join(out)
        wrong += syntax.check(text)[0] != valid(text)
    assert wrong == 0


def test_failing_token_and_truncation():
    out = derivative.parse("x = 1\ny = f(2 3)\nz = 4\n")
    assert (out.valid, out.truncated, out.line) == (False, False, 2)
    for text in ("x = f(1,", "def f():\n", "if x:\n    y = [1", 's = """abc', "x = 'abc", "for a in", "x ="):
        assert derivative.parse(text).truncated, text
    assert not derivative.parse("x = 1 1").truncated


def test_memo_is_only_a_cache(monkeypatch):
    monkeypatch.setattr(derivative, "MEMO_NODES", 10)
    assert derivative.parse(GOOD).valid and not derivative.parse("print x").valid


def test_parse_outcomes_of_all_kinds_of_rows(spark):
    rows = [(1, "x = 1", None), (2, "x = (", " \n"), (3, None, "print x"), (4, "", "x"), (5, "x = '" + "y" * 100_000 + "'", "b'é'"), (2, "x = (", None)]
    df = spark.createDataFrame(rows, "k long, generated_solution string, generated_solution_clean string").withColumn("valid2", F.lit(1))
    got = sorted((r.k, r.field_name[18:], r.valid, r.failure) for r in syntax.parse_outcomes(df, ["k"]).collect())
    assert got == sorted([(1, "", True, None), (2, "", False, "truncated"), (3, "_clean", False, "invalid"), (4, "_clean", True, None), (5, "", True, None), (5, "_clean", False, "invalid"), (2, "", False, "truncated")], key=lambda r: (r[0], r[1], r[2], str(r[3])))
    assert syntax.parse_outcomes(df.limit(0), ["k"]).count() == 0


DONE = "def f(a, k):\n    total = 0\n    for x in a:\n        total += x\n    return total + k"


@pytest.mark.parametrize(
    "text,at_limit,cut",
    [
        (DONE, True, False), (DONE, False, False), (DONE[:-3], True, True), (DONE[:40], False, True), (DONE[:45], True, True), (DONE + "\n# end", True, False), (DONE + "\n\nThis runs in linear time.", False, False),
        (DONE[:50] + "…", False, True), (DONE[:50] + "...[truncated]", False, True), (DONE[:50] + "\ufffd", False, True), ("...", False, False), (DONE.replace("a:", "a"), False, False), (DONE.replace("return total", "print total"), False, False),
        (None, False, False), ("", True, False), ("I'm sorry, I can't help.", False, False), ("def g():\n    print(1)\n\n\ng()", True, False), ("def g():\n    print(1)\n\n\n", True, True), (DONE.replace("x in a", "x in (a"), False, False), (DONE.replace("total + k", "max"), True, True), (DONE.replace("total + k", "None"), True, False),
    ],
)
def test_cut_off(text, at_limit, cut):
    assert truncation.is_cut_off(text, at_limit) == cut


def test_length_limits_by_characters_and_bytes(spark):
    rows = [("a", "x" * 80)] * 30 + [("a", "x" * k) for k in range(20, 70)] + [("b", "é" * 30 + "y" * 20)] * 12 + [("b", "z" * 79)] * 2 + [(None, "q" * 9)] * 9 + [("c", None), ("c", "one")]
    got = {(r.s, r.unit): r.limit for r in truncation.length_limits(spark.createDataFrame(rows, "s string, t string"), ["s"], "t").collect()}
    assert got[("a", "characters")] == 80 and got[("b", "bytes")] == 80 and (None, "characters") in got and ("b", "characters") not in got and ("c", "bytes") not in got


def test_cut_off_rows_stay_whole(spark):
    rows = [(k, "m", DONE[:60]) for k in range(10)] + [(20, None, DONE), (21, "m", None), (22, "m", "")]
    df = spark.createDataFrame(rows, "k long, s string, t string").withColumn("limit", F.lit(1))
    got = {r.k: r.truncated for r in truncation.cut_off(df, ["s"], "t", ["k"]).collect()}
    assert len(got) == 13 and all(got[k] for k in range(10)) and not (got[20] or got[21] or got[22])
    assert truncation.cut_off(df.limit(0), ["s"], "t", ["k"]).count() == 0


QUESTION = "A company runs silver ribbons between the conveyor and the violin. No two pipelines with an equal weight share a tent. Return the largest sum.\n\nConstraints:\n* 1 <= n <= 10\nExample 1:\nInput: n = 3\nOutput: 4"


def test_defects(spark):
    answers = [
        (1, None, None), (2, "```python\n```", None), (3, "# TODO", None), (4, "I'm sorry, but I can't help with this task.", None), (5, "# " + QUESTION.replace("\n", "\n# "), None),
        (6, "class Solution {\n    public int f(int[] a) {\n        return 1;\n    }\n}", None), (7, "Zuerst sortieren wir die Liste und zählen danach jedes Element genau einmal.", None), (8, DONE[:70], None),
        (9, DONE, "length"), (10, "Here is the code:\n\n" + DONE, None), (11, DONE.replace("total = 0", '"""Sorry for the odd name, I cannot rename it."""'), None), (12, DONE.replace("return total", "print total"), None),
    ]
    filler = [(100 + k, DONE.replace("total", f"t{k}"), "stop") for k in range(200)]
    df = spark.createDataFrame([(i, "q1" if i % 2 else "q2", a, f, "m") for i, a, f in answers + filler], "generation_id long, problem_id string, a string, f string, model string")
    questions = spark.createDataFrame([("q1", QUESTION), ("q2", QUESTION)], "problem_id string, prompt string")
    patterns, programs = pairs.vote_patterns(df, questions, "generation_id", "problem_id", "a", "prompt", "f", ["model"])
    got = {r.generation_id: r.defect for r in pairs.defect_labels(patterns, programs, "generation_id").collect()}
    assert got == {1: "empty", 2: "empty", 3: "empty", 4: "refusal", 5: "copies_prompt", 6: "other_language", 7: "other_language", 8: "truncated"}
    none = pairs.vote_patterns(df.limit(0), questions, "generation_id", "problem_id", "a", "prompt", "f", ["model"])
    assert pairs.defect_labels(*none, "generation_id").count() == 0 and none[1] == [] and 100 < len(programs) <= pairs.PLANTED


def test_answers_with_two_defects_keep_both_labels(spark):
    java = "class Solution {\n    public int f(int[] a) {\n        int best = 0;\n        for (int x : a) { best += x; }\n        return best + "
    filler = [(100 + k, DONE.replace("total", f"t{k}"), "stop") for k in range(300)] + [(500 + k, DONE[: 60 + k % 9], "length") for k in range(30)] + [(600 + k, java + "1;\n    }\n}", "stop") for k in range(20)]
    df = spark.createDataFrame([(i, "q1", a, f, "m") for i, a, f in [(1, java + "...", "length"), *filler]], "generation_id long, problem_id string, a string, f string, model string")
    questions = spark.createDataFrame([("q1", QUESTION)], "problem_id string, prompt string")
    got = {r.generation_id: r for r in pairs.defect_labels(*pairs.vote_patterns(df, questions, "generation_id", "problem_id", "a", "prompt", "f", ["model"]), "generation_id").collect()}
    assert set(got[1].labels) == {"truncated", "other_language"} and all(got[600 + k].labels == ["other_language"] for k in range(20)) and not any(100 + k in got for k in range(300))


def test_finished_programs_are_compared_with_their_questions_and_all_planted(spark):
    quoted = "# " + QUESTION.replace("\n", "\n# ") + "\n"
    answers = [(1, quoted + "def f(n):\n    return None"), (2, quoted + DONE), (3, DONE)]
    filler = [(100 + k, DONE.replace("total", f"t{k}")) for k in range(1300)]
    df = spark.createDataFrame([(i, "q1", a, "stop", "m") for i, a in answers + filler], "generation_id long, problem_id string, a string, f string, model string")
    questions = spark.createDataFrame([("q1", QUESTION)], "problem_id string, prompt string")
    patterns, examples = pairs.vote_patterns(df, questions, "generation_id", "problem_id", "a", "prompt", "f", ["model"])
    seen = {r.generation_id: r.pattern for r in patterns.collect()}
    assert seen[1] & pairs.BIT["finished_program", 2] and seen[1] & pairs.BIT["words_of_question", 1] and seen[3] & pairs.BIT["words_of_question", 2]
    assert {r.generation_id: r.defect for r in pairs.defect_labels(patterns, examples, "generation_id").collect()} == {1: "copies_prompt"}
    assert 1200 < len(examples) <= 1303


def test_label_model_recovers_hidden_classes():
    rng = np.random.default_rng(1)

    def draw(truth):
        out = np.zeros((len(truth), len(pairs.FUNCTIONS)), np.int8)
        for k, name in enumerate(pairs.FUNCTIONS):
            own = next((1 + j for j, d in enumerate(pairs.DEFECTS) if name in pairs.BEARING[d]), None)
            rate = np.where(truth == 0, 0.9, 0.02) if own is None else np.where(truth == own, 0.7, 0.02)
            out[:, k] = np.where(rng.random(len(truth)) < rate, 2 if own is None else 1, 0)
        return out

    truth = rng.choice(6, 20_000, p=[0.8, 0.04, 0.04, 0.04, 0.04, 0.04])
    anchors = np.arange(600) % 6
    found = draw(truth)
    model = pairs.LabelModel(draw(anchors), anchors).fit(found, np.ones(len(truth)))
    p = model.posteriors(found)
    held = draw(anchors)
    for k in range(5):
        cut = pairs.validated_cutoff(model.posteriors(held)[:, k], anchors == k + 1, model.prior[anchors])
        hit = p[:, k] >= cut
        assert (hit & (truth == k + 1)).sum() > 0.7 * (truth == k + 1).sum() and (hit & (truth == k + 1)).sum() > 0.75 * hit.sum()
    assert abs(model.prior[0] - 0.8) < 0.03


def test_cutoff_parts_the_examples():
    assert 0.3 < pairs.validated_cutoff(np.array([0.9, 0.3, 0.8, 0.1]), np.array([1, 0, 1, 0]), np.ones(4)) < 0.8


def test_language():
    assert language("The list is sorted and then we count each item once.") == "en"
    assert language("Primero ordenamos la lista y después contamos cada uno una sola vez.") == "es"
    assert language("Wystarczy przejść listę od lewej do prawej i pamiętać najmniejszy.") == "pl"
    assert language("これは日本語の文章です") == "other" and language("x1 y_2 3") is None and language("") is None


@pytest.mark.parametrize("capacity", [7, 512, 4096])
def test_fill_is_feasible_and_full(capacity):
    rng = random.Random(capacity)
    lengths = [rng.randint(1, capacity) for _ in range(3000)]
    bins = packing.fill(lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sum(lengths[i] for i in b) <= capacity for b in bins)
    fewest = max(-(-sum(lengths) // capacity), sum(n > capacity / 2 for n in lengths))
    assert len(bins) <= 1.02 * fewest


def test_first_container_is_the_fullest_possible():
    from itertools import combinations

    rng = random.Random(9)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        lengths = [rng.randint(1, capacity) for _ in range(9)]
        first = packing.fill(lengths, capacity)[0]
        largest = max(lengths)
        rest = sorted(lengths, reverse=True)[1:]
        best = max(largest + sum(c) for k in range(9) for c in combinations(rest, k) if largest + sum(c) <= capacity)
        assert sum(lengths[i] for i in first) == best


def test_pack_places_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 100)
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 3, 50, 64, 65, 700, rng.randint(1, 200)])) for k in range(400)] + [(None, 10), (5, 10)]
    counts = spark.createDataFrame(rows, "doc long, n_tokens int").repartition(3)
    got = packing.pack(counts, [("a", 64), ("b", 1000)]).toPandas()
    for name, capacity in (("a", 64), ("b", 1000)):
        part = got[got.budget_name == name]
        assert part.n_tokens.sum() == sum(n for _, n in rows) and part.groupby("bin_id").n_tokens.sum().max() <= capacity
        assert len(part) == sum(-(-n // capacity) for _, n in rows)  # only longer texts are split, into as few pieces as can be
        split = part[(part.piece > 0)].doc.unique()
        assert all(n > capacity for k, n in rows if k in split and k != 5)
    assert packing.pack(counts.limit(0), [("a", 64)]).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|> " * 3)], "i long, t string")
    got = {r.doc: r.n_tokens for r in packing.token_counts(df, "i", "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3


LEVELS = {1: ("We can see the {a} {n}. Look at the {n}! The {n} is {a}. ", ["red", "big", "old"], ["cat", "box", "hand"]), 2: ("You can use a {a} {n} to fix the {n}. First, the {n} counts one {n}. ", ["useful", "common"], ["table", "method", "loop"]), 3: ("Notwithstanding the {n} inherent in the {n}, we contend that the {a} {n} precludes any {n}. ", ["ontological", "asymptotic"], ["epistemology", "heterogeneity", "isomorphism"])}


def sample(rng, level, n=8):
    form, adjectives, nouns = LEVELS[level]
    out = ""
    for _ in range(n):
        s = form
        while "{" in s:
            s = s.replace("{a}", rng.choice(adjectives), 1).replace("{n}", rng.choice(nouns), 1)
        out += s
    return out


def test_levels_of_held_out_documents(spark):
    rng = random.Random(2)
    graded = spark.createDataFrame([(level, sample(rng, level)) for level in LEVELS for _ in range(20)] + [(None, "x"), (1, None)], "reading_level int, text string")
    code = "\n\n    for x in range(3):\n        total_x += 1\n\n"
    docs = [(10 * level + k, sample(rng, level, 6) + (code if k % 2 else "\n> " + sample(rng, 4 - level, 1)) + sample(rng, level, 6)) for level in LEVELS for k in range(6)]
    docs += [(90, None), (91, ""), (92, "Zuerst sortieren wir die Liste und zählen danach jedes Element genau einmal."), (93, sample(rng, 2, 400))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(0))
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(df, "doc_id", "text", graded, "reading_level", "text").collect()}
    assert len(got) == len(docs) and all(got[10 * level + k] == level for level in LEVELS for k in range(6))
    assert got[90] is None and got[91] is None and got[92] is None and got[93] == 2
    assert reading.reading_levels(df.limit(0), "doc_id", "text", graded, "reading_level", "text").count() == 0
    assert {r.reading_level for r in reading.reading_levels(df, "doc_id", "text", graded.limit(0), "reading_level", "text").collect()} == {None}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(4)
    x = rng.random(300)
    knots, fitted = reading.isotonic(x, x * 4 + rng.normal(0, 1, 300))
    assert (np.diff(fitted) >= -1e-12).all() and (np.diff(knots) >= 0).all()


@pytest.mark.parametrize("lead", ["Here is the code:\n", "```python\n", "Sure, this works:\n\n```python\n", "Here is the code:\n\n"])
def test_cuts_in_transfer_after_leading_prose_or_fence(lead):
    whole = "def f(values):\n    total = sum(values)\n    return total\n"
    assert not truncation.is_cut_off(lead + whole, False) and not truncation.is_cut_off(lead + whole + "```\n", False)
    assert not truncation.is_cut_off(lead + whole + "```\nIt adds the values.", False)
    for cut in ("def f(values):\n    total = sum(val", "def f(values):\n    total = sum(values)\n    if total >", "def f(values):\n    total = sum(values)\n    return (total +"):
        assert truncation.is_cut_off(lead + cut, False)
    assert not truncation.is_cut_off(lead + "def f(values):\n    total = = 3\n    return total\n", False)
