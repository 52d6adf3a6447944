"""Broken prompt and response pairs: noisy labelling functions under an expectation-maximisation label model.

1. Every answer is read once. A labelling function votes for a defect, against it, or abstains; the votes of an answer are one
   bit pattern (``SIGNALS``). Every answer is compared with its question, finished programs too; it meets it through a salted
   join, as one question may hold a third of all answers.
2. Patterns are counted (map-side combined). There are at most 2 ** len(SIGNALS) of them, whatever the number of answers (a
   few hundred in practice), so the counts may go to the driver.
3. Planted examples: in the same pass, every finished program is once more kept as it is, made wordy or faulty, or spoilt in a
   known way, and goes through the same functions. Only counts of classes and patterns go to the driver. One half anchors the
   label model, so that its hidden classes keep their meaning; the other half is held out.
4. Label model: a hidden class (fine, or one of the defects) and for each class and function the probabilities of the three
   votes, fitted by expectation-maximisation to the pattern counts of all answers and the anchors. The posterior of a
   defect is taken over the votes that bear on it (``BEARING``), so one answer may have several defects.
5. The cut-off of each defect is the posterior with the best F1 over the held-out planted examples, weighted to the class
   shares that were found. All labels above their cut-offs are kept (``labels``); ``defect`` is the likeliest class of them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.language import language
from evalweave.llm.shingles import chunks, shingle_sets
from evalweave.llm.truncation import MARK, cut_off, ends_complete, is_code, is_cut_off
from evalweave.operators.skew import salted_join
from evalweave.session import materialize, table

DEFECTS = ("empty", "refusal", "copies_prompt", "other_language", "truncated")

#: The labelling functions.
FUNCTIONS = (
    "blank", "bare_fence", "placeholder", "few_words", "refusal_opening", "refusal_phrase", "refusal_wrapped", "words_of_question", "sentences_of_question", "question_layout",
    "other_code", "other_words", "cut_structure", "cut_mark", "at_limit", "stopped_by_length", "python_lines", "program", "finished_program",
)
#: Functions that bear on each defect: its own, and those that look for Python; a cut text may be in any language.
BEARING = {"empty": FUNCTIONS[:4], "refusal": FUNCTIONS[4:7], "copies_prompt": FUNCTIONS[7:10], "other_language": FUNCTIONS[10:12], "truncated": FUNCTIONS[12:16]}
PYTHON = {d: FUNCTIONS[18:] if d == "truncated" else FUNCTIONS[16:] for d in DEFECTS}
#: (function, vote) of each bit of a pattern: 1 is a vote for its defect, 2 one against.
SIGNALS = (*((name, 1) for name in FUNCTIONS[:16]), ("few_words", 2), ("words_of_question", 2), ("sentences_of_question", 2), ("python_lines", 2), ("program", 2), ("finished_program", 2))
BIT = {signal: 1 << k for k, signal in enumerate(SIGNALS)}
#: Planted examples (anchors and held out) that weigh in full in the fit; more of them weigh no more than so many, or than their
#: share of the answers. It bounds a weight, not the examples.
PLANTED = 1000
CLASSES = ("fine", *DEFECTS)

_FENCE = re.compile(r"^\s*```[\w+-]*\s*$", re.MULTILINE)
_COMMENT = re.compile(r"^\s*(?:#+|//+|--)\s?", re.MULTILINE)
_WRAP = re.compile(r"raise\s+\w+\(|print\(|[\"`()]|(?<![^\W\d_])'|'(?![^\W\d_])|^\s*pass\s*$", re.MULTILINE)
#: What stands in place of an answer.
PLACEHOLDER = re.compile(r"^(?:\.{3,}|…|pass|none|null|nil|n/?a|todo\b.*|tbd|fixme\b.*|undefined|your (?:code|answer|solution)(?: goes)? here|(?:write|insert|add) (?:your )?(?:code|answer|solution) here|placeholder|\[?(?:code|answer|solution)\]?|-+|_+)[.!:]*$", re.IGNORECASE)
_OPENING = re.compile(r"^\W*(?:i['’]?m (?:sorry|afraid|unable|not able)|i am (?:sorry|afraid|unable|not able)|sorry|apologies|my apologies|unfortunately|regrettably|as an? (?:ai|language|assistant)|i (?:cannot|can['’]?t|can not|won['’]?t|will not|do(?:n['’]?t| not)|must|have to|would rather|refuse|decline)|it would not be|my (?:guidelines|policy|instructions)|no (?:solution|code|answer) will|this request)", re.IGNORECASE)
_PHRASE = re.compile(
    r"\b(?:can(?:no|['’])t (?:help|assist|provide|answer|do|complete|solve|write|share)|not able to|unable to (?:help|assist|provide|answer|complete|solve)|won['’]?t (?:write|provide|help|solve|answer|do)|will not (?:write|provide|help|solve|answer)|must decline|have to (?:pass|decline)|rather not|not (?:allow|permit)|(?:do not|don['’]t) (?:feel comfortable|allow)|not be appropriate|outside of what i|due to policy|against (?:my|the) (?:guidelines|policy)|consult your (?:instructor|teacher)|graded work|will be given for)",
    re.IGNORECASE,
)
_OTHER_CODE = re.compile(
    r"^\s*(?:#include\s*[<\"]|using namespace\b|(?:public|private|protected|static|final)\s+[\w<>\[\]]+|(?:public\s+)?(?:abstract\s+)?(?:class|interface|struct|enum|namespace|impl|trait)\s+\w+[^:\n]*\{|public:|package\s+[\w.]+;?\s*$|func\s+\(?\w+|fn\s+\w+|fun\s+\w+\(|(?:var|let|const)\s+\w+|function\s*\w*\s*\(|(?:int|long|void|double|float|bool|char|string|auto|vector<.*>|std::\S+)\s+\w+\s*[=(;]|import\s+java\b|use\s+std::|SELECT\b.*\bFROM\b|\w+\s*<-\s*function|sub\s+\w+\s*\{|def\s+\w+\s*(?:\([^)]*\))?\s*$)|[;{}]\s*$|=>\s*[{(]?",
    re.MULTILINE,
)
_OTHER_MARK = re.compile(r"^\s*(?:#include\b|using namespace|public\b|private\b|func\s|fn\s|fun\s|var\s|let\s|const\s|function\b|class\s+\w+[^:\n]*\{|struct\s|package\s|impl\s|int\s|vector<|std::)|:=|std::|=>|->\s*\w+\s*\{|\w+\(.*\)\s*\{\s*$|\}\s*(?:else|;)", re.MULTILINE)
_LAYOUT = re.compile(r"^\W*(?:question|problem|task|prompt)\s*:|\bconstraints?:|\bexample\s*\d*\s*:|\binput:\s.*\n?.*\boutput:|\bexplanation:", re.IGNORECASE)
_ENDS = re.compile(r"^\s+(?:return\b\s*\S|print\b\s*\S|yield\b)", re.MULTILINE)


def _plain(text: str) -> str:
    """The words of an answer without fences, comment signs, quotes and a raise or pass around them."""
    return _WRAP.sub(" ", _COMMENT.sub("", _FENCE.sub("", text))).strip()


def has_program(text: str) -> bool:
    """Whether an answer holds a function with a body that returns or prints something."""
    return is_code(text) and _ENDS.search(text) is not None


def _overlaps(answers: list[str | None], questions: list[str | None]) -> list[tuple[float, float] | None]:
    """Shares of an answer's distinct words, and of its runs of 5 words, that stand in the question; None without a question."""
    out: list = [None] * len(answers)
    need = [i for i, q in enumerate(questions) if q]
    plain = [_plain(answers[i] or "") for i in need]
    for start, part in chunks([p + questions[i] for p, i in zip(plain, need)]):
        at, texts = need[start : start + len(part)], plain[start : start + len(part)]
        distinct = {q: k for k, q in enumerate(dict.fromkeys(questions[i] for i in at))}
        shares = []
        for width in (1, 5):
            a, n, _ = shingle_sets(texts, width, code=False)
            q, m, _ = shingle_sets(list(distinct), width, code=False)
            own, asked = np.split(a, np.cumsum(n)[:-1]), np.split(q, np.cumsum(m)[:-1])
            shares.append([len(np.intersect1d(x, asked[distinct[questions[i]]], assume_unique=True)) / len(x) if len(x) else 0.0 for x, i in zip(own, at)])
        for i, o in zip(at, zip(*shares)):
            out[i] = o
    return out


def votes(answer: str | None, overlap: tuple[float, float] | None, finish: str | None, at_limit: bool, truncated: bool) -> int:
    """The bit pattern of the functions that vote on an answer; ``overlap`` is None where there is no question."""
    text = answer or ""
    plain = _plain(text)
    code = is_code(text)
    program = has_program(text)
    words = len(re.findall(r"\w+", plain))
    lines = [x for x in text.splitlines() if x.strip()]
    found = 0

    def vote(name: str, on: bool, against: bool = False) -> None:
        nonlocal found
        if on or against:
            found |= BIT[name, 1 if on else 2]

    vote("blank", not text.strip())
    vote("bare_fence", bool(text.strip()) and not _FENCE.sub("", text).strip())
    vote("placeholder", bool(PLACEHOLDER.match(plain)) or text.strip() in ("pass", "# TODO"))
    vote("few_words", words <= 4 and not code, words > 12)
    opening, phrase = _OPENING.match(plain) is not None, _PHRASE.search(plain) is not None
    vote("refusal_opening", opening)
    vote("refusal_phrase", phrase)
    vote("refusal_wrapped", opening and phrase and len(plain.split()) <= 40)
    if overlap is not None:
        long = len(plain.split()) >= 8
        vote("words_of_question", overlap[0] >= 0.8 and long, overlap[0] < 0.5 and long)
        vote("sentences_of_question", overlap[1] >= 0.4, overlap[1] < 0.1 and long)
    vote("question_layout", len({m.group(0).lower()[:8] for m in _LAYOUT.finditer(plain)}) >= 2)
    if plain:
        vote("other_code", bool(_OTHER_MARK.search(text)) and sum(bool(_OTHER_CODE.search(x)) for x in lines) >= 0.4 * len(lines))
        vote("other_words", not code and language(plain) not in (None, "en"))
    vote("cut_structure", truncated)
    vote("cut_mark", bool(MARK.search(text)) and len(plain) > 12)
    vote("at_limit", at_limit)
    vote("stopped_by_length", (finish or "").lower() in ("length", "max_tokens"))
    vote("python_lines", False, code)
    vote("program", False, program)
    vote("finished_program", False, program and not truncated)
    return found


def states(patterns: np.ndarray) -> np.ndarray:
    """The vote of each function (0 abstains, 1 for, 2 against) in each pattern."""
    out = np.zeros((len(patterns), len(FUNCTIONS)), np.int8)
    for k, (name, kind) in enumerate(SIGNALS):
        out[patterns >> k & 1 == 1, FUNCTIONS.index(name)] = kind
    return out


class LabelModel:
    """Hidden classes and independent three-way votes, fitted to pattern counts with anchored examples."""

    def __init__(self, anchors: np.ndarray, truth: np.ndarray, share: float = 0.2, smooth: float = 0.5, counts: np.ndarray | None = None) -> None:
        """``anchors`` and ``truth``: votes and classes of examples, each ``counts`` times; they weigh ``share`` of the answers they
        are fitted with, and half of ``PLANTED`` examples at least if there are so many."""
        self.anchors, self.share, self.smooth = anchors, share, smooth
        counts = np.ones(len(truth)) if counts is None else counts
        self.labels, self.size = np.eye(len(CLASSES))[truth] * counts[:, None], max(1.0, counts.sum())
        self.prior = np.array([0.85, *[0.15 / len(DEFECTS)] * len(DEFECTS)])
        self._maximise(np.zeros((0, len(FUNCTIONS)), np.int8), np.zeros((0, len(CLASSES))), 1.0)

    def _maximise(self, votes_: np.ndarray, weight: np.ndarray, scale: float) -> None:
        counts = np.stack([(self.labels.T @ (self.anchors == v)) * scale + weight.T @ (votes_ == v) for v in range(3)], axis=2) + self.smooth
        self.vote = counts / counts.sum(axis=2, keepdims=True)

    def log_joint(self, votes_: np.ndarray, names: tuple[str, ...] = FUNCTIONS) -> np.ndarray:
        """Logarithm of class and votes of some functions, patterns x classes."""
        log = np.log(self.vote)
        return np.log(self.prior) + sum(log[:, k, :][:, votes_[:, k]].T for k in map(FUNCTIONS.index, names))

    def fit(self, votes_: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        scale = max(min(1.0, PLANTED / 2 / self.size), self.share * counts.sum() / self.size)
        for _ in range(rounds):
            joint = self.log_joint(votes_)
            p = np.exp(joint - joint.max(axis=1, keepdims=True))
            p = p / p.sum(axis=1, keepdims=True) * counts[:, None]
            before = self.prior
            self.prior = (p.sum(axis=0) + 1) / (counts.sum() + len(CLASSES))
            self._maximise(votes_, p, scale)
            if np.abs(before - self.prior).max() < 1e-9:
                break
        return self

    def posteriors(self, votes_: np.ndarray) -> np.ndarray:
        """Posterior of each defect under the votes that bear on it, patterns x defects."""
        out = np.zeros((len(votes_), len(DEFECTS)))
        for k, d in enumerate(DEFECTS):
            joint = self.log_joint(votes_, (*BEARING[d], *PYTHON[d]))
            p = np.exp(joint - joint.max(axis=1, keepdims=True))
            out[:, k] = p[:, k + 1] / p.sum(axis=1)
        return out


def validated_cutoff(posterior: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """The cut-off with the best F1 over labelled examples of given weights: midway between the two posteriors it parts."""
    order = np.argsort(-posterior, kind="stable")
    p, t, w = posterior[order], truth[order], weight[order]
    last = np.append(p[1:] != p[:-1], True)
    f1 = np.where(last, 2 * np.cumsum(w * t) / np.maximum(np.cumsum(w) + (w * t).sum(), 1e-300), -1.0)
    at = int(np.argmax(f1))
    return float((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2)


#: Sentences, programs and placeholders that spoil planted examples.
_REFUSALS = (
    "I'm sorry, but I can't help with that request.", "I cannot provide a solution to this problem.", "As an AI language model, I am unable to solve this task.", "Unfortunately, I won't write code for this question.",
    "I must decline to answer, because this looks like graded work.", "Sorry, my guidelines do not permit a solution here.", "I am not able to assist with this exercise; please consult your instructor.", "I would rather not answer this.",
)
_OTHER = (
    "#include <iostream>\nusing namespace std;\nint solve(int n) {\n    int s = 0;\n    for (int i = 0; i < n; i++) { s += i; }\n    return s;\n}\n", "public class Solution {\n    public int solve(int[] a) {\n        int best = 0;\n        return best;\n    }\n}\n",
    "function solve(a) {\n  let best = 0;\n  for (const x of a) { best += x; }\n  return best;\n}\n", "package main\n\nfunc solve(n int) int {\n\ttotal := 0\n\treturn total\n}\n", "fn solve(n: i64) -> i64 {\n    let mut s = 0;\n    s\n}\n",
    "Man geht die Liste einmal durch und merkt sich nach jedem Schritt den größten Wert, weil danach kein Element mehr kleiner werden kann.", "On parcourt la liste une seule fois et on garde la plus grande valeur dans une variable pour ne pas la chercher de nouveau.",
    "Se recorre la lista una sola vez y se guarda el mayor valor en una variable para no buscarlo después.",
)
_EMPTY = ("", "  \n", "```python\n```", "# TODO", "pass", "...", "# your code here", "None")


_STUBS = ("def solve(*args):\n    return None", "class Solution:\n    def solve(self, *args):\n        return 0", "def solve(a):\n    print('TODO')\n\n\nsolve([])")


def planted(code: str, question: str, seed: int) -> tuple[str, bool, str, str, bool]:
    """An example made of a finished program and its question: class, whether it is held out, answer, finish reason, at limit."""
    rng = random.Random(seed)
    held, kind = rng.random() < 0.5, rng.choice(DEFECTS) if rng.random() < 0.5 else "fine"
    finish, limit = rng.choice(["stop", "stop", "stop", "length"]), rng.random() < 0.05
    text = code
    if kind == "empty":
        text = rng.choice(_EMPTY)
    elif kind == "refusal":
        r = rng.choice(_REFUSALS)
        text = rng.choice([r, r, f"# {r}", f"raise NotImplementedError({r!r})", f"print({r!r})\npass"])
    elif kind == "copies_prompt":
        commented = "# " + question.replace("\n", "\n# ")
        text = rng.choice([question, commented, f'"""{question}"""\n', "Question: " + question, f"{commented}\n{rng.choice(_STUBS)}"])
    elif kind == "other_language":
        text = rng.choice(_OTHER)
    elif kind == "truncated":
        text = code.rstrip()[: rng.randrange(len(code.rstrip()) // 3, max(len(code.rstrip()) // 3 + 1, len(code.rstrip()) - 4))]
        limit = rng.random() < 0.4
    elif rng.random() < 0.3:
        lines = code.split("\n")
        faulty = rng.randrange(max(1, len(lines) // 2))
        text = rng.choice([f"Here is a solution:\n```python\n{code}\n```\nIt takes linear time.", "\n".join(x.replace(":", "", 1) if j == faulty else x for j, x in enumerate(lines)), "# " + question.replace("\n", "\n# ") + "\n" + code])
    return kind, held, text, finish, limit


class Examples(Sequence):
    """Planted examples (class, held out, pattern), held as counts of equal ones: at most 2 ** len(SIGNALS) a class and half."""

    def __init__(self, rows: list[tuple[int, bool, int, int]]) -> None:
        self.rows = sorted(rows)
        self.ends = np.cumsum([0, *(r[3] for r in self.rows)])

    def __len__(self) -> int:
        return int(self.ends[-1])

    def __getitem__(self, k: int) -> tuple[int, bool, int]:
        return self.rows[int(np.searchsorted(self.ends, range(len(self))[k], "right")) - 1][:3]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Sequence) and len(self) == len(other) and all(x == y for x, y in zip(self, other))


def vote_patterns(answers: DataFrame, questions: DataFrame, answer_id: str, question_id: str, answer: str, question: str, finish: str, source: list[str]) -> tuple[DataFrame, Examples]:
    """(answer_id, pattern) of each answer, and planted examples made of all finished programs that have a question.

    ``questions`` has one row for each ``question_id``. Null answers vote as empty ones; answers without a question keep
    all other votes; repeated rows vote each.
    """
    cut = materialize(cut_off(answers, source, answer, [answer_id, question_id, answer, finish]))
    asked = questions.select(F.col(question_id), F.col(question).alias("__question"))
    columns = [answer, "__question", finish, "at_limit", "truncated", "__seed"]
    rows = salted_join(cut, asked, question_id, "left").withColumn("__seed", F.xxhash64(answer_id, answer, question_id)).select(answer_id, *columns)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                text, asked_, finish_, limit, truncated, seed = (part.column(c).to_pylist() for c in columns)
                made = {i: planted(text[i], q, seed[i]) for i, q in enumerate(asked_) if q and text[i] and not limit[i] and not truncated[i] and has_program(text[i]) and ends_complete(text[i])}
                made = {i: x for i, x in made.items() if x[0] != "truncated" or not ends_complete(x[2])}  # else it isn't what it was made for
                overlap = _overlaps([*text, *(x[2] for x in made.values())], [*asked_, *(asked_[i] for i in made)])
                found = [votes(*x) for x in zip(text, overlap, finish_, limit, truncated)]
                kind, held, example = [None] * len(text), [None] * len(text), [None] * len(text)
                for (i, (c, h, t, f, a)), o in zip(made.items(), overlap[len(text) :]):
                    kind[i], held[i], example[i] = CLASSES.index(c), h, votes(t, o, f, a, is_cut_off(t, a))
                yield pa.RecordBatch.from_pydict({answer_id: part.column(answer_id), "pattern": pa.array(found, pa.int64()), "kind": pa.array(kind, pa.int32()), "held": pa.array(held, pa.bool_()), "example": pa.array(example, pa.int64())})

    schema = rows.select(answer_id).schema.add("pattern", "long").add("kind", "integer").add("held", "boolean").add("example", "long")
    voted = materialize(rows.mapInArrow(run, schema))
    examples = voted.where("example is not null").groupBy("kind", "held", "example").agg(F.count("*").alias("n")).collect()  # at most 2 ** len(SIGNALS) a class and half
    return voted.select(answer_id, "pattern"), Examples([tuple(r) for r in examples])


def fitted(patterns: DataFrame, examples: Examples) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Patterns, posteriors (patterns x defects), log joint of the classes, and the cut-off of each defect."""
    rows = patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 2 ** len(SIGNALS) rows
    values = np.array([r["pattern"] for r in rows], np.int64)
    truth, held, made, n = np.array(examples.rows, np.int64).reshape(-1, 4).T
    held, made = held == 1, states(made)
    model = LabelModel(made[~held], truth[~held], counts=n[~held]).fit(states(values), np.array([r["n"] for r in rows], float))
    weight = model.prior[truth[held]] * n[held] / np.maximum(np.bincount(truth[held], n[held], len(CLASSES))[truth[held]], 1)
    p = model.posteriors(made[held])
    cutoffs = {d: validated_cutoff(p[:, k], truth[held] == k + 1, weight) for k, d in enumerate(DEFECTS)} if held.any() else dict.fromkeys(DEFECTS, 0.5)
    return values, model.posteriors(states(values)), model.log_joint(states(values)), cutoffs


def defect_labels(patterns: DataFrame, examples: Examples, answer_id: str) -> DataFrame:
    """answer_id, labels (array of defects above their cut-offs), defect (the likeliest of them), posterior.

    Only defective answers. An empty table gives an empty result; without a finished program among the answers there are no
    planted examples, and the votes decide under the priors alone.
    """
    values, posterior, joint, cutoffs = fitted(patterns, examples)
    limits = np.array([cutoffs[d] for d in DEFECTS])
    table_rows = []
    for v, p, j in zip(values.tolist(), posterior, joint):
        on = np.flatnonzero(p >= limits)
        if len(on):
            best = on[np.argmax(j[on + 1])]
            table_rows.append((v, [DEFECTS[i] for i in on], DEFECTS[best], float(p[best])))
    labels = patterns.sparkSession.createDataFrame(table_rows, "pattern long, labels array<string>, defect string, posterior double")
    return patterns.join(F.broadcast(labels), "pattern").select(answer_id, "labels", "defect", "posterior")


def _effibench(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "generations").where("dataset = 'effibench'")
    questions = table(spark, sf_dir, "effibench").select(F.col("id").alias("problem_id"), "prompt").where("problem_id is not null")
    return defect_labels(*vote_patterns(answers, questions, "generation_id", "problem_id", "generated_solution", "prompt", "finish_reason", ["model", "dataset"]), "generation_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusable pairs of an effibench question and its answer, with the defect."""
    return _effibench(spark, sf_dir).select("generation_id", "defect")


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of each unusable pair, joined by commas, with the posterior of the likeliest."""
    return _effibench(spark, sf_dir).select("generation_id", F.array_join("labels", ",").alias("labels"), F.round("posterior", 4).alias("posterior"))
