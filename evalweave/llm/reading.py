"""Reading level of each document: n-gram surprisal against graded samples, and isotonic regression.

Training (driver; the graded samples are a small fixed table, read up to ``MOST_SAMPLES`` rows):

* One interpolated n-gram model (three, two, one word, uniform) for each level. The weights come from expectation-
  maximisation on held-out folds.
* Each sample is scored by models that have not seen it. The surprisals of the whole text under the levels' models give a
  distribution over levels; its mean is the sample's difficulty. Isotonic regression (pool adjacent violators) maps
  difficulty monotonically to level.

Scoring is one narrow pass: whole documents, in Arrow batches, with the models broadcast (their size is that of the
samples). Indented and fenced code, quotation lines and records are left out, as are sentences mostly of words that no
sample holds: inserted passages. A document is English if most of its words are the samples', or else by function words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.arrow import map_texts
from evalweave.llm.language import language
from evalweave.llm.shingles import tokens, windows
from evalweave.session import spread, table

#: Bound on the graded samples that are read for training; a classifier needs no more.
MOST_SAMPLES = 20_000
FOLDS = 5
#: Sentences with a larger share of unknown words are taken for inserted passages, if others are left.
MOST_UNKNOWN = 0.34
#: Share of known words from which a document is English without a further look.
KNOWN_ENGLISH = 0.6
#: Share of words in sentences of another language from which a text of mostly unknown words is not English prose.
MOST_FOREIGN = 0.25
#: Bits of surprisal that halve a level's weight; softened, as words of a text are not independent.
SOFT_BITS = 8.0
_FENCED = re.compile(r"^```.*?(?:^```\s*$|\Z)", re.MULTILINE | re.DOTALL)
_ASIDE = re.compile(r"^(?:(?: {4}|\t).*|\s*(?:>|\||//|#|\{\").*)$", re.MULTILINE)
_QUOTED = re.compile(r"[\"“«][^\"“”«»]*[\"”»]")
_SENTENCE = re.compile(r"[.!?;:\n]+")


def prose(text: str | None) -> str:
    """A text without code, quotation lines and quoted passages."""
    return _QUOTED.sub("\n", _ASIDE.sub("\n", _FENCED.sub("\n", text or "")))


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def _is_english(plain: str, parts: list[str]) -> bool:
    """Whether a text of mostly unknown words is English: as a whole, and without much prose in another language, since an
    inserted English passage may be longer than the prose around it."""
    if language(plain) != "en":
        return False
    size = [len(s.split()) for s in parts]
    foreign = sum(n for n, s in zip(size, parts) if language(s) not in (None, "en"))
    return foreign < MOST_FOREIGN * max(1, sum(size))


class Levels:
    """The n-gram models of all levels, as sorted hashes with one column of probabilities a level."""

    def __init__(self, samples: list[tuple[int, list[str]]], names: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.names = names
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        flat = [s for _, parts in samples for s in parts]
        of = np.array([np.searchsorted(names, level) for level, parts in samples for _ in parts], np.int64)
        h, counts = tokens(flat, code=False)
        keys = [(h, np.repeat(np.arange(len(counts)), counts)), windows(h, counts, 2)[:2], windows(h, counts, 3)[:2]]
        contexts: list[np.ndarray] = []
        for n, (key, sentence) in enumerate(keys):
            value, at = np.unique(key, return_inverse=True)
            table_ = np.zeros((len(value), len(names)))
            np.add.at(table_, (at, of[sentence]), 1)
            if n == 0:
                total = table_.sum(axis=0)
                self.vocabulary = len(value)
                contexts.append(table_)
                self.grams.append((value, table_ / np.maximum(total, 1)))
            else:
                # Probability of the last word given the words before: by the counts of those words as a context.
                first = self._contexts(h, counts, n)
                low, where = np.unique(first, return_inverse=True)
                below = np.zeros((len(low), len(names)))
                np.add.at(below, (where, of[sentence]), 1)
                context_of = np.zeros(len(value), np.int64)
                context_of[at] = where
                self.grams.append((value, table_ / np.maximum(below[context_of], 1)))
        self.weights = np.array([0.05, 0.35, 0.35, 0.25]) if weights is None else weights

    @staticmethod
    def _contexts(h: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Hash of the first n words of each run of n + 1 words."""
        _, sentence, place = windows(h, counts, n + 1)
        starts = np.cumsum(counts) - counts
        if n == 1:
            return h[starts[sentence] + place]
        w, s, p = windows(h, counts, n)
        first = np.cumsum(np.maximum(counts - n + 1, 0)) - np.maximum(counts - n + 1, 0)
        return w[first[sentence] + place]

    def parts(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of the sentences: probabilities by order (words x 4 x levels); known or not; words per sentence."""
        h, counts = tokens(flat, code=False)
        out = np.zeros((len(h), 4, len(self.names)))
        out[:, 0] = 1 / (self.vocabulary + 1)
        starts = np.cumsum(counts) - counts
        known = np.zeros(len(h), bool)
        for n, (value, p) in enumerate(self.grams):
            if not len(value):
                continue
            if n == 0:
                key, to = h, np.arange(len(h))
            else:
                key, sentence, place = windows(h, counts, n + 1)
                to = starts[sentence] + place + n
            at = np.minimum(np.searchsorted(value, key), len(value) - 1)
            hit = value[at] == key
            out[to[hit], n + 1] = p[at[hit]]
            if n == 0:
                known = hit
        return out, known, counts

    def surprisal(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each sentence under each level (sentences x levels), share of known words, words per sentence."""
        p, known, counts = self.parts(flat)
        bits = -np.log2(np.einsum("wol,o->wl", p, self.weights))
        starts = np.minimum(np.cumsum(counts) - counts, max(0, len(known) - 1))
        some = counts > 0
        total = np.zeros((len(counts), len(self.names)))
        share = np.zeros(len(counts))
        if some.any():
            total[some] = np.add.reduceat(bits, starts[some], axis=0)
            share[some] = np.add.reduceat(known.astype(float), starts[some]) / counts[some]
        return total, share, counts


def difficulty(total: np.ndarray, share: np.ndarray, counts: np.ndarray, names: np.ndarray) -> tuple[float, float]:
    """(level to expect by the surprisals of the sentences, share of known words among all) of one document."""
    words = counts.sum()
    if not words:
        return float("nan"), 0.0
    known = float((share * counts).sum() / words)
    use = (share >= 1 - MOST_UNKNOWN) & (counts > 0)
    if not use.any():
        use = counts > 0
    bits = total[use].sum(axis=0)
    post = np.exp2(-(bits - bits.min()) / SOFT_BITS)
    return float(post @ names / post.sum()), known


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, fitted y), non-decreasing."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, hi = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[3] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, hi
    return np.array([e for b in blocks for e in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


class Grader:
    """Models of all samples, and the map from difficulty to level."""

    def __init__(self, samples: list[tuple[int, str]]) -> None:
        split = [(level, sentences(prose(text))) for level, text in samples]
        self.names = np.array(sorted({level for level, _ in split}))
        fold = np.arange(len(split)) % FOLDS
        self.weights = self._weights(split, fold)
        x = np.zeros(len(split))
        for k in range(FOLDS):
            model = Levels([s for s, f in zip(split, fold) if f != k], self.names, self.weights)
            for i in np.flatnonzero(fold == k):
                x[i] = difficulty(*model.surprisal(split[i][1]), self.names)[0]
        self.scores, self.levels = x, np.array([level for level, _ in split])
        ok = ~np.isnan(x)
        self.knots, self.fitted = isotonic(x[ok], self.levels[ok].astype(float))
        self.model = Levels(split, self.names, self.weights)

    def _weights(self, split: list, fold: np.ndarray) -> np.ndarray:
        weights = np.array([0.05, 0.35, 0.35, 0.25])
        held = []
        for k in range(FOLDS):
            model = Levels([s for s, f in zip(split, fold) if f != k], self.names)
            for level in self.names:
                flat = [t for (name, parts), f in zip(split, fold) if f == k and name == level for t in parts]
                if flat:
                    held.append(model.parts(flat)[0][:, :, np.searchsorted(self.names, level)])
        p = np.concatenate(held) if held else np.ones((1, 4))
        for _ in range(30):
            r = p * weights
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            weights = np.maximum(r.mean(axis=0), 1e-4)
            weights /= weights.sum()
        return weights

    def level(self, score: float) -> int:
        return int(np.clip(np.floor(np.interp(score, self.knots, self.fitted) + 0.5), self.names[0], self.names[-1]))

    def grade(self, texts: list[str]) -> list[tuple[int | None, float]]:
        """(level, difficulty) of each text; level None where the prose is not English."""
        plain = [prose(t) for t in texts]
        split = [sentences(p) for p in plain]
        total, share, counts = self.model.surprisal([s for parts in split for s in parts])
        ends = np.cumsum([len(parts) for parts in split])
        out = []
        for k, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
            score, known = difficulty(total[a:b], share[a:b], counts[a:b], self.names)
            english = score == score and (known >= KNOWN_ENGLISH or _is_english(plain[k], split[k]))
            out.append((self.level(score) if english else None, score))
        return out


def reading_levels(docs: DataFrame, doc_id: str, text: str, samples: DataFrame, level: str, sample_text: str) -> DataFrame:
    """doc_id, reading_level (null where the prose is not English), difficulty, one row for each document of ``docs``.

    Null and empty texts have no prose and no level; texts of any length are read whole; repeated documents give repeated
    rows; without graded samples no document has a level.
    """
    rows = samples.select(F.col(level).cast("int"), F.col(sample_text)).where(F.col(level).isNotNull() & F.col(sample_text).isNotNull()).orderBy(F.xxhash64(sample_text), sample_text).limit(MOST_SAMPLES).collect()
    grader = Grader([(r[0], r[1]) for r in rows]) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def make(batch: pa.RecordBatch, texts: list[str]) -> dict:
        found = shared.value.grade(texts) if shared.value else [(None, float("nan"))] * len(texts)
        return {"id": batch.column("id"), "reading_level": [g for g, _ in found], "difficulty": [s if s == s else None for _, s in found]}

    src = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")))
    return map_texts(src, "text", "id long, reading_level int, difficulty double", make).withColumnRenamed("id", doc_id)


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents").where("doc_kind = 'article'"), "doc_id", "text", table(spark, sf_dir, "reading_anchors"), "reading_level", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of each English article."""
    return _articles(spark, sf_dir).where("reading_level is not null").select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and their mean difficulty per source and level."""
    docs = table(spark, sf_dir, "documents").where("doc_kind = 'article'").select("doc_id", "source")
    graded = _articles(spark, sf_dir).where("reading_level is not null").join(docs, "doc_id")
    return graded.groupBy("source", "reading_level").agg(F.count("*").alias("articles"), F.round(F.avg("difficulty"), 4).alias("mean_difficulty"))
