"""Same or near-same records across splits.

1. Records are canonicalised (case, punctuation, white space) and hashed as a whole. Evaluation hashes are joined with
   training hashes: equal records form a class, which meets both sides at once, however many copies it has.
2. One record of each class is also hashed piece by piece, as all runs of ``width`` words. Pieces are put into one order for
   all records, the frequent ones last by their counts (a bounded table, see ``common``). Sets of n and m pieces at similarity
   t or more share at least s = t / (1 + t) (n + m) of them, and at least ``SHARED`` of these stand among the first
   n - s + ``SHARED`` and m - s + ``SHARED`` pieces. Only first pieces go into the join, as narrow rows of piece, class, size and
   place; evaluation pieces are joined with training pieces, frequent ones salted.
3. The shared first pieces of a pair are counted: nearly all chance pairs have fewer. What is left meets the texts, for the exact
   similarity. All filters are exact: no pair at or above t is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.arrow import map_texts
from evalweave.llm.common import common_shingles, find_in
from evalweave.llm.shingles import mix, shingle_sets, tokens
from evalweave.operators.skew import salted_join
from evalweave.session import materialize, spread, table


#: Pieces above 2/FREQUENT of all are ordered by their counts (fewer than FREQUENT / 2 by that, 8 MB).
FREQUENT = 1 << 20
#: First pieces that a pair has to share (all of s, where that is less).
SHARED = 4
#: Bits of the place in a packed piece row, the size standing above; either is an int, so both fit a long.
PLACE_BITS = 31


def record_hashes(tokens_: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each text as a sequence of words."""
    ends = np.cumsum(counts)
    place = np.arange(len(tokens_)) - np.repeat(ends - counts, counts)
    out = []
    for seed in (5, 91):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens_ ^ mix(place.astype(np.uint64) + np.uint64(seed << 32))), dtype=np.uint64)))
        out.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return out


def _prepared(df: DataFrame, width: int, threshold: float) -> DataFrame:
    """id, train, rec_a, rec_b (hash of the canonical record), size, prefix (array of piece hashes), for texts that have a piece."""
    common = df.sparkSession.sparkContext.broadcast(common_shingles(df, "text", width, code=False, share=FREQUENT))

    def make(batch: pa.RecordBatch, texts: list[str]) -> dict:
        words, word_counts = tokens(texts, code=False)
        record = record_hashes(words, word_counts)
        h, n, _ = shingle_sets(texts, width, code=False)
        values, counts = common.value
        doc = np.repeat(np.arange(len(n)), n)
        known, at = find_in(h, values)
        weight = np.where(known, counts[at] if len(counts) else 0, 0)
        order = np.lexsort((h, weight, doc))
        ordered = h[order]
        starts = np.cumsum(n) - n
        place = np.arange(len(h)) - np.repeat(starts, n)
        length = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + SHARED
        taken = place < np.repeat(length, n)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[taken], minlength=len(n))))).astype(np.int32)
        prefix = pa.ListArray.from_arrays(offsets, pa.array(ordered[taken].view(np.int64)))
        some = pa.array(n > 0)
        out = {"id": batch.column("id"), "train": batch.column("train"), "rec_a": pa.array(record[0]), "rec_b": pa.array(record[1]), "size": pa.array(n.astype(np.int32)), "prefix": prefix}
        return {k: v.filter(some) for k, v in out.items()}

    return materialize(map_texts(df, "text", "id long, train boolean, rec_a long, rec_b long, size int, prefix array<long>", make))


def similar_texts(pairs: DataFrame, left_text: str, right_text: str, width: int, keep: list[str], schema: str) -> DataFrame:
    """Rows of ``pairs`` with the exact ``similarity`` of the sets of word runs of two text columns."""

    def make(batch: pa.RecordBatch, texts: list[str]) -> dict:
        h, n, _ = shingle_sets(texts, width, code=False)
        g, m, _ = shingle_sets([t or "" for t in batch.column(right_text).to_pylist()], width, code=False)
        a, b = np.split(h, np.cumsum(n)[:-1]), np.split(g, np.cumsum(m)[:-1])
        both = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)), np.int64, len(texts))
        return {"similarity": both / np.maximum(1, n + m - both)} | {c: batch.column(c) for c in keep}

    return map_texts(pairs, left_text, schema, make)


def cross_split_overlaps(df: DataFrame, id_col: str, text_col: str, is_train: Column, threshold: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Overlaps between training records and all others.

    Returns (links, members). links: eval_class, train_class, similarity, equal, for all pairs of classes of which the first
    has an evaluation record and the second a training record, at ``threshold`` or above; a class with both is linked to
    itself, and only such links are equal. members: id, train, class, for each record that has a piece; a class holds the
    records whose words are equal in order, and is named by its smallest id.

    Null texts and texts of fewer than ``width`` words have no piece and are in neither result; a null split counts as
    evaluation; an empty table gives empty results; further columns are ignored.
    """
    src = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(is_train, F.lit(False)).alias("train")).where("id is not null and text is not null"))
    rows = _prepared(src, width, threshold)
    classes = rows.groupBy("rec_a", "rec_b").agg(F.min("id").alias("class"), F.max(F.col("train").cast("int")).alias("has_train"), F.max((~F.col("train")).cast("int")).alias("has_eval"), F.count("*").alias("copies"))
    classes = materialize(classes)
    several = classes.where("copies > 1").select(F.struct("rec_a", "rec_b").alias("record"), "class")
    members = salted_join(rows.select("id", "train", F.struct("rec_a", "rec_b").alias("record")), several, "record", "left")
    members = materialize(members.select("id", "train", F.coalesce("class", "id").alias("class")))
    heads = rows.join(classes.select(F.col("class").alias("id"), "has_train", "has_eval"), "id")
    heads = materialize(heads.select("id", "has_train", "has_eval", "size", "prefix"))
    pieces = heads.select("id", "has_train", "has_eval", "size", F.posexplode("prefix").alias("place", "piece"))
    packed = F.shiftleft(F.col("size").cast("long"), PLACE_BITS) + F.col("place")
    evals = pieces.where("has_eval = 1").select("piece", F.col("id").alias("eval_class"), packed.alias("e"))
    trains = pieces.where("has_train = 1").select("piece", F.col("id").alias("train_class"), packed.alias("t"))

    def unpack(c: str) -> tuple[Column, Column]:
        return F.shiftright(c, PLACE_BITS), F.col(c).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    (n, p), (m, q) = unpack("e"), unpack("t")
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - F.lit(1e-9))
    least = F.least(needed, F.lit(SHARED))
    possible = (F.col("eval_class") != F.col("train_class")) & (p < n - needed + least) & (q < m - needed + least) & (F.least(n - p, m - q) + F.least(p, q) >= needed)
    met = salted_join(evals, trains, "piece").where(possible).select("eval_class", "train_class", least.alias("least"))
    pairs = materialize(met.groupBy("eval_class", "train_class").agg(F.count("*").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("eval_class", "train_class"))
    wanted = pairs.select(F.col("eval_class").alias("id")).union(pairs.select("train_class")).distinct()
    text = materialize(src.select("id", "text").join(wanted, "id", "left_semi"))
    both = salted_join(pairs, text.select(F.col("id").alias("eval_class"), F.col("text").alias("a")), "eval_class")
    both = salted_join(both, text.select(F.col("id").alias("train_class"), F.col("text").alias("b")), "train_class", counted=pairs)
    near = similar_texts(both, "a", "b", width, ["eval_class", "train_class"], "eval_class long, train_class long, similarity double").where(F.col("similarity") >= threshold)
    same = classes.where("has_train = 1 and has_eval = 1").select(F.col("class").alias("eval_class"), F.col("class").alias("train_class"), F.lit(1.0).alias("similarity"), F.lit(True).alias("equal"))
    return near.withColumn("equal", F.lit(False)).unionByName(same), members


def _effibench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = table(spark, sf_dir, "effibench")
    return df, *cross_split_overlaps(df, "_idx", "prompt", F.col("_split").eqNullSafe("train"), 0.5, 3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of _idx, one of the training split and one of another, with similarity 0.5 or more over 3-word runs."""
    _, links, members = _effibench(spark, sf_dir)
    evals = members.where("not train").select(F.col("id").alias("e"), F.col("class").alias("eval_class"))
    trains = members.where("train").select(F.col("id").alias("t"), F.col("class").alias("train_class"))
    links = materialize(links.select("eval_class", "train_class"))
    half = salted_join(links, evals, "eval_class")
    pairs = salted_join(half, trains, "train_class")
    return pairs.select(F.least("e", "t").alias("idx_lo"), F.greatest("e", "t").alias("idx_hi"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: its class, and how many classes of the other side (training or not) its class overlaps."""
    _, links, members = _effibench(spark, sf_dir)
    links = materialize(links.select("eval_class", "train_class"))
    sides = [members.where(where).join(links.groupBy(F.col(own).alias("class")).agg(F.count("*").alias("n_links")), "class", "left") for where, own in (("not train", "eval_class"), ("train", "train_class"))]
    return sides[0].unionByName(sides[1]).select(F.col("id").alias("_idx"), F.col("class").alias("class_idx"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source file: rows, rows that overlap the training split, of these with an equal record."""
    df, links, members = _effibench(spark, sf_dir)
    best = links.groupBy("eval_class").agg(F.max("equal").alias("same"))
    hit = members.where("not train").join(best, members["class"] == best["eval_class"]).select(F.col("id").alias("_idx"), "same")
    rows = df.where(~F.col("_split").eqNullSafe("train")).select("_idx", "_split", "_src_file").join(hit, "_idx", "left")
    return rows.groupBy("_split", "_src_file").agg(F.count("*").alias("rows"), F.count("same").alias("overlapping"), F.count_if("same").alias("equal"))
