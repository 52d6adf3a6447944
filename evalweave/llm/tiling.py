"""Evaluation texts leaking into training text: greedy string tiling over shared-token seeds.

1. Seeds: Karp-Rabin fingerprints of all runs of ``least`` words of the held-out items, from one running sum, as a table
   (seed, item, place). Items never pass through the driver and may be of any number.
2. A filter of fixed size (``FILTER_BITS`` bits, 8 MB, whatever the number of items) is made of the seeds and broadcast. The
   documents are fingerprinted in one narrow pass, and only those seeds of theirs that pass the filter go on: next to none.
3. Seeds of documents are joined with seeds of items; seeds that many documents hold are salted. The join is exact, so what
   the filter lets through by chance ends here.
4. For each pair of item and document, seeds on a diagonal join to maximal matches. The longest is marked, the others are cut
   back to their unmarked words, and so on down to ``least`` words: the tiles. Order does not matter, so reordered passages
   count. The covered share of the item's words, the longest tile and the number of tiles are reported.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.arrow import map_texts
from evalweave.llm.shingles import mix, tokens, windows
from evalweave.operators.skew import salted_join
from evalweave.session import materialize, spread, table

#: Bits of the filter: 8 MB. With 10 million seeds it lets a twelfth of chance seeds pass, with 100,000 one in 100,000.
FILTER_BITS = 1 << 26


def matches(item_at: np.ndarray, doc_at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, place in the item, place in the document) from seed pairs of ``least`` words."""
    diagonal = doc_at - item_at
    order = np.lexsort((item_at, diagonal))
    i, d = item_at[order], diagonal[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(i))) + least - 1
    return list(zip(length.tolist(), i[begin].tolist(), (i[begin] + d[begin]).tolist()))


def tile(found: list[tuple[int, int, int]], item_words: int, doc_words: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in the item, place in the document): longest first, none overlapping in either text."""
    in_item, in_doc = np.zeros(item_words, bool), np.zeros(doc_words, bool)
    heap = [(-n, i, j) for n, i, j in found]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = ~(in_item[i : i + n] | in_doc[j : j + n])
        if free.all():
            in_item[i : i + n] = True
            in_doc[j : j + n] = True
            tiles.append((n, i, j))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, least: int = 13) -> DataFrame:
    """doc_id, item_id, tiles, covered_words, longest_tile, coverage for each document that holds ``least`` consecutive
    words of an item's text or more.

    Words are maximal runs of ASCII letters and digits, lower-cased. Null and empty texts and items shorter than ``least``
    words hold nothing; empty tables give an empty result; equal items are reported each; repeated documents are reported
    each; texts of any length are searched whole.
    """
    query = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    seeds = materialize(_seeds(query, least, None).select("seed", F.col("id").alias("item"), F.col("place").alias("at"), F.col("words").alias("item_words")))
    src = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null"))
    hits = materialize(_seeds(src, least, seed_filter(seeds)).select("seed", F.col("id").alias("doc"), "place", F.col("words").alias("doc_words")))
    met = salted_join(hits, seeds, "seed").select("doc", "item", "at", "place", "item_words", "doc_words")

    def tiled(pairs: pa.Table) -> pa.Table:
        words = pairs.column("item_words")[0].as_py()
        tiles = tile(matches(pairs.column("at").to_numpy().astype(np.int64), pairs.column("place").to_numpy().astype(np.int64), least), words, pairs.column("doc_words")[0].as_py(), least)
        covered = sum(n for n, _, _ in tiles)
        head = pairs.slice(0, 1)
        return pa.table({"doc": head.column("doc"), "item": head.column("item"), "tiles": pa.array([len(tiles)], pa.int32()), "covered_words": pa.array([covered], pa.int32()), "longest_tile": pa.array([tiles[0][0]], pa.int32()), "coverage": pa.array([covered / words])})

    found = met.groupBy("doc", "item").applyInArrow(tiled, "doc long, item long, tiles int, covered_words int, longest_tile int, coverage double")
    return found.toDF(doc_id, item_id, "tiles", "covered_words", "longest_tile", "coverage")


def _seeds(texts: DataFrame, least: int, bits: Broadcast | None) -> DataFrame:
    """seed, id, place, words for each run of ``least`` words of each text, or for those that pass a filter."""

    def make(batch: pa.RecordBatch, texts: list[str]) -> dict:
        hashes, counts = tokens(texts, code=False)
        seed, owner, place = windows(hashes, counts, least)
        if bits is not None:
            kept = np.flatnonzero(_passes(bits.value, seed))
            seed, owner, place = seed[kept], owner[kept], place[kept]
        return {"seed": seed.view(np.int64), "id": batch.column("id").take(pa.array(owner)), "place": place.astype(np.int32), "words": counts[owner].astype(np.int32)}

    return map_texts(texts, "text", "seed long, id long, place int, words int", make)


def _probes(seed: np.ndarray, size: int) -> list[np.ndarray]:
    return [mix(seed ^ np.uint64(k)) % np.uint64(size) for k in (1, 2)]


def _passes(bits: np.ndarray, seed: np.ndarray) -> np.ndarray:
    out = np.ones(len(seed), bool)
    for at in _probes(seed, 64 * len(bits)):
        out &= bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
    return out


def seed_filter(seeds: DataFrame) -> Broadcast:
    """A filter that every seed of the table passes: ``FILTER_BITS`` bits as 64-bit words, broadcast."""

    size = FILTER_BITS

    def run(batches):
        for b in batches:
            at = np.concatenate(_probes(b.column("seed").to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_pydict({"word": pa.array((at >> np.uint64(6)).astype(np.int32)), "bits": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    rows = seeds.select("seed").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(size // 64, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return seeds.sparkSession.sparkContext.broadcast(bits)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "heldout_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 13 consecutive words of a held-out item or more, with the items."""
    return _found(spark, sf_dir).select("doc_id", "item_id")


def p9_covered(spark: SparkSession, sf_dir: str, coverage: float = 0.5) -> DataFrame:
    """Documents whose tiles cover at least half of a held-out item, in whatever order its passages stand."""
    found = _found(spark, sf_dir).where(F.col("coverage") >= coverage)
    return found.select("doc_id", "item_id", "tiles", "covered_words", F.round("coverage", 6).alias("coverage"))


def p9_report(spark: SparkSession, sf_dir: str, coverage: float = 0.5) -> DataFrame:
    """Per held-out item: documents that hold a passage, those that hold at least half of it, and the largest coverage."""
    hits = _found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("coverage") >= coverage).alias("documents_covered"), F.round(F.max("coverage"), 6).alias("most_covered"))
    items = table(spark, sf_dir, "heldout_items").select("item_id", "benchmark")
    return items.join(hits, "item_id", "left").select("item_id", "benchmark", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("documents_covered", F.lit(0)).alias("documents_covered"), F.coalesce("most_covered", F.lit(0.0)).alias("most_covered"))
