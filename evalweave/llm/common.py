"""Common shingles of a collection: a bounded table, counted over all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.shingles import chunks, shingle_sets
from evalweave.session import materialize

#: A shingle is common when the reports of it sum to more than 2/COMMON of all shingles, so fewer than COMMON/2 are (0.5 MB).
COMMON = 1 << 17
#: Shingles counted at a time in a task (16 MB).
BLOCK = 1 << 21


def block_counts(values: Iterator[np.ndarray], name: str, least: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    """Counts of the hashes of a stream, by blocks of ``BLOCK``: (``name``, count, total), for those that a block holds more
    often than ``least(size)`` and more than once; and a row of null with the size of the block as total."""

    def report(held: list[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        often = count > max(1, least(size))
        yield pa.RecordBatch.from_pydict({name: pa.array(value[often].view(np.int64)), "count": pa.array(count[often].astype(np.int64)), "total": pa.array(np.zeros(often.sum(), np.int64))})
        yield pa.RecordBatch.from_pydict({name: pa.array([None], pa.int64()), "count": pa.array([0]), "total": pa.array([size])})

    held: list[np.ndarray] = []
    size = 0
    for h in values:
        held.append(h)
        size += len(h)
        if size >= BLOCK:
            yield from report(held, size)
            held, size = [], 0
    if size:
        yield from report(held, size)


def common_shingles(df: DataFrame, text: str, width: int, code: bool, least_tokens: int = 0, share: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles above 2/``share`` of all, and their counts; fewer than ``share`` / 2, by their definition.

    A block reports its shingles above 1/(2 ``share``) of it. What a shingle has in blocks that don't report it is below
    that share of all, so a shingle of 2.5/``share`` or more of all is found for certain. Counts are those reported.
    """

    def values(batches):
        for batch in batches:
            for _, texts in chunks(batch.column(text).to_pylist()):
                h, n, counts = shingle_sets(texts, width, code)
                yield h[np.repeat(counts >= least_tokens, n)]

    def run(batches):
        yield from block_counts(values(batches), "shingle", lambda size: size // (2 * share))

    sums = materialize(df.select(text).mapInArrow(run, "shingle long, count long, total long").groupBy("shingle").agg(F.sum("count").alias("count"), F.sum("total").alias("total")))
    total = sums.where("shingle is null").first()
    if total is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = sums.where((F.col("count") > 2) & (F.col("count") * share > 2 * total["total"])).select("shingle", "count").toArrow()
    value = rows.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], rows.column("count").to_numpy()[order]


def find_in(h: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: whether it is in the sorted ``values``, and its place there."""
    if not len(values):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
    return values[at] == h, at
