"""Near-duplicate records with small edits: Golay-code fuzzy hashing.

Plan, for a table of (id, text):

1. Common shingles: a first pass counts shingles block by block and sums the frequent ones. Those that make up more than
   2/``common.COMMON`` of all shingles say nothing about likeness; by that definition they are few (0.5 MB), so they may
   be broadcast.
2. Fingerprint (one narrow pass, Arrow batches). The distinct shingles of a text, without the common ones, are dealt by
   hash into ``SEGMENTS`` segments. A text with a share of uncommon shingles below ``FULL_BELOW`` is fingerprinted by all of
   its shingles as well. A pair at the threshold with a text above that share therefore keeps a similarity of at least
   (FULL_BELOW - 1 + threshold) / FULL_BELOW on its uncommon shingles (``rare_from`` sees to it that the other text has them
   too), and the number of segments is chosen for that similarity: 0.27 at a threshold of 0.6. A segment is sampled by its
   ``SAMPLE`` smallest hashes. The smallest is the segment's anchor; it names a 23-bit word in which each sampled shingle
   flips one bit, and a second word likewise. Texts that differ in one sampled shingle of a segment differ in at most two
   bits of either word.
3. Keys. The first word is decoded to the nearby Golay codewords, one or six; the key of a pair is segment anchor and
   codeword, for every anchor alike, however many texts hold it; where all shingles take part, whose anchors may be
   boilerplate, a codeword of the second word goes with it. By the pigeonhole principle the errors of a pair are few in one of
   its segments at least; two bits apart, two words share a codeword for certain.
4. Texts with equal shingle sets form a class, found by one aggregation; only one text of a class goes on.
5. Join on the key. Rows are shuffled once, by anchor, and decoded to codewords where they arrive, so the shuffle holds one
   row a segment and not one a key. Anchors of a large share of the rows (fewer than ``HEAVY``, by definition) are decoded
   before the shuffle instead, and keys among them that still hold more than ``BUCKET`` texts are salted into cells, in which
   every pair still meets. The candidates are the same either way. Both words (up to ``WORD_BITS`` bits apart), the numbers of
   shingles (an exact bound) and a 128-bit simhash carried along discard far pairs in the join; the simhash's cut-off lies
   ``SIGMAS`` standard deviations beyond the distance expected at the threshold.
6. Verify each candidate by the exact similarity of the shingle sets, from the texts.

Measured recall against brute force is in the README. Nothing but common shingles and heavy anchors is broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm import golay
from evalweave.llm.arrow import map_texts
from evalweave.llm.common import block_counts, common_shingles, find_in
from evalweave.llm.shingles import mix, shingle_sets
from evalweave.operators.skew import salted_join
from evalweave.session import materialize, spread, table

SEGMENTS = 24
SAMPLE = 6
#: Texts under one key before it is salted.
BUCKET = 2048
#: An anchor of more than 1/HEAVY of all (text, segment) rows, and more than 2 BUCKET, is decoded before the shuffle.
HEAVY = 1 << 20
#: Pairs compared at a time in a task.
PAIRS = 1 << 21
#: Texts with a smaller share of uncommon shingles are fingerprinted by all shingles too.
FULL_BELOW = 0.55
SKETCH_BITS = 128
#: Pairs under one key go on if each of their two words differs in at most so many bits: two sampled shingles replaced.
WORD_BITS = 4
#: Deviations that the simhash tolerates: one pair in 1,700 at the threshold lies beyond, and far fewer above it.
SIGMAS = 3.25
CARRIED = ("id", "word", "sketch_a", "sketch_b")
KEYED = "key long, id long, word long, sketch_a long, sketch_b long"
#: Bit of a pair of words that tells the fingerprint of all shingles from that of the uncommon ones.
FULL_BIT = 2 * golay.BITS
#: Bit of rows whose key holds the codeword already.
DECODED_BIT = FULL_BIT + 1
#: Above it: the number of shingles, up to ``MOST_SIZE``, which stands for that and more.
SIZE_BIT, MOST_SIZE = DECODED_BIT + 1, (1 << 15) - 1
_LOW = (1 << golay.BITS) - 1


def rare_from(threshold: float) -> float:
    """Least share of uncommon shingles of a text that is similar to one that lacks the fingerprint of all shingles."""
    return max(0.0, (threshold - 1 + FULL_BELOW) / threshold - 1e-9)


def sketch_cutoff(threshold: float) -> int:
    """Largest simhash distance of a pair that goes on."""
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    return math.ceil(SKETCH_BITS * p + SIGMAS * math.sqrt(SKETCH_BITS * p * (1 - p)))


def _segments(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (0: none) and both words, each as a texts x SEGMENTS array."""
    rows = len(n)
    doc = np.repeat(np.arange(rows), n)
    rank = mix(h ^ np.uint64(0x5DEECE66D))
    slot = doc * SEGMENTS + (mix(h) % np.uint64(SEGMENTS)).astype(np.int64)
    order = np.lexsort((rank, slot))
    slot, rank = slot[order], rank[order]
    anchors = np.zeros(rows * SEGMENTS, np.uint64)
    first_word = np.zeros(rows * SEGMENTS, np.uint32)
    second_word = np.zeros(rows * SEGMENTS, np.uint32)
    if len(slot):
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        begin = np.flatnonzero(first)
        place = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        anchors[slot[begin]] = rank[begin]
        taken = place < SAMPLE
        slot, rank = slot[taken], rank[taken]
        for word, seed in ((first_word, 0x1F), (second_word, 0x2F00)):
            np.bitwise_xor.at(word, slot, np.uint32(1) << (mix(rank ^ np.uint64(seed)) % np.uint64(golay.BITS)).astype(np.uint32))
    shape = (rows, SEGMENTS)
    return anchors.reshape(shape), first_word.reshape(shape), second_word.reshape(shape)


def _simhash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each text, as a texts x 2 array."""
    out = np.zeros((len(n), 2), np.int64)
    some = np.flatnonzero(n)
    if len(some):
        begin = (np.cumsum(n) - n)[some]
        for k in (0, 1):
            bits = np.unpackbits(mix(h + np.uint64(k)).view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
            out[some, k] = np.packbits(2 * ones > n[some][:, None], axis=1).view(np.int64)[:, 0]
    return out


def _ways(h: np.ndarray, n: np.ndarray, rare: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (0: none) and words of both fingerprints, each as a texts x 2 SEGMENTS array."""
    doc = np.repeat(np.arange(len(n)), n)
    left = np.bincount(doc[rare], minlength=len(n))
    anchors, words = [], []
    for taken, texts_in, mark in ((rare, left >= rare_from(threshold) * n, 0), (np.ones(len(h), bool), left < FULL_BELOW * n, 1)):
        use = taken & texts_in[doc]
        anchor, one, two = _segments(h[use], np.bincount(doc[use], minlength=len(n)))
        if mark:
            anchor[anchor != 0] ^= np.uint64(0xF0F0F0F0F0F0F0F0)
        anchors.append(anchor)
        start = mix(anchor.ravel()).reshape(anchor.shape) & np.uint64((1 << FULL_BIT) - 1)
        words.append((one.astype(np.int64) | two.astype(np.int64) << golay.BITS) ^ start.view(np.int64) | mark << FULL_BIT)
    return np.concatenate(anchors, axis=1), np.concatenate(words, axis=1)


def fingerprints(df: DataFrame, id_col: str, text_col: str, threshold: float, width: int, least_tokens: int) -> DataFrame:
    """One row for each text of enough tokens: id, set_a, set_b (128-bit hash of its shingle set), anchors, words, sketch."""
    src = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    common = df.sparkSession.sparkContext.broadcast(common_shingles(src, "text", width, True, least_tokens)[0])

    def make(batch: pa.RecordBatch, texts: list[str]) -> dict:
        h, n, counts = shingle_sets(texts, width, code=True)
        anchors, words = _ways(h, n, ~find_in(h, common.value)[0], threshold)
        sketch = _simhash(h, n)
        ends = np.concatenate(([0], np.cumsum(n)))
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(s)), dtype=np.uint64))) for s in (3, 77)]
        sets = [(s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums]
        keep = (counts >= least_tokens) & (n > 0)
        words |= np.minimum(n, MOST_SIZE).astype(np.int64)[:, None] << SIZE_BIT
        return {
            "id": batch.column("id").filter(pa.array(keep)),
            "set_a": sets[0][keep], "set_b": sets[1][keep],
            "anchors": _lists(anchors[keep], anchors[keep]), "words": _lists(words[keep], anchors[keep]),
            "sketch_a": sketch[keep, 0], "sketch_b": sketch[keep, 1],
        }

    return map_texts(src, "text", "id long, set_a long, set_b long, anchors array<long>, words array<long>, sketch_a long, sketch_b long", make)


def _lists(a: np.ndarray, anchors: np.ndarray) -> pa.Array:
    """Lists of a row's values where its segment has an anchor."""
    some = anchors != 0
    offsets = np.concatenate(([0], np.cumsum(some.sum(axis=1)))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(a)[some].view(np.int64)))


def _decoded(batch: pa.RecordBatch) -> dict:
    """Rows under heavy anchors once for each of their Golay keys, the key in place of the anchor."""
    words = batch.column("word").to_numpy()
    row, key = golay.keys(words & _LOW)
    anchor = batch.column("key").to_numpy().view(np.uint64)[row]
    at = pa.array(row)
    return {"key": mix(anchor ^ mix((key + 1).astype(np.uint64))).view(np.int64), "word": words[row] | 1 << DECODED_BIT} | {c: batch.column(c).take(at) for c in CARRIED if c != "word"}


def _cells(batch: pa.RecordBatch) -> dict:
    """Rows under large keys (column ``held``) once for each cell: a cell holds two parts of a key's texts (or one), so parts
    meet in pairs."""
    parts = -(-batch.column("held").to_numpy() // BUCKET)
    ids = batch.column("id").to_numpy().view(np.uint64)
    own = (mix(ids) % parts.astype(np.uint64)).astype(np.int64)
    out = np.repeat(np.arange(len(parts)), parts)
    other = np.arange(len(out)) - np.repeat(np.cumsum(parts) - parts, parts)
    cell = np.minimum(own[out], other) * parts[out] + np.maximum(own[out], other)
    at = pa.array(out)
    return {"key": mix(batch.column("key").to_numpy().view(np.uint64)[out] ^ mix(cell.astype(np.uint64))).view(np.int64)} | {c: batch.column(c).take(at) for c in CARRIED}


def _sliced(make):
    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 20_000):
                out = make(b.slice(k, 20_000))
                yield pa.RecordBatch.from_pydict({c: out[c] for c in ("key", *CARRIED)})

    return run


def _meet(key: np.ndarray, ids: np.ndarray, word: np.ndarray, sketch: np.ndarray, threshold: float, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (lo, hi) of ids with a common key and codeword that are near enough, for rows ordered by key."""
    if not len(key):
        return ids, ids
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(fresh) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    group, ids, word, sketch = group[several], ids[several], word[several], sketch[several].view(np.uint64)
    decoded = word >> DECODED_BIT & 1 == 1
    plain = np.flatnonzero(~decoded)
    row, code = golay.keys(word[plain] & _LOW)
    row = np.concatenate([np.flatnonzero(decoded), plain[row]])
    code = np.concatenate([np.full(decoded.sum(), -1, np.int64), code])
    slot = group[row] * (1 << golay.INFO + 1) + code + 1
    full = np.flatnonzero(word[row] >> FULL_BIT & 1)
    again, second = golay.keys(word[row[full]] >> golay.BITS & _LOW)
    rare = np.flatnonzero(~(word[row] >> FULL_BIT & 1 == 1))
    slot = np.concatenate([slot[rare], slot[full][again]]) * (1 << golay.INFO + 1) + np.concatenate([np.zeros(len(rare), np.int64), second + 1])
    row = np.concatenate([row[rare], row[full][again]])
    order = np.argsort(slot, kind="stable")
    row, slot = row[order], slot[order]
    if not len(row):
        return ids[:0], ids[:0]
    begin = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    size = np.diff(np.append(begin, len(slot)))
    follow = np.repeat(begin + size, size) - np.arange(len(slot)) - 1
    ends = np.cumsum(follow)
    lo, hi = [], []
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = follow[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        a, b = row[left], row[right]
        apart = word[a] ^ word[b]
        n, m = word[a] >> SIZE_BIT, word[b] >> SIZE_BIT
        near = (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) | (np.maximum(n, m) == MOST_SIZE)
        near &= (np.bitwise_count(apart & _LOW) <= WORD_BITS) & (np.bitwise_count(apart >> golay.BITS & _LOW) <= WORD_BITS) & (ids[a] != ids[b])
        a, b = a[near], b[near]
        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= cutoff
        a, b = ids[a[near]], ids[b[near]]
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        lo.append(pair[:, 0])
        hi.append(pair[:, 1])
        at = stop
    return np.concatenate(lo), np.concatenate(hi)


def _met(threshold: float):
    """Candidates of a partition that is ordered by key; what is held is one key's rows and a batch."""

    cutoff = sketch_cutoff(threshold)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool):
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column("key").to_numpy()
            end = len(key) if last else int(np.searchsorted(key, key[-1])) if len(key) else 0
            rest = t.slice(end).to_batches()
            done = t.slice(0, end)
            sketch = np.stack([done.column("sketch_a").to_numpy(), done.column("sketch_b").to_numpy()], axis=1)
            lo, hi = _meet(done.column("key").to_numpy(), done.column("id").to_numpy(), done.column("word").to_numpy(), sketch, threshold, cutoff)
            return pa.RecordBatch.from_pydict({"lo": pa.array(lo), "hi": pa.array(hi)}), rest

        least = 50_000
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= least:
                out, held = flush(False)
                rows = sum(x.num_rows for x in held)
                least = max(50_000, 2 * rows)
                yield out
        if rows:
            yield flush(True)[0]

    return run


def heavy_anchors(prints: DataFrame) -> DataFrame:
    """anchor: those of more than 1/``HEAVY`` of all anchors and more than 2 ``BUCKET`` of them, so fewer than ``HEAVY``."""

    def run(batches):
        yield from block_counts((b.column("anchors").flatten().to_numpy().view(np.uint64) for b in batches), "anchor", lambda size: size // (2 * HEAVY))

    sums = materialize(prints.select("anchors").mapInArrow(run, "anchor long, count long, total long").groupBy("anchor").agg(F.sum("count").alias("count"), F.sum("total").alias("total")))
    total = sums.where("anchor is null").first()
    least = max(2 * BUCKET, (total["total"] if total else 0) // HEAVY)
    return materialize(sums.where(F.col("anchor").isNotNull() & (F.col("count") > least)).select("anchor"))


def candidates(prints: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (lo, hi) of ids that share an anchor and a codeword and are near enough, without the ids ``copies``."""
    rows = prints.join(copies, "id", "left_anti").select(F.inline(F.arrays_zip(F.col("anchors").alias("key"), F.col("words").alias("word"))), "id", "sketch_a", "sketch_b").select("key", *CARRIED)
    heavy = heavy_anchors(prints)
    if not heavy.isEmpty():
        heavy = F.broadcast(heavy.withColumnRenamed("anchor", "key"))  # fewer than HEAVY, by definition
        keyed = materialize(rows.join(heavy, "key", "left_semi").mapInArrow(_sliced(_decoded), KEYED))
        large = materialize(keyed.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > BUCKET))
        cells = salted_join(keyed, large, "key").select("key", *CARRIED, "held").mapInArrow(_sliced(_cells), KEYED)
        rows = rows.join(heavy, "key", "left_anti").unionByName(keyed.join(large, "key", "left_anti")).unionByName(cells)
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_met(threshold), "lo long, hi long")
    return materialize(pairs.distinct())


def jaccard(pairs: DataFrame, left_text: str, right_text: str, width: int, keep: list[str], schema: str) -> DataFrame:
    """Rows of ``pairs`` with the exact ``similarity`` of the shingle sets of two text columns."""

    def make(batch: pa.RecordBatch, texts: list[str]) -> dict:
        other = [t or "" for t in batch.column(right_text).to_pylist()]
        h, n, _ = shingle_sets(texts, width, code=True)
        g, m, _ = shingle_sets(other, width, code=True)
        a, b = np.split(h, np.cumsum(n)[:-1]), np.split(g, np.cumsum(m)[:-1])
        both = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)), np.int64, len(texts))
        return {"similarity": both / np.maximum(1, n + m - both)} | {c: batch.column(c) for c in keep}

    return map_texts(pairs, left_text, schema, make)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, least_tokens: int = 50) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and classes of equal ones.

    Returns (links, members). links: lo, hi, similarity, for all pairs of class representatives whose shingle sets have a
    Jaccard similarity of at least ``threshold``. members: id, rep, for each text of at least ``least_tokens`` tokens,
    where rep is the smallest id of the texts with the same shingle set.

    Null ids, null texts and texts under ``least_tokens`` are in neither result; an empty table gives two empty results;
    ids are taken as unique; further columns are ignored.
    """
    prints = materialize(fingerprints(df, id_col, text_col, threshold, width, least_tokens))
    classes = prints.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    repeated = classes.where("copies > 1").drop("copies")
    members = salted_join(prints.select("id", F.struct("set_a", "set_b").alias("set")), repeated.select(F.struct("set_a", "set_b").alias("set"), "rep"), "set", "left")
    members = materialize(members.select("id", F.coalesce("rep", "id").alias("rep")))
    copies = materialize(members.where("id <> rep").select("id"))  # written, so that its true size decides the join
    pairs = candidates(prints, copies, threshold)
    text = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    wanted = materialize(pairs.select(F.col("lo").alias("id")).union(pairs.select(F.col("hi"))).distinct())
    text = materialize(text.join(wanted, "id", "left_semi"))
    both = salted_join(pairs, text.select(F.col("id").alias("lo"), F.col("text").alias("text_lo")), "lo")
    both = salted_join(both, text.select(F.col("id").alias("hi"), F.col("text").alias("text_hi")), "hi", counted=pairs)
    links = jaccard(both, "text_lo", "text_hi", width, ["lo", "hi"], "lo long, hi long, similarity double").where(F.col("similarity") >= threshold)
    return materialize(links), members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair (key_lo, key_hi) of ids, copies included: links expanded by their members, and pairs within a class.

    For results that have to name all pairs; ``groups`` has one row a text. Large classes are salted.
    """
    more = members.where("id <> rep")
    sizes = more.select("rep").distinct()
    group = materialize(more.union(sizes.select(F.col("rep").alias("id"), "rep")))  # classes of several texts, with the representative
    lo = salted_join(links.select("lo", "hi"), group.select(F.col("id").alias("a"), F.col("rep").alias("lo")), "lo", "left").withColumn("a", F.coalesce("a", "lo"))
    both = salted_join(lo, group.select(F.col("id").alias("b"), F.col("rep").alias("hi")), "hi", "left", counted=links).withColumn("b", F.coalesce("b", "hi"))
    within = salted_join(group.select("rep", F.col("id").alias("a")), group.select("rep", F.col("id").alias("b")), "rep").where("a < b")
    return both.select("a", "b").union(within.select("a", "b")).select(F.least("a", "b").alias("key_lo"), F.greatest("a", "b").alias("key_hi"))


def components(edges: DataFrame) -> DataFrame:
    """id, group (smallest id that is reachable) for each id of the edges (lo, hi).

    Every round an id takes the smallest group among its neighbours, then the group of its group, until nothing changes:
    about log n rounds. Each round is written; only the number of changes comes to the driver. Hubs are salted.
    """
    both = materialize(edges.select(F.col("lo").alias("a"), F.col("hi").alias("id")).union(edges.select("hi", "lo")).distinct())
    held = materialize(both.groupBy("id").agg(F.least(F.min("a"), F.col("id")).alias("group")))
    while True:
        near = salted_join(both.select("a", F.col("id")), held.select(F.col("id").alias("a"), F.col("group").alias("of")), "a").groupBy("id").agg(F.min("of").alias("of"))
        hooked = materialize(held.join(near, "id").select("id", F.least("group", "of").alias("next"), "group"))
        jumped = salted_join(hooked, hooked.select(F.col("id").alias("next"), F.col("next").alias("far")), "next")
        after = materialize(jumped.select("id", F.least("next", "far").alias("next"), "group"))
        if after.where("next <> group").isEmpty():
            return after.select("id", "group")
        held = after.select("id", F.col("next").alias("group"))


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each text: id, class (smallest id with equal shingles), group (smallest id that links lead to), n_links
    (other classes that its class is linked to)."""
    counts = links.select(F.col("lo").alias("rep")).union(links.select("hi")).groupBy("rep").agg(F.count("*").alias("n_links"))
    found = components(links).join(counts, F.col("id") == F.col("rep")).select("rep", "group", "n_links")
    out = salted_join(members, found, "rep", "left")
    return out.select("id", F.col("rep").alias("class"), F.coalesce("group", "rep").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: Record kind, table, id and text of the programs of problem 4.
PROGRAMS = (("bigobench", "bigobench", "solution_no", "solution_code"), ("generation", "generations", "generation_id", "generated_solution"))


def _programs(spark, sf_dir: str, finish) -> DataFrame:
    parts = []
    for kind, name, key, text in PROGRAMS:
        links, members = near_duplicates(table(spark, sf_dir, name), key, text, 0.6, 4, 50)
        parts.append(finish(links, members).withColumn("record_kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of programs of one table with similarity 0.6 or more over 4-token shingles (texts of 50 tokens or more)."""
    return _programs(spark, sf_dir, all_pairs).select("record_kind", "key_lo", "key_hi")


def p4_groups(spark, sf_dir: str) -> DataFrame:
    """The groups of such programs, one row a program: its class of equal ones, its group, and the links of its class."""
    out = _programs(spark, sf_dir, groups)
    return out.select("record_kind", F.col("id").alias("key"), F.col("class").alias("class_key"), F.col("group").alias("group_key"), "n_links")
