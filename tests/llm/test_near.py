"""Near-duplicates, cross-split overlaps and leaks against brute force; shingles and codes against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.llm import fuzzyhash, golay, shingles, splits, tiling

CODE = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
WORD = re.compile(r"[A-Za-z0-9]+")


def plain_tokens(text, code):
    return CODE.findall(text) if code else [w.lower() for w in WORD.findall(text)]


def plain_set(text, width, code):
    t = plain_tokens(text or "", code)
    return {tuple(t[i : i + width]) for i in range(len(t) - width + 1)}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("code", [True, False])
def test_shingles_equal_plain_python(code):
    rng = random.Random(1)
    texts = ["".join(rng.choice('ab_9Z .,(\n\té…K\u3000😀"İ') for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", " ", "a"]
    h, counts = shingles.tokens(texts, code)
    flat = [t for x in texts for t in plain_tokens(x, code)]
    assert list(counts) == [len(plain_tokens(x, code)) for x in texts]
    assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))
    _, n, _ = shingles.shingle_sets(texts, 3, code)
    assert list(n) == [len(plain_set(x, 3, code)) for x in texts]


def test_chunks_cut_no_text():
    texts = ["a" * 10, None, "b" * 500, "", "c"]
    parts = list(shingles.chunks(texts, 100))
    assert [t for _, p in parts for t in p] == ["a" * 10, "", "b" * 500, "", "c"] and [k for k, _ in parts] == [0, 2, 3]


def test_golay_code_is_perfect():
    rng = np.random.default_rng(2)
    info = rng.integers(0, 4096, 3000)
    word = golay.encode(info)
    for weight in range(4):
        error = np.array([sum(1 << int(b) for b in rng.choice(23, weight, replace=False)) for _ in info], np.uint32)
        assert (golay.decode(word ^ error) == info).all()
    assert len(np.unique(golay.encode(np.arange(4096)))) == 4096


def test_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 23, 2000)
    b = a ^ (1 << rng.integers(0, 23, 2000)) ^ (1 << rng.integers(0, 23, 2000))
    sets = []
    for words in (a, b):
        row, key = golay.keys(words)
        out = [set() for _ in words]
        for r, k in zip(row.tolist(), key.tolist()):
            out[r].add(k)
        sets.append(out)
        assert {len(x) for x in out} == {1, 6}
    assert all(x & y for x, y in zip(*sets))


def program(rng, n=60):
    return " ".join(f"v{rng.randint(0, 400)} = f{rng.randint(0, 50)}(x{rng.randint(0, 900)})" for _ in range(n // 6))


def edited(rng, text, k):
    parts = text.split(" ")
    for _ in range(k):
        parts[rng.randrange(len(parts))] = f"z{rng.randint(0, 999)}"
    return " ".join(parts)


def programs(seed=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        base = program(rng, rng.choice([80, 200, 400]))
        rows += [base] + [edited(rng, base, rng.randint(0, 8)) for _ in range(rng.choice([0, 0, 1, 4]))]
    rows += ["same text " * 40] * 7 + [None, "", "too short", " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("threshold,width,least", [(0.6, 4, 50), (0.8, 5, 50)])
def test_near_duplicates_equal_brute_force(spark, threshold, width, least):
    rows = programs()
    df = spark.createDataFrame(rows, "id long, text string").withColumn("sketch_a", F.lit("clash")).repartition(4)
    links, members = fuzzyhash.near_duplicates(df, "id", "text", threshold, width, least)
    got = {tuple(r) for r in fuzzyhash.all_pairs(links, members).collect()}
    sets = {i: plain_set(t, width, True) for i, t in rows if t and len(plain_tokens(t, True)) >= least}
    want = {(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= threshold}
    assert len(want) > 60 and got <= want and len(got) >= 0.98 * len(want)
    kept = {r.id: r.rep for r in members.collect()}
    assert set(kept) == set(sets) and all(sets[i] == sets[r] and r <= i for i, r in kept.items())


def common_pairs(rng, pairs, a, b, both, common):
    """Shingles of pairs of texts (a and b of them, both shared, the first ``common`` common): hashes, counts, uncommon."""
    u = rng.integers(1, 1 << 63, (pairs, a + b - both)).astype(np.uint64)
    order = [np.argsort(x, axis=1) for x in (u[:, :a], np.concatenate([u[:, :both], u[:, a:]], axis=1))]
    h = [np.take_along_axis(x, o, 1) for x, o in zip((u[:, :a], np.concatenate([u[:, :both], u[:, a:]], axis=1)), order)]
    return np.concatenate([x.ravel() for x in h]), np.repeat([a, b], pairs), np.concatenate([(o >= common).ravel() for o in order])


@pytest.mark.parametrize("decoded", [False, True])
@pytest.mark.parametrize("a,b,both,common", [(148, 148, 111, 0), (148, 148, 111, 44), (148, 148, 111, 64), (111, 185, 111, 83), (111, 185, 111, 90), (48, 48, 36, 21)])
def test_recall_at_the_threshold_by_common_share(decoded, a, b, both, common):
    """Pairs at 0.6 that share an anchor and a codeword: rows of light anchors, and of heavy ones decoded before the shuffle."""
    pairs = 1000
    anchors, words = fuzzyhash._ways(*common_pairs(np.random.default_rng(9), pairs, a, b, both, common), 0.6)
    assert both / (a + b - both) == 0.6
    text, _ = np.nonzero(anchors)
    key, word = anchors[anchors != 0].view(np.int64), words[anchors != 0]
    if decoded:
        zero = pa.array(np.zeros(len(text), np.int64))
        out = fuzzyhash._decoded(pa.RecordBatch.from_pydict({"key": pa.array(key), "id": pa.array(text), "word": pa.array(word), "sketch_a": zero, "sketch_b": zero}))
        key, word, text = np.array(out["key"]), np.array(out["word"]), out["id"].to_numpy()
    order = np.argsort(key, kind="stable")
    lo, hi = fuzzyhash._meet(key[order], text[order].astype(np.int64), word[order], np.zeros((len(text), 2), np.int64), 0.6, 128)
    assert len({x for x, y in zip(lo.tolist(), hi.tolist()) if y == x + pairs}) >= 0.995 * pairs


def test_heavy_and_salted_keys_give_the_same_links(spark, monkeypatch):
    rng = random.Random(11)
    base = program(rng, 300)
    rows = list(enumerate([edited(rng, base, rng.randint(1, 12)) for _ in range(60)] + [program(rng, 300) for _ in range(60)]))
    df = spark.createDataFrame(rows, "id long, text string")
    found = []
    for bucket in (fuzzyhash.BUCKET, 4):
        monkeypatch.setattr(fuzzyhash, "BUCKET", bucket)
        links, _ = fuzzyhash.near_duplicates(df, "id", "text", 0.6, 4, 50)
        found.append(sorted((r.lo, r.hi) for r in links.collect()))
    sets = {i: plain_set(t, 4, True) for i, t in rows}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if similarity(sets[a], sets[b]) >= 0.6 and sets[a] != sets[b]}
    assert found[0] == found[1] and len(want & set(found[1])) >= 0.99 * len(want) > 300


def test_pairs_of_a_large_key_in_several_rounds(monkeypatch):
    monkeypatch.setattr(fuzzyhash, "PAIRS", 5)
    rng = np.random.default_rng(5)
    key, word = np.sort(rng.integers(0, 6, 60)), rng.integers(0, 1 << 23, 60) & 0x7
    lo, hi = fuzzyhash._meet(key, np.arange(60), word, np.zeros((60, 2), np.int64), 0.6, 128)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if key[i] == key[j] and set(golay.keys(word[[i]])[1]) & set(golay.keys(word[[j]])[1])}
    assert {*zip(lo.tolist(), hi.tolist())} == want and want


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 201), (201, 202), (200, 202)]
    rng = random.Random(3)
    rng.shuffle(edges)
    got = {r.id: r.group for r in fuzzyhash.components(spark.createDataFrame(edges, "lo long, hi long")).collect()}
    assert got == {k: 0 if k < 100 else 100 if k < 200 else 200 for e in edges for k in e}
    assert fuzzyhash.components(spark.createDataFrame([], "lo long, hi long")).count() == 0


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (None, "x " * 80)]):
        links, members = fuzzyhash.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text")
        assert links.count() == 0 and members.count() == 0


def test_equal_texts_are_one_class_and_groups_count_links(spark):
    rng = random.Random(12)
    base = [program(rng, 300) for _ in range(40)]
    rows = [(k, base[k % 40] + " " * (k % 3)) for k in range(200)] + [(500 + k, edited(rng, base[0], 2)) for k in range(3)]
    links, members = fuzzyhash.near_duplicates(spark.createDataFrame(rows, "id long, text string").repartition(5), "id", "text", 0.6, 4, 50)
    assert {r.id: r.rep for r in members.collect()} == {k: k % 40 if k < 500 else k for k, _ in rows}
    got = {r.id: (r["class"], r.group, r.n_links) for r in fuzzyhash.groups(links, members).collect()}
    assert got == {k: (k % 40, k % 40, 3 if k % 40 == 0 else 0) if k < 500 else (k, 0, 3) for k, _ in rows}


def test_third_of_all_rows_are_near_copies(spark):
    rng = random.Random(6)
    base = program(rng, 300)
    rows = list(enumerate([edited(rng, base, 1) for _ in range(40)] + [program(rng, 300) for _ in range(80)]))
    links, members = fuzzyhash.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.8, 5, 50)
    sets = {i: plain_set(t, 5, True) for i, t in rows}
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if similarity(sets[a], sets[b]) >= 0.8 and sets[a] != sets[b]}
    got = {(r.lo, r.hi) for r in links.collect()}
    assert got <= want | got and len(got & want) >= 0.98 * len(want)


def statements(seed=7):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        rows.append((rng.choice(["train", "test", "validation", None]), " ".join(text)))
        for _ in range(rng.choice([0, 1, 2])):
            copy = list(text)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.choice(["train", "test"]), " ".join(copy).upper() + "!!" if rng.random() < 0.5 else ", ".join(copy)))
    rows += [("train", "same words here again")] * 5 + [("test", "Same words, here AGAIN")] * 4 + [("train", None), ("test", ""), ("test", "two words")]
    return [(k, s, t) for k, (s, t) in enumerate(rows)]


@pytest.mark.parametrize("threshold,width", [(0.5, 3), (0.8, 5)])
def test_overlaps_equal_brute_force(spark, threshold, width):
    rows = statements()
    df = spark.createDataFrame(rows, "k long, split string, prompt string").withColumn("id", F.lit("clash")).repartition(3)
    links, members = splits.cross_split_overlaps(df, "k", "prompt", F.col("split").eqNullSafe("train"), threshold, width)
    e = members.where("not train").select(F.col("id").alias("e"), F.col("class").alias("eval_class"))
    t = members.where("train").select(F.col("id").alias("t"), F.col("class").alias("train_class"))
    got = [(r.e, r.t) for r in links.join(e, "eval_class").join(t, "train_class").collect()]
    sets = {k: (s == "train", plain_set(x, width, False)) for k, s, x in rows}
    want = {(a, b) for a, (ta, sa) in sets.items() for b, (tb, sb) in sets.items() if not ta and tb and sa and sb and similarity(sa, sb) >= threshold}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_overlaps_of_nothing(spark):
    links, members = splits.cross_split_overlaps(spark.createDataFrame([], "k long, prompt string"), "k", "prompt", F.lit(True))
    assert links.count() == 0 and members.count() == 0


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"t{k}" for k in range(80)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for k in range(20)] + [(90, None), (91, ""), (92, None)]
    items.append((93, items[0][1]))  # an equal item
    docs = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            source = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(source))
            text[len(text) // 2 : len(text) // 2] = source[a : a + rng.randint(5, 40)]
        docs.append((k, " ".join(text).upper() if k % 2 else "; ".join(text)))
    docs += [(100, None), (101, "")]
    want = set()
    for d, t in docs:
        w = plain_tokens(t or "", False)
        runs = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        want |= {(d, i) for i, x in items if plain_set(x, 13, False) & runs}
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    right = spark.createDataFrame(items, "item_id long, text string")
    for size in (tiling.FILTER_BITS, 64):
        monkeypatch.setattr(tiling, "FILTER_BITS", size)
        rows = tiling.leaks(left, "doc_id", "text", right, "item_id", "text").collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and all(0 < r.coverage <= 1 and r.longest_tile >= 13 for r in rows)
    assert tiling.leaks(left, "doc_id", "text", right.limit(0), "item_id", "text").count() == 0
    assert tiling.leaks(left.limit(0), "doc_id", "text", right, "item_id", "text").count() == 0


def test_one_passage_in_a_third_of_the_documents(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(k, f"{passage} d{k}" if k % 3 == 0 else f"d{k} " * 20) for k in range(600)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage + " end"), (2, "x y " * 30)], "item_id long, text string")
    rows = tiling.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, 1) for k in range(0, 600, 3)} and {r.covered_words for r in rows} == {20}


def test_tiles_do_not_overlap_and_find_reordered_passages():
    item = [f"a{k}" for k in range(40)]
    doc = item[20:] + ["x"] * 5 + item[:20] + item[5:18]
    at = {w: k for k, w in enumerate(item)}
    pairs = [(i, j) for j in range(len(doc) - 12) for i in [at.get(doc[j], -1)] if i >= 0 and doc[j : j + 13] == item[i : i + 13]]
    i, j = (np.array(x) for x in zip(*pairs))
    tiles = tiling.tile(tiling.matches(i, j, 13), len(item), len(doc), 13)
    assert sorted(t[0] for t in tiles) == [20, 20]
