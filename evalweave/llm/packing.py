"""Filling fixed-capacity containers with items: minimum bin slack.

1. Token counts of all texts, one narrow pass with a public tokenizer (its file is a parameter), written once.
2. A text above the capacity is cut into full pieces, each a container of its own, and a rest; all other texts are items as
   they are. So only texts above the capacity are split.
3. Items are dealt at random into blocks of about ``BLOCK_ITEMS``, whatever their lengths or sources, and each block is
   packed on its own: a block leaves a container or two unfilled, of about a thousand.
4. In a block the largest item left opens a container. A bitset subset-sum recurrence over the available lengths (bit s:
   some items sum to s) finds the fullest combination for the rest; it stops as soon as a sum without slack is reached.
   The combination is removed and the next container opened.
"""

from __future__ import annotations

import base64
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.arrow import map_texts
from evalweave.session import materialize, spread, table

BLOCK_ITEMS = 20_000
#: Budgets that one pass over the items carries; more take several passes.
PASS_BUDGETS = 100
PACKED = "budget_name string, bin_id string, doc long, piece int, first_token int, n_tokens int"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    """The byte-pair encoding of a rank file, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """doc, n_tokens for each row; 0 for null and empty texts."""

    def make(batch: pa.RecordBatch, texts: list[str]) -> dict:
        encode = encoding(path).encode_ordinary
        return {"doc": batch.column("doc"), "n_tokens": [len(encode(t)) for t in texts]}

    return map_texts(spread(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))), "text", "doc long, n_tokens int", make)


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers, for items of 1 to ``capacity`` tokens."""
    items: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        items.setdefault(n, []).append(k)
    sizes = sorted(items, reverse=True)
    out = []
    while sizes:
        largest = sizes[0]
        room = capacity - largest
        used = [largest]
        if room:
            mask = (1 << (room + 1)) - 1
            reach, full = 1, 1 << room
            steps: list[tuple[int, int]] = []
            for n in sizes:
                if n > room:
                    continue
                for _ in range(min(room // n, len(items[n]) - (n == largest))):
                    steps.append((n, reach))
                    reach |= reach << n & mask
                    if reach & full:
                        break
                if reach & full:
                    break
            best = reach.bit_length() - 1
            for n, before in reversed(steps):
                if not before >> best & 1:
                    used.append(n)
                    best -= n
        out.append([items[n].pop() for n in used])
        if not all(items[n] for n in used):
            for n in set(used):
                if not items[n]:
                    del items[n]
            sizes = [n for n in sizes if n in items]
    return out


def pack(counts: DataFrame, budgets: list[tuple[str, int]]) -> DataFrame:
    """budget_name, bin_id, doc, piece, first_token, n_tokens for each piece of each text under each budget.

    ``counts`` is the result of ``token_counts``. Texts without a token need no room and are in no container; repeated
    rows are items each; a null id is kept; capacities must be positive. An empty table gives an empty result.
    """
    rows = materialize(counts.where("n_tokens > 0").withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_ITEMS))
    passes = [_packed_pass(rows, blocks, budgets[k : k + PASS_BUDGETS]) for k in range(0, len(budgets), PASS_BUDGETS)]
    return reduce(DataFrame.unionByName, passes) if passes else counts.sparkSession.createDataFrame([], PACKED)


def _packed_pass(rows: DataFrame, blocks: int, budgets: list[tuple[str, int]]) -> DataFrame:
    options = F.array(*(F.struct(F.lit(n).alias("budget_name"), F.lit(int(c)).alias("capacity")) for n, c in budgets))
    cut = rows.select("doc", "deal", "n_tokens", F.inline(options))
    pieces = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)))
    pieces = pieces.withColumn("first_token", F.col("piece") * F.col("capacity"))
    pieces = pieces.withColumn("size", F.least("capacity", F.col("n_tokens") - F.col("first_token")))
    alone = F.col("size") == F.col("capacity")
    whole = pieces.where(alone).select("budget_name", F.concat_ws("-", F.lit("f"), F.hex("deal"), "piece").alias("bin_id"), "doc", "piece", "first_token", F.col("size").alias("n_tokens"))
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, capacity = int(pdf["block"].iloc[0]), int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["size", "deal", "piece"], ignore_index=True)
        names = [""] * len(pdf)
        for k, members in enumerate(fill(pdf["size"].tolist(), capacity)):
            for i in members:
                names[i] = f"b-{block}-{k}"
        return pdf.assign(bin_id=names, n_tokens=pdf["size"])[["budget_name", "bin_id", "doc", "piece", "first_token", "n_tokens"]]

    shared = pieces.where(~alone).withColumn("block", F.pmod("deal", F.lit(blocks)).cast("int"))
    return shared.groupBy("budget_name", "block").applyInPandas(run, PACKED).unionByName(whole)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = [(r["budget_name"], r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_budgets").where("capacity_tokens > 0").toLocalIterator()]  # settings, not data
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(counts, budgets).withColumnRenamed("doc", "doc_id")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every document, for each budget."""
    return _packed(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: containers, the fewest that could hold the tokens, and the share of room that is filled."""
    budgets = table(spark, sf_dir, "pack_budgets").select("budget_name", "capacity_tokens")
    used = _packed(spark, sf_dir).groupBy("budget_name", "bin_id").agg(F.sum("n_tokens").alias("n")).groupBy("budget_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    out = used.join(budgets, "budget_name")
    return out.select("budget_name", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled_share"))
