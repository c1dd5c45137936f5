"""Packing into length buckets that minimise padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.common import chunk_bits, running, stored, with_chunk, with_row_id
from wickwork.llm.token_counts import token_totals

BUCKETS, BATCH_TOKENS = 16, 16_384

def _next_row(best: np.ndarray, tops: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over i < j of best[i] + cost(i, j), and the smallest such i, for every j from 1.

    Costs satisfy the quadrangle inequality, so the best i never falls as j grows: the middle j of each open range settles the choices of both halves.
    All ranges of a level are solved at once.
    """
    n = len(tops)
    value, choice = np.full(n + 1, np.iinfo(np.int64).max), np.full(n + 1, -1)
    first, last, low, high = np.array([1]), np.array([n]), np.array([0]), np.array([n - 1])
    while len(first):
        middle = (first + last) // 2
        count = np.minimum(high, middle - 1) - low + 1
        start = np.cumsum(count) - count
        i = np.arange(count.sum()) - np.repeat(start - low, count)
        j = np.repeat(middle, count)
        costs = best[i] + tops[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
        least = np.minimum.reduceat(costs, start)
        at = np.minimum.reduceat(np.where(costs == np.repeat(least, count), i, n), start)
        value[middle], choice[middle] = least, at
        first, last, low, high = (np.concatenate(x) for x in ((first, middle + 1), (middle - 1, last), (low, at), (at, high)))
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return value, choice


def best_boundaries(tops: list[int], counts: list[int], sums: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding in all, by dynamic programming over the distinct lengths, which rise.

    cost(i, j): padding when lengths i..j - 1 are filled up to tops[j - 1]. Ties go to the larger last bucket. O(buckets n log n) for n lengths.
    """
    n = len(tops)
    if n == 0:
        return []
    tops = np.asarray(tops, np.int64)
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    s = np.concatenate([[0], np.cumsum(sums, dtype=np.int64)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    backs = []
    for _ in range(min(buckets, n)):
        value, choice = _next_row(best, tops, c, s)
        better = value < best
        backs.append(np.where(better, choice, -1))
        best = np.where(better, value, best)
    ends, j = [], n
    for back in reversed(backs):
        if j and back[j] >= 0:
            ends.append(int(tops[j - 1]))
            j = int(back[j])
    return sorted(ends)


def pack(docs: DataFrame, length: str, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, seed: int = 7) -> DataFrame:
    """Adds bucket (its padded length), batch (long, from 0 inside the bucket), place (int, inside the batch) and padding to each row.

    Boundaries come from the histogram of all rows by exact length; what reaches the driver is a count for each length that occurs. A batch of a bucket holds as many documents as fit
    batch_tokens at the padded length, one if that is longer than the budget. Rows of a bucket are shuffled by a hash; only
    the last batch of a bucket may be short. A null length counts as 0; length 0 has bucket 0. All rows come back; repeated
    rows are packed separately; an empty table gives an empty result. Input columns with the added names are replaced, names starting with _ are reserved.
    """
    base = docs.drop("bucket", "batch", "place", "padding").withColumn("_n", F.coalesce(F.col(length).cast("long"), F.lit(0)))
    base = stored(with_row_id(base).withColumn("_mix", F.xxhash64(F.lit(seed), "_rid")).drop("_rid"), "pack")
    bins = base.groupBy(F.col("_n").alias("top")).agg(F.count("*").alias("n"), F.sum("_n").alias("s")).orderBy("top").collect()
    ends = best_boundaries([r["top"] for r in bins], [r["n"] for r in bins], [r["s"] for r in bins], buckets)
    bucket = F.lit(None).cast("long")
    for e in reversed(ends):
        bucket = F.when(F.col("_n") <= e, F.lit(e).cast("long")).otherwise(bucket)
    most = max((r["n"] for r in bins), default=0) if len(ends) > 1 else sum(r["n"] for r in bins)
    rows = with_chunk(base.withColumn("bucket", bucket), "_mix", chunk_bits(max(most, sum(r["n"] for r in bins) // 3)))
    numbered = running(rows, ["bucket"], "_chunk", [F.shiftrightunsigned("_mix", 1), "_mix"], None, "_k")
    per = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    placed = numbered.withColumn("batch", F.floor((F.col("_k") - 1) / per).cast("long")).withColumn("place", ((F.col("_k") - 1) % per).cast("int"))
    return placed.withColumn("padding", F.col("bucket") - F.col("_n")).select(*[c for c in base.columns if c not in ("_n", "_mix")], "bucket", "batch", "place", "padding")


def pack_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pack() by the tokens of each whole text: doc_id, n_tokens and the columns that pack() adds. A null text has no tokens."""
    counted = token_totals(docs.select("doc_id", "text"), tokenizer)
    return pack(counted.select("doc_id", "n_tokens"), "n_tokens")
