"""A mixture in which every source has its target share of the tokens, as nearly as its repeat limit allows.

The budget of a source is its weight times the tokens of all documents of the listed sources. As many full passes over the
source as fit are taken first; the rest is a subset-sum problem over exact document lengths. Documents are counted by
length, a proportional part of every length is taken, and bounded-knapsack dynamic programming over the remaining counts
closes the last gap, usually to the token. Which documents of a length are taken is a seeded choice.

What one task holds is a source's counts by length: with T tokens there are at most sqrt(2 T) different lengths, so even
10^13 tokens have fewer than five million. Documents themselves are never gathered: the choice within a length runs in
hashed buckets, so a third of all documents having one length is spread over all tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlink.functions.hygiene import cut, ship
from weftlink.llm.byte_bpe import DEFAULT_VOCABULARY, encode_texts

#: Buckets that the documents of one length are spread over. Gap, in tokens, that the dynamic programme closes: this or so
#: many times the longest document.
BUCKETS, GAP, GAP_DOCUMENTS = 4096, 1 << 18, 8


def nearest_subset(lengths: np.ndarray, counts: np.ndarray, target: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length (at most counts) to take so that their tokens come as near to target as the method
    gets; of two sums as near the smaller. Lengths of 0 are never taken.

    A proportional part of every length is taken up to a gap of at least GAP tokens and GAP_DOCUMENTS of the longest
    documents; bounded-knapsack dynamic programming over all that is left closes the gap, overshooting where that is nearer.
    Exact where the target is not above that gap; above it, unless what is left over cannot make the gap.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    usable = (lengths > 0) & (counts > 0)
    total = sum(int(n) * int(c) for n, c in zip(lengths, counts, strict=True))  # python integers: no overflow
    if target <= 0 or not usable.any():
        return take
    if target >= total:
        return np.where(usable, counts, 0)
    longest = int(lengths[usable].max())
    window = max(GAP, GAP_DOCUMENTS * longest)
    share = max(0, target - window)
    take[usable] = [int(c) * share // total for c in counts[usable]]
    left = np.where(usable, counts - take, 0)
    gap = target - sum(int(n) * int(c) for n, c in zip(lengths, take, strict=True))
    order = np.random.default_rng(seed).permutation(np.flatnonzero(usable))
    while gap > window:  # one more of each length, in seeded order; every document is shorter than the window
        for i in order:
            if left[i] and gap > window:
                take[i] += 1
                left[i] -= 1
                gap -= int(lengths[i])
    _close(take, left, lengths, order, gap, longest)
    return take


def _close(take: np.ndarray, left: np.ndarray, lengths: np.ndarray, order: np.ndarray, gap: int, longest: int) -> None:
    """Adds to take the documents of left whose tokens come nearest to gap. Sums up to the gap and one longest document
    are reached step by step, in units of the lengths' common divisor; each remembers the step that reached it first."""
    unit = int(np.gcd.reduce(lengths[order]))
    sizes, width = lengths // unit, (gap + longest) // unit + 1
    wanted = gap / unit
    reach, first = np.zeros(width, dtype=bool), np.full(width, -1, dtype=np.int32)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    exact = gap // unit if gap % unit == 0 else -1
    for i in order:
        n, part = int(min(left[i], (width - 1) // sizes[i])), 1
        while n > 0 and not (exact >= 0 and reach[exact]):
            part = min(part, n)
            by = part * int(sizes[i])
            fresh = np.flatnonzero(reach[: width - by] & ~reach[by:]) + by
            first[fresh] = len(steps)
            reach[fresh] = True
            steps.append((int(i), part))
            n -= part
            part *= 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - wanted))])
    while at:
        i, part = steps[first[at]]
        take[i] += part
        at -= part * int(sizes[i])


def source_plan(counted: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(source, n_tokens, passes, extra): for each document length of each listed source, how many times all its documents
    are used, and how many of them once more."""
    ship(counted.sparkSession)
    wanted = targets.groupBy("source").agg(
        F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeat", F.lit(0))).alias("max_repeat")
    )
    by_length = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")).join(wanted, "source")
    total = by_length.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("docs")), F.lit(0)).alias("total"))

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        lengths, docs = rows["n_tokens"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64)
        own = int((lengths * docs).sum())
        budget = round(float(rows["weight"].iloc[0]) * int(rows["total"].iloc[0]))
        limit = int(rows["max_repeat"].iloc[0])
        passes = min(limit, budget // own) if own else 0
        rest = budget - passes * own if passes < limit else 0
        extra = nearest_subset(lengths, docs, rest, seed)
        return pd.DataFrame({"source": rows["source"], "n_tokens": lengths, "passes": passes, "extra": extra})

    return (
        by_length.crossJoin(F.broadcast(total))  # one row
        .groupBy("source")
        .applyInPandas(plan, "source string, n_tokens long, passes long, extra long")
    )


def count_tokens(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of the listed sources, with their lineage cut: it is read several times
    and is small beside the texts."""
    listed = targets.where("source is not null").select("source").distinct()
    own = docs.join(listed, "source", "left_semi").select("doc_id", "source", "text")
    counted = encode_texts(own, "doc_id", "text", vocabulary, keep=("source",), count=True)
    return cut(counted.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")))


def mixture(counted: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document stands in the mixture, where it does.

    counted: (doc_id, source, n_tokens). targets: (source, weight, max_repeat); a NULL weight or limit is 0, of repeated
    sources the largest counts. Sources without documents, and documents without a listed source, do not occur. Documents
    without tokens are used in full passes only. doc_id breaks ties; repeated rows are documents of their own.
    """
    plan = cut(source_plan(counted, targets, seed))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS))
    rows = counted.withColumn("bucket", bucket)
    place = Window.partitionBy("source", "n_tokens", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    placed = rows.withColumn("place", F.row_number().over(place))
    sizes = rows.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("size"))
    running = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0))).drop("size")
    chosen = before.join(plan, ["source", "n_tokens"])
    copies = F.col("passes") + (F.col("before") + F.col("place") <= F.col("extra")).cast("long")
    return (
        placed.join(chosen, ["source", "n_tokens", "bucket"])
        .select("doc_id", "source", "n_tokens", copies.alias("copies"))
        .where("copies > 0")
    )


def share_report(counted: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(source, weight, max_repeat, source_tokens, budget, tokens, share, most_repeats) of every listed source: its own
    tokens, what its weight asks for, what the mixture holds of it, and the share of the mixture that this is. Sources
    without documents have zeros."""
    used = source_plan(counted, targets, seed).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("extra")).alias("extra_tokens"),
        F.max(F.col("passes") + (F.col("extra") > 0).cast("long")).alias("most_repeats"),
        F.max("passes").alias("passes"),
    )
    own = counted.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeat", F.lit(0))).alias("max_repeat")
    )
    zero = F.lit(0).cast("long")
    rows = wanted.join(own, "source", "left").join(used, "source", "left")
    rows = rows.select(
        "source", "weight", "max_repeat",
        F.coalesce("source_tokens", zero).alias("source_tokens"),
        F.coalesce(F.col("passes") * F.col("source_tokens") + F.col("extra_tokens"), zero).alias("tokens"),
        F.coalesce("most_repeats", zero).alias("most_repeats"),
    )
    sums = rows.agg(F.sum("source_tokens").alias("all_tokens"), F.sum("tokens").alias("mixed_tokens"))
    return rows.crossJoin(F.broadcast(sums)).select(
        "source", "weight", "max_repeat", "source_tokens",
        F.round(F.col("weight") * F.col("all_tokens")).cast("long").alias("budget"),
        "tokens",
        F.when(F.col("mixed_tokens") > 0, F.col("tokens") / F.col("mixed_tokens")).otherwise(0.0).alias("share"),
        "most_repeats",
    )
