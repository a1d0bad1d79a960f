"""Scores of candidates and the choice among them. Every tie goes to the smaller entity id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlink.config import Params


def initial_scores(scored: DataFrame, p: Params | None = None) -> DataFrame:
    """scored with raw, the weighted sum of prior and context similarity, and isa, its share of the document's sum."""
    p = p or Params()
    raw = F.lit(p.alpha) * F.col("prior") + F.lit(p.beta) * F.col("ctx_sim")
    share = F.try_divide(F.col("raw"), F.sum("raw").over(Window.partitionBy("doc_id")))
    return scored.withColumn("raw", raw).withColumn("isa", F.coalesce(share, F.lit(0.0)))


def best_by(scored: DataFrame, score: str) -> DataFrame:
    """(doc_id, sf, entity_id): the candidate of the largest positive score of each mention; mentions without one vanish."""
    best = scored.where(F.col(score) > 0).groupBy("doc_id", "sf").agg(
        F.min_by("entity_id", F.struct(-F.col(score), "entity_id")).alias("entity_id")
    )
    return best.select("doc_id", "sf", "entity_id")


def rerank(scored: DataFrame) -> DataFrame:
    """(doc_id, sf, entity_id): the choice between the sum and the product of initial and propagated score.

    Both scores are normalised within the mention, then their sums and their products; the criterion whose first place is
    further from its second decides, the product if both are as far. A mention with one candidate keeps it.
    """
    mention = Window.partitionBy("doc_id", "sf")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(mention)), F.lit(0.0))
    rows = scored.select("doc_id", "sf", "entity_id", share("isa").alias("i"), share("pa").alias("q"))
    rows = rows.select("doc_id", "sf", "entity_id", (F.col("i") + F.col("q")).alias("sum"), (F.col("i") * F.col("q")).alias("mul"))
    rows = rows.select("doc_id", "sf", "entity_id", share("sum").alias("sum"), share("mul").alias("mul"))
    # the two best of either criterion; a mention has at most Params.keep_top candidates, so its list is short
    top = lambda c: F.slice(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), "entity_id"))), 1, 2)
    best = rows.groupBy("doc_id", "sf").agg(top("sum").alias("by_sum"), top("mul").alias("by_mul"))
    gap = lambda c: F.coalesce(F.try_element_at(F.col(c), F.lit(2))["s"], F.lit(0.0)) - F.col(c)[0]["s"]
    gap_sum, gap_mul = gap("by_sum"), gap("by_mul")
    choice = F.when(gap_sum > gap_mul, F.col("by_sum")[0]["entity_id"]).otherwise(F.col("by_mul")[0]["entity_id"])
    return best.select("doc_id", "sf", choice.alias("entity_id"))
