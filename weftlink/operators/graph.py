"""Relatedness of the candidates of a document by shared inlinks, and the propagation of their scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlink.config import Params
from weftlink.functions.hygiene import cut, ship
from weftlink.operators.candidates import link_statistics


def node_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, sf_a, a, sf_b, b): pairs of candidates of different forms in one document, a form once with each other
    (sf_a < sf_b). nodes: (doc_id, sf, entity_id)."""
    a = nodes.select("doc_id", F.col("sf").alias("sf_a"), F.col("entity_id").alias("a"))
    b = nodes.select("doc_id", F.col("sf").alias("sf_b"), F.col("entity_id").alias("b"))
    return a.join(b, "doc_id").where("sf_a < sf_b")


def linked_pairs(nodes: DataFrame, link: DataFrame) -> DataFrame:
    """node_pairs whose entities have a common inlink, the only ones with a relatedness, without making the others: entities
    meet by (document, source). For few documents of very many candidates, as every document takes the inlinks of its own.
    link: (to_id, from_id), distinct."""
    own = nodes.select("doc_id", "entity_id").distinct()
    met = own.join(link.withColumnRenamed("to_id", "entity_id"), "entity_id")
    a = met.select("doc_id", "from_id", F.col("entity_id").alias("a"))
    b = met.select("doc_id", "from_id", F.col("entity_id").alias("b"))
    met = a.join(b, ["doc_id", "from_id"]).select("doc_id", "a", "b").distinct()
    forms = nodes.select("doc_id", F.col("entity_id").alias("a"), F.col("sf").alias("sf_a"))
    met = met.join(forms, ["doc_id", "a"]).join(forms.withColumnsRenamed({"a": "b", "sf_a": "sf_b"}), ["doc_id", "b"])
    return met.where("sf_a < sf_b").select("doc_id", "sf_a", "a", "sf_b", "b")


def topical_relatedness(pairs: DataFrame, link: DataFrame, pages: DataFrame) -> DataFrame:
    """(a, b, tr) for distinct entity pairs (a, b) with a common inlink; others have relatedness 0 and no row. pages: one
    row (wp), the number of pages.

    tr = 1 - (ln max - ln shared) / (ln wp - ln min) over the sizes of the two inlink sets; NULL, hence no row, where the
    denominator is not positive. Shared inlinks are counted from the smaller set of a pair, whose links are joined with
    those of the larger by (target, source): a target with very many inlinks is never expanded for a pair, and no array of
    inlinks is built.
    """
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = once.select(F.col("a").alias("entity_id")).unionByName(once.select(F.col("b").alias("entity_id")))
    sizes = link_statistics(ends, link)
    sized = once.join(sizes.select(F.col("entity_id").alias("a"), F.col("inlinks").alias("na")), "a")
    sized = sized.join(sizes.select(F.col("entity_id").alias("b"), F.col("inlinks").alias("nb")), "b")
    smaller = F.col("na") <= F.col("nb")
    sized = sized.select(
        "a", "b", "na", "nb",
        F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("small"),
        F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("large"),
    )
    wanted = ends.select(F.col("entity_id").alias("to_id")).distinct()
    edges = link.join(wanted, "to_id", "left_semi")
    small = sized.join(edges.select(F.col("to_id").alias("small"), "from_id"), "small")
    shared = small.join(edges.select(F.col("to_id").alias("large"), "from_id"), ["large", "from_id"])
    counted = shared.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).crossJoin(F.broadcast(pages))  # one row
    bottom = F.log("wp") - F.log(F.least("na", "nb"))
    top = F.log(F.greatest("na", "nb")) - F.log("shared")
    return counted.select("a", "b", F.when(bottom > 0, 1 - top / bottom).alias("tr")).where("tr is not null")


def propagation_edges(pairs: DataFrame, relatedness: DataFrame) -> DataFrame:
    """(doc_id, src_sf, src, dst_sf, dst, w): both directions of every pair with positive relatedness, the weights that
    leave a node summing to 1. An entity under two forms is related to itself by 1."""
    keyed = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    related = relatedness.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "tr")
    half = keyed.join(related, ["lo", "hi"]).where("tr > 0").select("doc_id", "sf_a", "a", "sf_b", "b", "tr")
    there = half.select("doc_id", F.col("sf_a").alias("src_sf"), F.col("a").alias("src"), F.col("sf_b").alias("dst_sf"), F.col("b").alias("dst"), "tr")
    back = half.select("doc_id", F.col("sf_b").alias("src_sf"), F.col("b").alias("src"), F.col("sf_a").alias("dst_sf"), F.col("a").alias("dst"), "tr")
    leaving = Window.partitionBy("doc_id", "src_sf", "src")
    return there.unionByName(back).withColumn("w", F.col("tr") / F.sum("tr").over(leaving)).drop("tr")


def page_rank_rounds(nodes: DataFrame, edges: DataFrame, rounds: int, p: Params | None = None, every: int = 4) -> DataFrame:
    """(doc_id, sf, entity_id, isa, pa) after exactly ``rounds`` rounds for all documents together; nodes: (doc_id, sf,
    entity_id, isa) with isa summing to 1 in a document. For graphs too large for one task; the state is cut from its
    lineage every few rounds. A document may be the whole graph: its total is added up in every task first, and a join on
    few documents is one that Spark broadcasts or adaptive execution splits."""
    p = p or Params()
    key = ["doc_id", "sf", "entity_id"]
    base = cut(nodes.select(*key, "isa"))
    edges = cut(edges)
    state = base.select(*key, F.col("isa").alias("s"))
    for i in range(1, rounds + 1):
        source = state.select("doc_id", F.col("sf").alias("src_sf"), F.col("entity_id").alias("src"), "s")
        flow = edges.join(source, ["doc_id", "src_sf", "src"]).groupBy("doc_id", "dst_sf", "dst").agg(F.sum(F.col("w") * F.col("s")).alias("inflow"))
        flow = flow.select("doc_id", F.col("dst_sf").alias("sf"), F.col("dst").alias("entity_id"), "inflow")
        s = F.lit(p.damping) * F.col("isa") + F.lit(1 - p.damping) * F.coalesce("inflow", F.lit(0.0))
        state = base.join(flow, key, "left").select(*key, s.alias("s"))
        total = state.groupBy("doc_id").agg(F.sum("s").alias("total"))  # combines first: a document may be the whole graph
        state = state.join(total, "doc_id").select(*key, F.coalesce(F.try_divide("s", "total"), F.lit(0.0)).alias("s"))
        if i % every == 0 and i < rounds:
            state = cut(state)
    return base.join(state, key).select(*key, "isa", F.col("s").alias("pa"))


def propagate(score: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, p: Params) -> tuple[np.ndarray, int]:
    """Propagated scores of one document and the rounds they took; stops at an L2 change of at most the tolerance."""
    total = score.sum()
    if not len(score) or total <= 0:
        return np.zeros_like(score), 0
    start = score / total
    s, rounds = start, 0
    while True:
        nxt = p.damping * start + (1 - p.damping) * np.bincount(dst, weights=w * s[src], minlength=len(s))
        nxt /= nxt.sum()
        rounds += 1
        change = float(np.linalg.norm(nxt - s))
        s = nxt
        if change <= p.tolerance:
            return s, rounds
        if rounds >= p.rounds:
            raise ArithmeticError(f"no convergence within {rounds} rounds: the scores still change by {change:g}")


def page_rank(nodes: DataFrame, edges: DataFrame, p: Params | None = None) -> DataFrame:
    """(doc_id, sf, entity_id, isa, pa): scores propagated to convergence, each document as one group of its nodes and its
    edges (at most keep_top candidates a form)."""
    p = p or Params()
    ship(nodes.sparkSession)
    kind = nodes.schema["doc_id"].dataType.simpleString()

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        at = {k: i for i, k in enumerate(zip(own["sf"], own["entity_id"], strict=True))}
        src = np.array([at[k] for k in zip(links["src_sf"], links["src"], strict=True)], dtype=np.int64)
        dst = np.array([at[k] for k in zip(links["dst_sf"], links["dst"], strict=True)], dtype=np.int64)
        pa, _ = propagate(own["isa"].to_numpy(np.float64), src, dst, links["w"].to_numpy(np.float64), p)
        return own[["doc_id", "sf", "entity_id", "isa"]].assign(pa=pa)

    left = nodes.select("doc_id", "sf", "entity_id", "isa").groupBy("doc_id")
    right = edges.select(F.col("doc_id").alias("edge_doc"), "src_sf", "src", "dst_sf", "dst", "w").groupBy("edge_doc")
    return left.cogroup(right).applyInPandas(run, f"doc_id {kind}, sf string, entity_id long, isa double, pa double")
