"""Candidate entities of surface forms, with their prior, context similarity, and the removal of the common component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlink.config import Params
from weftlink.functions.hygiene import ship
from weftlink.functions.vectors import nonzero, unit_cosine
from weftlink.operators.kb import KnowledgeBase, inlink_counts


def candidate_priors(mention: DataFrame, link: DataFrame, doc_embedding: DataFrame, entity: DataFrame, p: Params | None = None) -> DataFrame:
    """(sf, entity_id, n, prior): the valid candidates of every surface form, once for all documents.

    Forms with more than ``many_candidates`` entities lose those counted ``rare_count`` times or less. A candidate needs a
    name, an inlink and a non-zero embedding. The prior is its share of the counts of what is left. Both per-form numbers
    come back by a join on the form, which adaptive execution splits where a form is hot: no task holds all its candidates.
    """
    p = p or Params()
    sizes = mention.groupBy("sf").agg(F.count("*").alias("k"))
    kept = mention.join(sizes, "sf").where((F.col("k") <= p.many_candidates) | (F.col("n") > p.rare_count)).drop("k")
    valid = entity.select("entity_id").join(doc_embedding.select(F.col("doc_id").alias("entity_id")), "entity_id", "left_semi")
    valid = valid.join(link.select(F.col("to_id").alias("entity_id")), "entity_id", "left_semi")
    kept = kept.join(valid, "entity_id", "left_semi")
    sums = kept.groupBy("sf").agg(F.sum("n").alias("all_n"))
    return kept.join(sums, "sf").select("sf", "entity_id", "n", (F.col("n") / F.col("all_n")).alias("prior"))


def prior_table(kb: KnowledgeBase, p: Params | None = None) -> DataFrame:
    """candidate_priors of a knowledge base."""
    return candidate_priors(kb.mention, kb.link, kb.doc_embedding, kb.entity, p)


def document_candidates(mentions: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc_id, sf, entity_id, n, prior) for (doc_id, sf) mentions; mentions without a candidate vanish."""
    return mentions.select("doc_id", "sf").distinct().join(priors, "sf").select("doc_id", "sf", "entity_id", "n", "prior")


def nil_mentions(mentions: DataFrame, candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """(doc_id, sf) without a candidate, or without a context vector that is not zero."""
    usable = contexts.where(nonzero(F.col("vec"))).select("doc_id", "sf")
    linked = candidates.select("doc_id", "sf").join(usable, ["doc_id", "sf"], "left_semi")
    return mentions.select("doc_id", "sf").distinct().join(linked, ["doc_id", "sf"], "left_anti")


def context_similarity(candidates: DataFrame, contexts: DataFrame, embedding: DataFrame) -> DataFrame:
    """candidates with ctx_sim, the cosine of context and entity vectors mapped to [0, 1]. Mentions without a context
    vector vanish; zero vectors after projection give 0.5."""
    entity = embedding.select(F.col("doc_id").alias("entity_id"), F.col("vec").alias("entity_vec"))
    rows = candidates.join(contexts.select("doc_id", "sf", F.col("vec").alias("context_vec")), ["doc_id", "sf"])
    rows = rows.join(entity, "entity_id")
    return rows.withColumn("ctx_sim", unit_cosine(F.col("context_vec"), F.col("entity_vec"))).drop("context_vec", "entity_vec")


def first_component(x: np.ndarray) -> np.ndarray:
    """First right singular vector, uncentred, from the d × d Gram matrix; its sign is of no consequence."""
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, -1]


def projected_similarity(candidates: DataFrame, contexts: DataFrame, embedding: DataFrame) -> DataFrame:
    """candidates with ctx_sim after the common component of each document is removed: the first right singular vector
    over its distinct candidate entities and its contexts is projected out of both sides before the cosine.

    The rows of a document lie together in a sorted partition, and Python holds one Arrow batch and one document at a time.
    Vectors travel as float64 arrays with the rows they belong to.
    """
    ship(candidates.sparkSession)
    entity = embedding.select(F.col("doc_id").alias("entity_id"), F.col("vec").alias("entity_vec"))
    rows = candidates.join(entity, "entity_id")
    rows = rows.join(contexts.select("doc_id", "sf", F.col("vec").alias("context_vec")), ["doc_id", "sf"])
    doc = rows.schema["doc_id"].dataType.simpleString()

    def project(group: pd.DataFrame) -> np.ndarray:
        e, c = np.stack(group["entity_vec"]), np.stack(group["context_vec"])
        once_e = e[~group["entity_id"].duplicated().to_numpy()]
        once_c = c[~group["sf"].duplicated().to_numpy()]
        v = first_component(np.concatenate([once_e, once_c]))
        e, c = e - np.outer(e @ v, v), c - np.outer(c @ v, v)
        lengths = np.linalg.norm(e, axis=1) * np.linalg.norm(c, axis=1)
        cosine = np.divide((e * c).sum(1), lengths, out=np.zeros(len(e)), where=lengths > 1e-12)
        return (1 + cosine) / 2

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["doc_id"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        sims = [project(rows.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return rows[["doc_id", "sf", "entity_id", "n", "prior"]].assign(ctx_sim=np.concatenate(sims))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # the last document so far, which the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            last = batch["doc_id"].iloc[-1]
            if rest and rest[0]["doc_id"].iloc[0] == batch["doc_id"].iloc[0] == last:
                rest.append(batch)
                continue
            all_rows = pd.concat([*rest, batch], ignore_index=True)
            whole = (all_rows["doc_id"] != last).to_numpy()
            if whole.any():
                yield done(all_rows[whole])
            rest = [all_rows[~whole]]
        if rest:
            yield done(pd.concat(rest, ignore_index=True))

    columns = ["doc_id", "sf", "entity_id", "n", "prior", "context_vec", "entity_vec"]
    schema = f"doc_id {doc}, sf string, entity_id long, n long, prior double, ctx_sim double"
    return rows.select(*columns).repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(run, schema)


def keep_top(scored: DataFrame, k: int) -> DataFrame:
    """At most k candidates of each mention, by context similarity; ties go to the smaller id. Spark pushes the limit below
    the shuffle, so a form with very many candidates sends k rows a task."""
    order = Window.partitionBy("doc_id", "sf").orderBy(F.col("ctx_sim").desc(), "entity_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def link_statistics(candidates: DataFrame, link: DataFrame) -> DataFrame:
    """(entity_id, inlinks) of the entities among the candidates."""
    wanted = candidates.select(F.col("entity_id").alias("to_id")).distinct()
    return inlink_counts(link.join(wanted, "to_id", "left_semi")).withColumnRenamed("to_id", "entity_id")

