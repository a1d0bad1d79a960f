"""End to end: from pages to a knowledge base, from documents with mentions to entities, from labelled documents to accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.config import Params
from weftlink.functions.hygiene import cut
from weftlink.operators.candidates import document_candidates, keep_top, prior_table, projected_similarity
from weftlink.operators.graph import node_pairs, page_rank, propagation_edges, topical_relatedness
from weftlink.operators.kb import KnowledgeBase, entity_table, mention_dictionary, title_mentions
from weftlink.operators.links import edges_of_links, mentions_of_links, mentions_of_redirects, wiki_links
from weftlink.operators.mentions import context_vectors, mention_documents, occurrences
from weftlink.operators.pages import document_frequencies, entities_of_pages
from weftlink.operators.ranking import best_by, initial_scores, rerank
from weftlink.sources.sinks import write_nodes, write_scores
from weftlink.sources.texts import read_documents, read_labelled


def score_candidates(parsed: DataFrame, kb: KnowledgeBase, p: Params | None = None) -> DataFrame:
    """(doc_id, sf, entity_id, n, prior, ctx_sim, raw, isa, pa, forms) of every candidate of every mention that has a
    context and a candidate. forms: surviving mentions of the document; where there is one, nothing is propagated and isa
    and pa are 0."""
    p = p or Params()
    mentions = occurrences(parsed).select("doc_id", "sf").distinct()
    kb = kb.for_forms(mentions)  # only what these forms need of the dictionary, the links and the embeddings
    candidates = cut(document_candidates(mentions, prior_table(kb, p)))
    contexts = context_vectors(parsed, kb, p, candidates)
    scored = keep_top(projected_similarity(candidates, contexts, kb.doc_embedding), p.keep_top)
    nodes = initial_scores(scored, p)
    forms = nodes.groupBy("doc_id").agg(F.count_distinct("sf").alias("forms"))
    nodes = cut(nodes.join(forms, "doc_id"))  # read four times from here on
    several = nodes.where("forms > 1")
    pairs = cut(node_pairs(several))
    edges = propagation_edges(pairs, topical_relatedness(pairs, kb.link, kb.pages))
    ranked = page_rank(several, edges, p).select("doc_id", "sf", "entity_id", "pa")
    single = nodes.where("forms = 1").withColumns({"isa": F.lit(0.0), "pa": F.lit(0.0)})
    return several.join(ranked, ["doc_id", "sf", "entity_id"]).unionByName(single)


def choose(scored: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """(doc_id, sf, entity_id, name): by re-ranking where a document has several forms, by the initial score where it has
    one."""
    scored = cut(scored)
    chosen = rerank(scored.where("forms > 1")).unionByName(best_by(scored.where("forms = 1"), "raw"))
    return chosen.join(kb.entity.select("entity_id", "name"), "entity_id").select("doc_id", "sf", "entity_id", "name")


def disambiguate(docs: DataFrame, kb: KnowledgeBase, p: Params | None = None, tokenizer: str = "conll") -> DataFrame:
    """(doc_id, sf, entity_id, name) of the mentions of documents (doc_id, text with ``[[…]]``). Mentions without a usable
    context or candidate give no row."""
    parsed = cut(mention_documents(docs, tokenizer=tokenizer))
    return choose(score_candidates(parsed, kb, p), kb)


def build_knowledge_base(pages: DataFrame, vectors: DataFrame, redirects: DataFrame | None = None, p: Params | None = None, tokenizer: str = "conll") -> KnowledgeBase:
    """The knowledge base of pages (page_id, title, lines; disambiguation pages included, lines in their own case), word
    vectors (word, vec) of any one length, and redirects (title, target), each of which may come from files by
    ``weftlink.sources``. ``save`` it to compute it once.

    Surface forms are counted from entity names, links of pages and redirects; links are the edges; word frequencies and
    embeddings come from the text of the pages. Empty tables give an empty knowledge base.
    """
    p = p or Params()
    spark = pages.sparkSession
    entity = cut(entity_table(entities_of_pages(pages)))
    links = cut(wiki_links(pages, entity, p))
    increments = [title_mentions(entity), mentions_of_links(links)]
    if redirects is not None:
        increments.append(mentions_of_redirects(redirects, entity))
    tokens = cut(document_frequencies(pages, tokenizer))
    none = spark.createDataFrame([], "doc_id long, vec array<double>")
    return KnowledgeBase(entity, cut(mention_dictionary(*increments)), edges_of_links(links), tokens, none, vectors, p)


def disambiguate_file(spark: SparkSession, path: str, kb: KnowledgeBase, out: str | None = None, p: Params | None = None) -> DataFrame:
    """(doc_id, sf, entity_id, name) of the documents in a file or folder. With ``out``, the scores of all candidates and the
    nodes of the graph go to CSV files under it."""
    parsed = cut(mention_documents(read_documents(spark, path)))
    scored = cut(score_candidates(parsed, kb, p))
    if out:
        write_scores(scored, kb.entity, f"{out}/scores")
        write_nodes(scored, f"{out}/nodes")
    return choose(scored, kb)


def evaluate(docs: DataFrame, gold: DataFrame, kb: KnowledgeBase, p: Params | None = None) -> DataFrame:
    """accuracy of the linker on labelled documents (doc_id, tokens, mentions) with gold (doc_id, sf, entity_id)."""
    return accuracy(gold, choose(score_candidates(cut(docs), kb, p), kb))


def evaluate_file(spark: SparkSession, path: str, kb: KnowledgeBase, p: Params | None = None) -> DataFrame:
    """The same for a labelled corpus file or folder."""
    return evaluate(*read_labelled(spark, path), kb, p)


def accuracy(gold: DataFrame, chosen: DataFrame) -> DataFrame:
    """(documents, total, correct, nil) of gold (doc_id, sf, entity_id) against chosen (doc_id, sf, entity_id). A gold form
    without a choice is NIL; documents in which all are NIL do not count. One row, zeros for empty tables."""
    mine = chosen.select("doc_id", "sf", F.col("entity_id").alias("chosen_id"))
    judged = gold.join(mine, ["doc_id", "sf"], "left")
    by_doc = judged.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("chosen_id") == F.col("entity_id")).alias("correct"),
        F.count_if(F.col("chosen_id").isNull()).alias("nil"),
    )
    counted = by_doc.where("total > nil")
    zero = F.lit(0).cast("long")
    return counted.agg(
        F.count("*").alias("documents"),
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("total", "correct", "nil")],
    )
