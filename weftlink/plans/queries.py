"""Queries of the core operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlink.config import Params
from weftlink.functions.hygiene import cut, table
from weftlink.functions.text import is_disambiguation, is_entity_title, words
from weftlink.functions.tokenizer import MAX_TOKEN, curated, tokenize_column
from weftlink.operators import candidates as C
from weftlink.operators import graph as G
from weftlink.operators import kb as K
from weftlink.operators import links as L
from weftlink.operators import mentions as M
from weftlink.operators import ranking as R
from weftlink.operators.hot_keys import hot_keys, skew_distinct_count, skew_sum
from weftlink.operators.pages import document_frequencies, page_lines
from weftlink.operators.sif import document_embedding, total_frequency, weighted_words
from weftlink.plans import pipeline
from weftlink.sources.texts import labelled_mentions

P = Params()
ROUNDS = 8
#: Inlinks of a small piece, and candidates kept of a form, in the queries that show either.
SMALL_PIECE, TOP = 256, 3


def _t(spark: SparkSession, data: str, *names: str) -> list[DataFrame]:
    return [table(spark, data, n) for n in names]


def knowledge_base(spark: SparkSession, data: str) -> K.KnowledgeBase:
    """The knowledge base of the stored tables."""
    return K.KnowledgeBase(*_t(spark, data, "entity", "mention_count", "link", "doc_token", "doc_embedding", "word_embedding"), P)


def entity_table(spark: SparkSession, data: str) -> DataFrame:
    return K.entity_table(table(spark, data, "entity"))


def entity_duplicates(spark: SparkSession, data: str) -> DataFrame:
    """Lower-case names that several entities share, and ids with several names."""
    entity = table(spark, data, "entity")
    by_id = K.duplicate_keys(entity, "entity_id", "name").select(F.col("entity_id").cast("string").alias("key"), "versions")
    lower = entity.select(F.lower("name").alias("key"), "entity_id")
    return by_id.unionByName(K.duplicate_keys(lower, "key", "entity_id"))


def mention_dictionary(spark: SparkSession, data: str) -> DataFrame:
    return K.mention_dictionary(table(spark, data, "mention_count"))


def incremental_dictionary(spark: SparkSession, data: str) -> DataFrame:
    """The dictionary merged from the increments of the first directory and of all others: equal to one pass."""
    rows = table(spark, data, "mention_count")
    first = F.coalesce(F.col("src_dir") == "AA", F.lit(False))
    return K.mention_dictionary(K.mention_dictionary(rows.where(first)), K.mention_dictionary(rows.where(~first)))


def title_mentions(spark: SparkSession, data: str) -> DataFrame:
    return K.title_mentions(K.entity_table(table(spark, data, "entity")))


def inlink_edges(spark: SparkSession, data: str) -> DataFrame:
    return K.link_set(table(spark, data, "link"))


def inlink_counts(spark: SparkSession, data: str) -> DataFrame:
    return K.inlink_counts(K.link_set(table(spark, data, "link")))


def _inlinks(spark: SparkSession, data: str, most: int) -> DataFrame:
    rows = K.inlink_pieces(cut(K.link_set(table(spark, data, "link"))), most)
    return rows.select("to_id", "piece", F.array_join("from_ids", ",").alias("from_ids"))


def inlink_arrays(spark: SparkSession, data: str) -> DataFrame:
    """The nested view: the inlink set of every entity, those of very many in pieces."""
    return _inlinks(spark, data, K.PIECE_LINKS)


def inlink_pieces(spark: SparkSession, data: str) -> DataFrame:
    """The same in pieces so small that every hot entity has several."""
    return _inlinks(spark, data, SMALL_PIECE)


def word_freq(spark: SparkSession, data: str) -> DataFrame:
    return knowledge_base(spark, data).word_freq


def total_word_count(spark: SparkSession, data: str) -> DataFrame:
    return total_frequency(knowledge_base(spark, data).word_freq)


def sif_word_weight(spark: SparkSession, data: str) -> DataFrame:
    kb = knowledge_base(spark, data)
    return weighted_words(kb.word_vec, kb.word_freq, P).select("word", F.round("weight", 6).alias("weight"))


def _long(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("doc_id", F.posexplode("vec").alias("dim", "x"))
    return rows.select("doc_id", "dim", (F.round("x", 4) + F.lit(0.0)).alias("x"))


def sif_doc_embedding(spark: SparkSession, data: str) -> DataFrame:
    kb = knowledge_base(spark, data)
    return _long(document_embedding(kb.doc_token, kb.word_vec, kb.word_freq, P, kb.dim))


def doc_embedding_complete(spark: SparkSession, data: str) -> DataFrame:
    """Stored embeddings, and computed ones where none is stored."""
    return _long(knowledge_base(spark, data).doc_embedding)


def page_links(spark: SparkSession, data: str) -> DataFrame:
    return L.page_links(table(spark, data, "wiki_page")).select("page_id", "href", "anchor")


def _wiki_links(spark: SparkSession, data: str) -> DataFrame:
    return L.wiki_links(table(spark, data, "wiki_page"), K.entity_table(table(spark, data, "entity")), P)


def resolve_links(spark: SparkSession, data: str) -> DataFrame:
    return _wiki_links(spark, data)


def mention_sources(spark: SparkSession, data: str) -> DataFrame:
    """The dictionary from scratch: entity names and links of pages."""
    entity = K.entity_table(table(spark, data, "entity"))
    return K.mention_dictionary(K.title_mentions(entity), L.mentions_of_links(_wiki_links(spark, data)))


def link_sources(spark: SparkSession, data: str) -> DataFrame:
    """The link set from scratch."""
    return L.edges_of_links(_wiki_links(spark, data))


def disambiguation_filter(spark: SparkSession, data: str) -> DataFrame:
    """Titles of pages and entities with what the two title filters say of them; some titles of either kind are added."""
    titles = table(spark, data, "wiki_page").select("title").unionByName(table(spark, data, "entity").select(F.col("name").alias("title")))
    extra = [("Mercury (disambiguation)",), ("List of rivers",), ("lists  of X",), ("Template:Box",), ("Category:Y",), ("File:z.png",), ("Wikipedia:About",), ("Listening",)]
    rows = titles.unionByName(spark.createDataFrame(extra, "title string")).where("title is not null").distinct()
    t = F.col("title")
    return rows.select("title", is_disambiguation(t).alias("disambiguation"), is_entity_title(t).alias("entity_title"))


def page_text(spark: SparkSession, data: str) -> DataFrame:
    """Text of every line without tags."""
    return page_lines(table(spark, data, "wiki_page"))


def doc_token_freq(spark: SparkSession, data: str) -> DataFrame:
    """Term frequencies of the pages by white-space words, cut and curated by built-in functions."""
    tokens = page_lines(table(spark, data, "wiki_page")).select("page_id", F.explode(curated(words(F.lower("text")))).alias("word"))
    return tokens.groupBy("page_id", "word").agg(F.count("*").alias("f"))


def doc_token_freq_conll(spark: SparkSession, data: str) -> DataFrame:
    """Term frequencies of the pages by the full tokenizer."""
    return document_frequencies(table(spark, data, "wiki_page")).withColumnRenamed("doc_id", "page_id")


#: Lines and their tokens by the full tokenizer, which SQL holds as well.
GOLDENS = (
    "it's up.", "don't", 'up,"', 'he said "rize."', "wait... and", "us$5 or $1.5", "and/or 1996/97", "in 2005.", "2005.", "the u.s. is",
    "in the u.s.", "mr. x came", "foo-$5", "SOCCER-Late", "1-Jan x", "5.Mai x", "J.Smith x", "xx..yy", "--x", "he said (yes)", "http://a/b",
    "really?", "abc.-Def x", "we'll go", "x(y)z", "", "  ",
)


def tokenizer_goldens(spark: SparkSession, data: str) -> DataFrame:
    """The curated tokens of some fixed lines, joined by blanks; a URL is curated away."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(GOLDENS)], "line_no int, line string")
    return tokenize_column(rows, "line_no", "line").select("line_no", F.array_join("tokens", " ").alias("tokens"))


def token_length_filter(spark: SparkSession, data: str) -> DataFrame:
    """Words of the documents that curation drops: too long, or a URL."""
    tokens = table(spark, data, "documents").where("text is not null").select("doc_id", F.explode(words(F.lower("text"))).alias("word"))
    dropped = tokens.where((F.length("word") > MAX_TOKEN) | (F.size(curated(F.array("word"))) == 0))
    return dropped.groupBy("doc_id", "word").agg(F.count("*").alias("f"))


def _parsed(spark: SparkSession, data: str) -> DataFrame:
    return M.mention_documents(table(spark, data, "documents"), tokenizer="simple")


def mention_markup(spark: SparkSession, data: str) -> DataFrame:
    return M.occurrences(_parsed(spark, data))


def context_window(spark: SparkSession, data: str) -> DataFrame:
    return M.context_words(_parsed(spark, data), P)


def candidates_prior(spark: SparkSession, data: str) -> DataFrame:
    return C.prior_table(knowledge_base(spark, data), P).select("sf", "entity_id", "n", F.round("prior", 6).alias("prior"))


def _candidates(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame, K.KnowledgeBase]:
    """The documents, the candidates of their forms, and the part of the knowledge base that these need."""
    parsed = cut(_parsed(spark, data))
    kb = knowledge_base(spark, data).for_forms(M.occurrences(parsed))
    return parsed, C.document_candidates(M.occurrences(parsed), C.prior_table(kb, P)), kb


def nil_mentions(spark: SparkSession, data: str) -> DataFrame:
    """Mentions without a candidate or a usable context."""
    parsed, candidates, kb = _candidates(spark, data)
    return C.nil_mentions(M.occurrences(parsed), candidates, M.context_vectors(parsed, kb, P))


def _scored(spark: SparkSession, data: str) -> tuple[DataFrame, K.KnowledgeBase]:
    parsed, candidates, kb = _candidates(spark, data)
    candidates = cut(candidates)
    return C.context_similarity(candidates, M.context_vectors(parsed, kb, P, candidates), kb.doc_embedding), kb


def context_similarity(spark: SparkSession, data: str) -> DataFrame:
    """Similarities without removal of the common component."""
    scored, _ = _scored(spark, data)
    return scored.select("doc_id", "sf", "entity_id", F.round("ctx_sim", 4).alias("ctx_sim"))


def common_component(spark: SparkSession, data: str) -> DataFrame:
    """Similarities after removal of the common component of each document."""
    parsed, candidates, kb = _candidates(spark, data)
    candidates = cut(candidates)
    scored = C.projected_similarity(candidates, M.context_vectors(parsed, kb, P, candidates), kb.doc_embedding)
    return scored.select("doc_id", "sf", "entity_id", F.round("ctx_sim", 4).alias("ctx_sim"))


def topk_candidates(spark: SparkSession, data: str) -> DataFrame:
    """The three best candidates of each mention."""
    top = C.keep_top(_scored(spark, data)[0].withColumn("ctx_sim", F.round("ctx_sim", 6)), TOP)
    return top.select("doc_id", "sf", "entity_id", F.round("ctx_sim", 4).alias("ctx_sim"))


def _nodes(spark: SparkSession, data: str) -> tuple[DataFrame, K.KnowledgeBase]:
    scored, kb = _scored(spark, data)
    return cut(R.initial_scores(C.keep_top(scored, P.keep_top), P)), kb


def initial_score(spark: SparkSession, data: str) -> DataFrame:
    nodes, _ = _nodes(spark, data)
    return nodes.select("doc_id", "sf", "entity_id", F.round("raw", 4).alias("raw"), F.round("isa", 6).alias("isa"))


def initial_choice(spark: SparkSession, data: str) -> DataFrame:
    nodes, _ = _nodes(spark, data)
    return R.best_by(nodes.withColumn("raw", F.round("raw", 9)), "raw")


def _graph(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, kb = _nodes(spark, data)
    pairs = cut(G.node_pairs(nodes))
    related = G.topical_relatedness(pairs, kb.link, kb.pages)
    return nodes, pairs, related, G.propagation_edges(pairs, related)


def topical_relatedness(spark: SparkSession, data: str) -> DataFrame:
    return _graph(spark, data)[2].select("a", "b", F.round("tr", 6).alias("tr"))


def propagation_matrix(spark: SparkSession, data: str) -> DataFrame:
    return _graph(spark, data)[3].withColumn("w", F.round("w", 6))


def pagerank_fixed_k(spark: SparkSession, data: str) -> DataFrame:
    nodes, _, _, edges = _graph(spark, data)
    ranked = G.page_rank_rounds(nodes, edges, ROUNDS, P)
    return ranked.select("doc_id", "sf", "entity_id", F.round("pa", 6).alias("pa"))


def pagerank_converged(spark: SparkSession, data: str) -> DataFrame:
    nodes, _, _, edges = _graph(spark, data)
    return G.page_rank(nodes, edges, P).select("doc_id", "sf", "entity_id", F.round("pa", 6).alias("pa"))


def rerank(spark: SparkSession, data: str) -> DataFrame:
    """Re-ranking of the scores after a fixed number of rounds."""
    nodes, _, _, edges = _graph(spark, data)
    ranked = G.page_rank_rounds(nodes, edges, ROUNDS, P)
    return R.rerank(ranked.withColumns({"isa": F.round("isa", 9), "pa": F.round("pa", 9)}))


def _dictionary(spark: SparkSession, data: str) -> tuple[DataFrame, K.KnowledgeBase]:
    """The whole dictionary as documents, one for all forms of a length, in which every operator has much to decide: the
    context of a form is the embedding of its most counted candidate."""
    kb = knowledge_base(spark, data)
    priors = cut(C.prior_table(kb, P))
    length = F.length("sf").cast("long").alias("doc_id")
    best = priors.groupBy("sf").agg(F.min_by("entity_id", F.struct(-F.col("n"), "entity_id")).alias("best"))
    contexts = best.join(kb.doc_embedding.withColumnRenamed("doc_id", "best"), "best").select(length, "sf", "vec")
    return C.context_similarity(priors.select(length, "*"), contexts, kb.doc_embedding), kb


def dictionary_topk(spark: SparkSession, data: str) -> DataFrame:
    """The three best candidates of every form of the dictionary."""
    scored, _ = _dictionary(spark, data)
    top = C.keep_top(scored.withColumn("ctx_sim", F.round("ctx_sim", 6)), TOP)
    return top.select("sf", "entity_id", F.round("ctx_sim", 3).alias("ctx_sim"))


def _dictionary_graph(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame]:
    scored, kb = _dictionary(spark, data)
    nodes = cut(R.initial_scores(C.keep_top(scored, P.keep_top), P))
    link = cut(kb.link.join(nodes.select(F.col("entity_id").alias("to_id")).distinct(), "to_id", "left_semi"))
    pairs = cut(G.linked_pairs(nodes, link))
    return nodes, G.propagation_edges(pairs, G.topical_relatedness(pairs, link, kb.pages))


def dictionary_propagation(spark: SparkSession, data: str) -> DataFrame:
    """The propagation matrices of the dictionary."""
    return _dictionary_graph(spark, data)[1].withColumn("w", F.round("w", 6))


def dictionary_converged(spark: SparkSession, data: str) -> DataFrame:
    """Scores propagated to convergence over the dictionary."""
    return G.page_rank(*_dictionary_graph(spark, data), P).select("sf", "entity_id", F.round("pa", 6).alias("pa"))


def dictionary_rerank(spark: SparkSession, data: str) -> DataFrame:
    """Re-ranking of the dictionary after a fixed number of rounds."""
    ranked = G.page_rank_rounds(*_dictionary_graph(spark, data), ROUNDS, P)
    return R.rerank(ranked.withColumns({"isa": F.round("isa", 9), "pa": F.round("pa", 9)})).select("sf", "entity_id")


def dictionary_best(spark: SparkSession, data: str) -> DataFrame:
    """The candidate of the largest propagated score, by itself."""
    ranked = G.page_rank_rounds(*_dictionary_graph(spark, data), ROUNDS, P)
    return R.best_by(ranked.withColumn("pa", F.round("pa", 9)), "pa").select("sf", "entity_id")


def _link_graph(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole link table as one graph: nodes with their share of all inlinks, the pairs of linked entities, relatedness."""
    entity, link = K.entity_table(table(spark, data, "entity")), cut(K.link_set(table(spark, data, "link")))
    both = link.join(entity.select(F.col("entity_id").alias("from_id")), "from_id", "left_semi").where("to_id <> from_id")
    pair = both.select(F.least("to_id", "from_id").alias("a"), F.greatest("to_id", "from_id").alias("b")).distinct()
    pairs = cut(pair.select(F.lit(1).cast("long").alias("doc_id"), F.lit("page").alias("sf_a"), "a", F.lit("page").alias("sf_b"), "b"))
    related = cut(G.topical_relatedness(pairs, link, entity.agg(F.count("*").alias("wp"))))
    counts, total = K.inlink_counts(link), link.agg(F.count("*").alias("links"))
    nodes = counts.crossJoin(F.broadcast(total)).select(  # one row
        F.lit(1).cast("long").alias("doc_id"), F.lit("page").alias("sf"), F.col("to_id").alias("entity_id"), (F.col("inlinks") / F.col("links")).alias("isa")
    )
    return nodes, pairs, related


def link_relatedness(spark: SparkSession, data: str) -> DataFrame:
    """Relatedness of all linked entities that share an inlink."""
    return _link_graph(spark, data)[2].select("a", "b", F.round("tr", 6).alias("tr"))


def link_pagerank(spark: SparkSession, data: str) -> DataFrame:
    """Inlink shares propagated over the relatedness of linked entities, the link table being one graph."""
    nodes, pairs, related = _link_graph(spark, data)
    ranked = G.page_rank_rounds(nodes, G.propagation_edges(pairs, related), ROUNDS, P)
    return ranked.select("entity_id", F.round("pa", 8).alias("pa"))


def evaluate_accuracy(spark: SparkSession, data: str) -> DataFrame:
    """The linker, with re-ranking after a fixed number of rounds, against the documents' forms that are the name of just
    one entity."""
    names = K.entity_table(table(spark, data, "entity")).groupBy("name_lower").agg(F.count("*").alias("k"), F.min("entity_id").alias("entity_id"))
    forms = M.occurrences(_parsed(spark, data)).select("doc_id", "sf").distinct()
    gold = forms.join(names.where("k = 1").select(F.col("name_lower").alias("sf"), "entity_id"), "sf").select("doc_id", "sf", "entity_id")
    return pipeline.accuracy(gold, rerank(spark, data))


def evaluate_prior(spark: SparkSession, data: str) -> DataFrame:
    """A baseline: links of the pages as labelled mentions, against the most likely entity of each form by its prior."""
    links = _wiki_links(spark, data).where("not from_disambiguation")
    gold = links.groupBy(F.col("page_id").alias("doc_id"), "sf").agg(F.max("entity_id").alias("entity_id"))
    priors = C.prior_table(knowledge_base(spark, data), P)
    best = priors.groupBy("sf").agg(F.min_by("entity_id", F.struct(-F.col("n"), "entity_id")).alias("entity_id"))
    chosen = gold.select("doc_id", "sf").join(best, "sf")
    return pipeline.accuracy(gold, chosen)


def conll_mentions(spark: SparkSession, data: str) -> DataFrame:
    """Gaps and islands of labelled rows: an order is a document, a line a token, its flag the mark."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, data, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.row_number().over(line) - 1).alias("line_no"), "l_returnflag", "l_partkey", "l_suppkey"
    )
    starts = F.col("l_returnflag") == "R"
    tokens = rows.select(
        "doc_id", "line_no",
        F.when(starts, "B").when(F.col("l_returnflag") == "A", "I").alias("mark"),
        F.when(starts, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("sf"),
        F.when(starts, F.col("l_partkey")).alias("gold"),
    )
    return labelled_mentions(tokens)


def disambiguate(spark: SparkSession, data: str) -> DataFrame:
    """All documents, end to end, with the full tokenizer."""
    return pipeline.disambiguate(table(spark, data, "documents"), knowledge_base(spark, data), P)


def redirect_mentions(spark: SparkSession, data: str) -> DataFrame:
    """Redirects: the name of every entity with an article before it, in capitals, stands for the entity."""
    entity = K.entity_table(table(spark, data, "entity"))
    redirects = entity.select(F.concat(F.lit("The "), F.upper("name")).alias("title"), F.col("name").alias("target"))
    return L.mentions_of_redirects(redirects, entity)


def _built(spark: SparkSession, data: str) -> K.KnowledgeBase:
    """A knowledge base built from pages and word vectors alone."""
    return pipeline.build_knowledge_base(*_t(spark, data, "wiki_page", "word_embedding"), p=P, tokenizer="simple")


def kb_build_entity(spark: SparkSession, data: str) -> DataFrame:
    return _built(spark, data).entity


def kb_build_mention(spark: SparkSession, data: str) -> DataFrame:
    return _built(spark, data).mention


def kb_build_link(spark: SparkSession, data: str) -> DataFrame:
    return _built(spark, data).link


def kb_build_doc_token(spark: SparkSession, data: str) -> DataFrame:
    return _built(spark, data).doc_token


def kb_build_word_freq(spark: SparkSession, data: str) -> DataFrame:
    return _built(spark, data).word_freq


def kb_build_embedding(spark: SparkSession, data: str) -> DataFrame:
    return _long(_built(spark, data).doc_embedding)


def p6_found(spark: SparkSession, data: str) -> DataFrame:
    """Keys of link and mention_count that hold more than 2 percent of the rows."""
    link, mention = table(spark, data, "link"), table(spark, data, "mention_count")
    return (
        hot_keys(link, "to_id")
        .select(F.lit("link").alias("kind"), F.col("to_id").cast("string").alias("key"))
        .unionByName(hot_keys(mention, "sf").select(F.lit("mention_count").alias("kind"), F.col("sf").alias("key")))
    )


def p6_inlink_sizes(spark: SparkSession, data: str) -> DataFrame:
    """Size of every inlink set."""
    return skew_distinct_count(table(spark, data, "link"), "to_id", "from_id", "inlinks")


def p6_candidate_counts(spark: SparkSession, data: str) -> DataFrame:
    """Summed count of every (typed name, entity)."""
    return skew_sum(table(spark, data, "mention_count"), "sf", "entity_id", "n", "n")


QUERIES = {
    f.__name__: f
    for f in (
        entity_table, entity_duplicates, mention_dictionary, incremental_dictionary, title_mentions, inlink_edges, inlink_counts,
        inlink_arrays, inlink_pieces, word_freq, total_word_count, sif_word_weight, sif_doc_embedding, doc_embedding_complete, page_links,
        resolve_links, mention_sources, link_sources, disambiguation_filter, page_text, doc_token_freq, doc_token_freq_conll,
        token_length_filter, mention_markup, context_window, candidates_prior, nil_mentions, context_similarity,
        common_component, topk_candidates, initial_score, initial_choice, topical_relatedness, propagation_matrix,
        pagerank_fixed_k, pagerank_converged, rerank, link_relatedness, link_pagerank, evaluate_accuracy, conll_mentions, disambiguate, p6_found,
        p6_inlink_sizes, p6_candidate_counts, tokenizer_goldens, dictionary_topk, dictionary_propagation, dictionary_converged,
        dictionary_rerank, dictionary_best, evaluate_prior, redirect_mentions, kb_build_entity, kb_build_mention, kb_build_link,
        kb_build_doc_token, kb_build_word_freq, kb_build_embedding,
    )
}
