"""Queries of the training-data operators over whole tables, and the SQL that some of them can be checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.hygiene import table
from weftlink.functions.text import words
from weftlink.llm.byte_bpe import encode_texts
from weftlink.llm.distinctive import characteristic_pairs, term_scores
from weftlink.llm.lookalikes import consistent_forms, same_looking_pairs
from weftlink.llm.markup import clean_lines, kept_text
from weftlink.llm.mixing import count_tokens, mixture, share_report
from weftlink.llm.name_variants import link_variants
from weftlink.llm.spam_pages import page_shares, spam_pages
from weftlink.llm.term_counts import ngram_counts, word_table
from weftlink.llm.vector_search import VectorIndex


def _linked(spark: SparkSession, data: str) -> DataFrame:
    """Typed names without any entity, linked to the entity they are a variant of."""
    typed = (
        table(spark, data, "mention_count")
        .where("sf is not null")
        .groupBy("sf")
        .agg(F.count("entity_id").alias("resolved"))
        .where("resolved = 0")
        .select(F.col("sf").alias("name"))
    )
    return link_variants(typed, table(spark, data, "entity").select("entity_id", "name"), table(spark, data, "name_alias"))


def p1_found(spark: SparkSession, data: str) -> DataFrame:
    """Typed names that are variants, with their entity."""
    return _linked(spark, data).select(F.col("name").alias("sf"), "entity_id")


def p1_scores(spark: SparkSession, data: str) -> DataFrame:
    """The same with the score of the link."""
    return _linked(spark, data).select(F.col("name").alias("sf"), "entity_id", F.round("score", 4).alias("score"))


def p2_found(spark: SparkSession, data: str) -> DataFrame:
    """Rare and common words of doc_token."""
    return word_table(table(spark, data, "doc_token")).where("mark <> ''").select("word", "mark")


def p2_word_counts(spark: SparkSession, data: str) -> DataFrame:
    """Every word with its counts, next to the frequency stored for it (NULL where none is)."""
    stored = table(spark, data, "word_freq").where("word is not null").groupBy("word").agg(F.sum("f").alias("stored_f"))
    return word_table(table(spark, data, "doc_token")).join(stored, "word", "left").select("word", "f", "records", "mark", "stored_f")


def p2_ngrams(spark: SparkSession, data: str) -> DataFrame:
    """Every n-gram of up to three white-space words of the documents, with its occurrences and its documents."""
    docs = table(spark, data, "documents").select("doc_id", words(F.col("text")).alias("terms"))
    counts = ngram_counts(docs, "doc_id", "terms", None, 3)
    return counts.select(F.array_join("terms", " ").alias("ngram"), "n", "f", "records")


def p3_found(spark: SparkSession, data: str) -> DataFrame:
    """Words that are characteristic of their page."""
    return characteristic_pairs(table(spark, data, "doc_token"))


def p3_scores(spark: SparkSession, data: str) -> DataFrame:
    """The residual-idf score of every word of every page."""
    return term_scores(table(spark, data, "doc_token")).select(
        "doc_id", "word", "f", "records", F.round("score", 4).alias("score")
    )


def p4_found(spark: SparkSession, data: str) -> DataFrame:
    """Lines that hold markup."""
    return clean_lines(table(spark, data, "wiki_page")).where("markup").select("page_id", "line_no")


def p4_clean_lines(spark: SparkSession, data: str) -> DataFrame:
    """Every line as clean text."""
    return clean_lines(table(spark, data, "wiki_page"))


def p4_kept_text(spark: SparkSession, data: str) -> DataFrame:
    """The running text of every page."""
    return kept_text(table(spark, data, "wiki_page"))


def _named(spark: SparkSession, data: str) -> DataFrame:
    """Names of entities and typed names, each once, as (kind, key, text)."""
    entity = table(spark, data, "entity").select(
        F.lit("entity").alias("kind"), F.col("entity_id").cast("string").alias("key"), F.col("name").alias("text")
    )
    typed = table(spark, data, "mention_count").select(
        F.lit("sf").alias("kind"), F.col("sf").alias("key"), F.col("sf").alias("text")
    )
    return entity.unionByName(typed).where("key is not null and text is not null").distinct()


def p5_found(spark: SparkSession, data: str) -> DataFrame:
    """Pairs of entities, and of typed names, that look the same."""
    return same_looking_pairs(_named(spark, data))


def p5_forms(spark: SparkSession, data: str) -> DataFrame:
    """The consistent form of every entity name and typed name."""
    return consistent_forms(_named(spark, data))


def _vectors(spark: SparkSession, data: str) -> dict[str, DataFrame]:
    return {
        "doc": table(spark, data, "doc_embedding").select(F.col("doc_id").cast("string").alias("key"), "vec"),
        "word": table(spark, data, "word_embedding").select(F.col("word").alias("key"), "vec"),
    }


def p7_found(spark: SparkSession, data: str) -> DataFrame:
    """Pairs of document and of word vectors with a cosine similarity of at least 0.95."""
    kinds = [
        VectorIndex(rows).similar_keys(0.95).select(F.lit(kind).alias("kind"), "key_a", "key_b")
        for kind, rows in _vectors(spark, data).items()
    ]
    return kinds[0].unionByName(kinds[1])


def p7_neighbours(spark: SparkSession, data: str) -> DataFrame:
    """The ten most similar vectors, in the same table, of every document whose id is divisible by 50 and of every word whose
    hash is. Each asked key has its own rows; a neighbour stands for all its exact copies."""
    out = []
    for kind, rows in _vectors(spark, data).items():
        number = F.col("key").cast("long") if kind == "doc" else F.crc32("key")
        index, asked = VectorIndex(rows), rows.where(number % 50 == 0).select("key").distinct()
        found = index.neighbours(asked, 10).withColumnRenamed("key", "class")
        own = index.members.join(asked, "key", "left_semi")
        out.append(own.join(found, "class").select(F.lit(kind).alias("kind"), "key", "neighbour", "rank", "cosine"))
    return out[0].unionByName(out[1])


def p8_ids(spark: SparkSession, data: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, data, "documents"))


def p9_mixture(spark: SparkSession, data: str) -> DataFrame:
    """How often each document stands in the mixture."""
    targets = table(spark, data, "mix_target")
    return mixture(count_tokens(table(spark, data, "documents"), targets), targets)


def p9_shares(spark: SparkSession, data: str) -> DataFrame:
    """Target and actual share of every source."""
    targets = table(spark, data, "mix_target")
    return share_report(count_tokens(table(spark, data, "documents"), targets), targets)


def p10_found(spark: SparkSession, data: str) -> DataFrame:
    """Documents that are mostly key phrases, links, menus or tags."""
    return spam_pages(table(spark, data, "documents"))


def p10_shares(spark: SparkSession, data: str) -> DataFrame:
    """Share of each document's characters by label."""
    shares = page_shares(table(spark, data, "documents"))
    return shares.select("doc_id", *[F.round(c, 6).alias(c) for c in shares.columns[1:]])


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_scores, p2_found, p2_word_counts, p2_ngrams, p3_found, p3_scores, p4_found, p4_clean_lines, p4_kept_text, p5_found, p5_forms, p7_found,
        p7_neighbours, p8_ids, p9_mixture, p9_shares, p10_found, p10_shares,
    )
}

_PAIRS = """pairs AS (SELECT doc_id, word, coalesce(max(f), 0) AS f FROM doc_token
  WHERE doc_id IS NOT NULL AND word IS NOT NULL GROUP BY doc_id, word),
words AS (SELECT word, CAST(sum(f) AS BIGINT) AS f, count(*) AS records FROM pairs GROUP BY word),
docs AS (SELECT doc_id, sum(f) AS doc_f FROM pairs GROUP BY doc_id),
marked AS (SELECT word, f, records, CASE WHEN records > 0.4 * (SELECT count(DISTINCT doc_id) FROM doc_token) THEN 'common'
  WHEN records <= 2 THEN 'rare' ELSE '' END AS mark FROM words)"""

_BLANKS = r"[\s\x{a0}\x{85}\x{2000}-\x{200a}\x{3000}\x{2028}\x{2029}\x{202f}\x{205f}\x{1680}]+"

ORACLE = {
    "p2_ngrams": f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{_BLANKS}'), lambda x: x <> '') AS t FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL), g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS ngram
  FROM w, (VALUES (1), (2), (3)) v(n)) SELECT ngram, CAST(n AS INTEGER) AS n, count(*) AS f, count(DISTINCT doc_id) AS records FROM g GROUP BY ngram, n""",
    "p2_found": f"WITH {_PAIRS} SELECT word, mark FROM marked WHERE mark <> ''",
    "p2_word_counts": f"""WITH {_PAIRS}, stored AS (SELECT word, CAST(sum(f) AS BIGINT) AS stored_f FROM word_freq
  WHERE word IS NOT NULL GROUP BY word) SELECT word, f, records, mark, stored_f FROM marked LEFT JOIN stored USING (word)""",
    "p3_found": f"""WITH {_PAIRS} SELECT p.doc_id, p.word FROM pairs p JOIN words w ON p.word = w.word
  JOIN docs d ON p.doc_id = d.doc_id WHERE p.f >= 4 AND w.records >= 2
  AND p.f * (SELECT sum(f) FROM pairs) >= 20 * w.f * d.doc_f""",
    "p3_scores": f"""WITH {_PAIRS} SELECT p.doc_id, p.word, p.f, w.records, round(CASE WHEN w.f > 0 THEN
  (log2(1 - exp(-w.f / n.n)) - log2(w.records / n.n)) * p.f END, 4) AS score FROM pairs p JOIN words w ON p.word = w.word,
  (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs) n""",
}
