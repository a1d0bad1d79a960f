"""Text of encyclopedia pages: lines without tags, and the frequencies of the words of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.text import is_disambiguation, stripped_of_tags
from weftlink.functions.tokenizer import tokenize_column


def once(pages: DataFrame) -> DataFrame:
    """(page_id, title, lines) of pages with an id and lines, each once; of several titles the least counts."""
    return (
        pages.where("page_id is not null and lines is not null")
        .groupBy("page_id")
        .agg(F.min("title").alias("title"), F.first("lines").alias("lines"))
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, text) of every line that has text once its tags are gone; pages delivered again count once."""
    lines = once(pages).select("page_id", F.posexplode("lines").alias("line_no", "line")).where("line is not null")
    return lines.select("page_id", "line_no", stripped_of_tags(F.col("line")).alias("text")).where("text <> ''")


def document_frequencies(pages: DataFrame, tokenizer: str = "conll") -> DataFrame:
    """(doc_id, word, f): how often each curated, lower-case token occurs on each page. Disambiguation pages, and pages
    without a token, give no rows. Counts combine in every task before the one shuffle that follows the de-duplication."""
    text = page_lines(pages.where(~F.coalesce(is_disambiguation(F.col("title")), F.lit(False))))
    tokens = tokenize_column(text.select("page_id", F.lower("text").alias("text")), "page_id", "text", tokenizer)
    return tokens.select(F.col("page_id").alias("doc_id"), F.explode("tokens").alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("f"))


def entities_of_pages(pages: DataFrame) -> DataFrame:
    """(entity_id, name): every page that is no disambiguation page is an entity named by its title."""
    rows = once(pages).where("title is not null")
    return rows.where(~is_disambiguation(F.col("title"))).select(F.col("page_id").alias("entity_id"), F.col("title").alias("name"))
