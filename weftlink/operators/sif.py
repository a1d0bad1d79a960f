"""Smooth-inverse-frequency statistics and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.config import Params


def word_statistics(doc_token: DataFrame, word_vec: DataFrame) -> DataFrame:
    """(word, f): corpus frequency of every word that has a vector and occurs. Combines before its only shuffle."""
    return doc_token.groupBy("word").agg(F.sum("f").alias("f")).join(word_vec.select("word"), "word", "left_semi")


def total_frequency(word_freq: DataFrame) -> DataFrame:
    """(total): the summed frequency of all words; one row."""
    return word_freq.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("total"))


def sif_weight(f: Column, total: Column, a: float) -> Column:
    """a / (a + p) with p the share of the word in the corpus (0 for a word never counted)."""
    p = F.coalesce(F.try_divide(F.coalesce(f, F.lit(0)).cast("double"), total), F.lit(0.0))
    return F.lit(a) / (F.lit(a) + p)


def weighted_words(word_vec: DataFrame, word_freq: DataFrame, p: Params) -> DataFrame:
    """(word, weight, vec) of every word that has a vector."""
    return (
        word_vec.join(word_freq, "word", "left")
        .crossJoin(F.broadcast(total_frequency(word_freq)))  # one row
        .select("word", sif_weight(F.col("f"), F.col("total"), p.sif_a).alias("weight"), "vec")
    )


def embed(rows: DataFrame, keys: list[str], words: DataFrame, dim: int) -> DataFrame:
    """(*keys, vec) of rows (*keys, word, f): the weighted mean of the vectors of the words that have one; keys without
    such a word, or whose frequencies sum to 0, give no row.

    ``dim`` sums in one aggregation: the sums combine in every task before the shuffle, so a word of every document moves
    no vector more than once a task and key, and nothing is exploded into dimensions. Adaptive execution splits the join of
    a word that very many rows have.
    """
    joined = rows.select(*keys, "word", "f").join(words, "word")
    sums = [F.sum(F.col("f") * F.col("weight") * F.col("vec")[i]).alias(f"s{i}") for i in range(dim)]
    total = joined.groupBy(*keys).agg(F.sum("f").alias("all_f"), *sums).where("all_f > 0")
    return total.select(*keys, F.array(*[F.col(f"s{i}") / F.col("all_f") for i in range(dim)]).alias("vec"))


def document_embedding(doc_token: DataFrame, word_vec: DataFrame, word_freq: DataFrame, p: Params, dim: int) -> DataFrame:
    """(doc_id, vec): the raw embedding of every document."""
    return embed(doc_token, ["doc_id"], weighted_words(word_vec, word_freq, p), dim)
