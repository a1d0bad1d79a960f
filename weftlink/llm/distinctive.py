"""How characteristic a term is of a record, compared with the whole collection: residual inverse document frequency.

The observed inverse document frequency of a term is compared with the one a Poisson process of the same collection
frequency would show. A term spread evenly has a residual near zero, however rare; one that clumps in few records has a
large one. The residual times the term's frequency in the record is its score there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import cut
from weftlink.llm.term_counts import distinct_pairs

#: Keys that may be broadcast: those with more than one in HOT of all rows.
HOT = 256


def residual_idf(records: Column, f: Column, total: Column) -> Column:
    """log2 of the Poisson expectation of records over the observed number; NULL without occurrences."""
    expected = -F.expm1(-f / total)  # share of records a Poisson process would reach
    return F.when((f > 0) & (records > 0), F.log2(expected) - F.log2(records / total))


def term_scores(doc_token: DataFrame) -> DataFrame:
    """(doc_id, word, f, records, word_f, doc_f, all_f, score) of every distinct (doc_id, word).

    records and word_f: the records and the summed f of the word; doc_f: the summed f of the record; all_f: of everything.
    score: residual inverse document frequency times f, NULL for words whose f sum to 0. NULL f count as 0, NULL words and
    records are left out, repeated rows count once, an empty table gives no rows. Counts that depend on a word or a record
    come back to the rows by a join that broadcasts the few hot keys, so words that every record has do not pile up.
    """
    pairs = cut(distinct_pairs(doc_token))  # read by all that follows
    words = cut(pairs.groupBy("word").agg(F.count("*").alias("records"), F.sum("f").alias("word_f")))
    docs = cut(pairs.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("f").alias("doc_f")))
    totals = docs.agg(F.count("*").alias("all_records"), F.sum("doc_f").alias("all_f"), F.sum("words").alias("all_pairs"))
    rows = _with_counts(_with_counts(pairs, words, "word", "records", totals), docs, "doc_id", "words", totals)
    rows = rows.crossJoin(F.broadcast(totals))  # one row
    score = residual_idf(F.col("records"), F.col("word_f"), F.col("all_records")) * F.col("f")
    return rows.select("doc_id", "word", "f", "records", "word_f", "doc_f", "all_f", score.alias("score"))


def _with_counts(rows: DataFrame, counts: DataFrame, key: str, size: str, totals: DataFrame) -> DataFrame:
    """rows with the counts of their key. counts knows how many rows each key has: the keys with more than one in HOT of
    all, of which there are fewer than HOT, are broadcast, and only the rows of the others are shuffled."""
    share = F.col(size) * HOT > F.col("all_pairs")
    marked = counts.crossJoin(F.broadcast(totals.select("all_pairs")))  # one row
    hot = F.broadcast(marked.where(share).drop("all_pairs"))
    others = rows.join(hot.select(key), key, "left_anti").join(marked.where(~share).drop("all_pairs"), key)
    return rows.join(hot, key).unionByName(others)


def characteristic_pairs(doc_token: DataFrame, least_f: int = 4, least_records: int = 2, times: int = 20) -> DataFrame:
    """The case rule on the columns of ``term_scores``; the rule does not read the score, which ranks what it lets pass.

    (doc_id, word) with f of at least ``least_f`` in at least ``least_records`` records, and a share of the record that
    is at least ``times`` the word's share of the whole collection."""
    return (
        term_scores(doc_token)
        .where(
            (F.col("f") >= least_f)
            & (F.col("records") >= least_records)
            & (F.col("f") * F.col("all_f") >= F.lit(times) * F.col("word_f") * F.col("doc_f"))
        )
        .select("doc_id", "word")
    )
