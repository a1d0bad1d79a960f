"""How often every distinct value, term or n-gram occurs, and in how many records.

Suffix-sorted counting: every record emits its suffixes, truncated to ``max_n`` terms. Equal suffixes of a chunk of records
are first combined, with their weight and their set of records. Suffixes are routed by first term and chunk, sorted in
reverse lexicographic order, and one pass with a stack turns them into counts and record sets of all prefixes: a prefix is
complete when the first suffix that does not share it arrives. A record lies in exactly one chunk, so counts and record
counts of the chunks simply add up; the chunk is what keeps a term that every record has from landing in one task, and
it bounds every record set by the records of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import ship

#: Records a chunk is meant to hold; the bound of a record set in memory.
CHUNK_RECORDS = 20_000


def _stack_pass(max_n: int):
    """Sorted (terms, weight, records) rows of one partition to (terms, n, f, records) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms: list[str] = []  # the prefixes now open: terms[:1], terms[:2], …
        weight: list[int] = []
        sets: list[list[np.ndarray]] = []
        chunk = None
        done: list[tuple[list[str], int, int]] = []

        def close(depth: int) -> None:
            while len(terms) > depth:
                own = sets.pop()
                records = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
                w = weight.pop()
                done.append((terms.copy(), w, len(records)))
                terms.pop()
                if terms:
                    weight[-1] += w
                    sets[-1].append(records)

        for batch in batches:
            for c, s, w, r in zip(batch["chunk"], batch["suffix"], batch["f"], batch["records"], strict=True):
                s = list(s)
                shared = 0
                if c == chunk:
                    while shared < min(len(s), len(terms)) and s[shared] == terms[shared]:
                        shared += 1
                # reverse order brings the longer suffix first, so s never merely extends the stack by less than a term
                close(shared)
                chunk = c
                while len(terms) < len(s):
                    terms.append(s[len(terms)])
                    weight.append(0)
                    sets.append([])
                weight[-1] += int(w)
                sets[-1].append(np.unique(np.asarray(r)))
            if len(done) > 50_000:
                yield _frame(done)
                done.clear()
        close(0)
        yield _frame(done)

    def _frame(rows: list[tuple[list[str], int, int]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["terms", "f", "records"])

    return run


def ngram_counts(records: DataFrame, key: str, terms: str, weight: str | None = None, max_n: int = 1, about: int | None = None) -> DataFrame:
    """(terms array<string>, n int, f long, records long): every n-gram of up to ``max_n`` terms with its number of
    occurrences and of records.

    records: rows of (key, terms array<string>), each a sequence of the record ``key``; a record may have several. weight:
    a column by which each occurrence counts (NULL as 0); 1 without it. about: the number of records, where it is known;
    it sets how many chunks there are, never the result. NULL terms break a sequence. Rows with a NULL key
    or NULL or empty terms give nothing; repeated rows count again; other columns are ignored.
    """
    ship(records.sparkSession)
    w = F.coalesce(F.col(weight), F.lit(0)).cast("long") if weight else F.lit(1).cast("long")
    rows = records.select(F.col(key).alias("rec"), F.col(terms).alias("seq"), w.alias("f")).where(
        F.col("rec").isNotNull() & (F.size("seq") > 0)
    )
    size = F.size("seq")
    if max_n == 1:  # truncated suffixes of one term are the terms themselves
        suffix = F.transform("seq", lambda t: F.array(t))
    else:
        suffix = F.transform(
            F.sequence(F.lit(1), size), lambda i: F.slice("seq", i, F.least(F.lit(max_n), size - i + F.lit(1)))
        )
        cut = F.aggregate(
            "s",
            F.struct(F.array().cast("array<string>").alias("a"), F.lit(False).alias("end")),
            lambda acc, t: F.when(acc["end"] | t.isNull(), F.struct(acc["a"].alias("a"), F.lit(True).alias("end"))).otherwise(
                F.struct(F.array_append(acc["a"], t).alias("a"), F.lit(False).alias("end"))
            ),
            lambda acc: acc["a"],
        )
    exploded = rows.select("rec", "f", F.explode(suffix).alias("s"))
    exploded = exploded.where(F.col("s")[0].isNotNull())
    exploded = exploded.select("rec", "f", (cut if max_n > 1 else F.col("s")).alias("suffix"))

    # chunks from the number of records, else estimated JVM-side with a sketch: a bound on size, no effect on the result
    if about is None:
        about = rows.agg(F.approx_count_distinct("rec").alias("n")).collect()[0]["n"]
    chunks = max(1, -(-about // CHUNK_RECORDS))
    # the same suffix of the same record is one entry of its record set
    per_record = exploded.groupBy("suffix", "rec").agg(F.sum("f").alias("f"))
    combined = (
        per_record.withColumn("chunk", F.pmod(F.xxhash64("rec"), F.lit(chunks)).cast("int"))
        .groupBy("suffix", "chunk")
        .agg(F.sum("f").alias("f"), F.collect_list("rec").alias("records"))
    )
    routed = combined.repartition(F.col("suffix")[0], F.col("chunk")).sortWithinPartitions(
        F.col("chunk"), F.col("suffix").desc()
    )
    passed = routed.select("chunk", "suffix", "f", "records").mapInPandas(
        _stack_pass(max_n), "terms array<string>, f long, records long"
    )
    return (
        passed.groupBy("terms")
        .agg(F.sum("f").alias("f"), F.sum("records").alias("records"))
        .select("terms", F.size("terms").alias("n"), "f", "records")
    )


def distinct_pairs(doc_token: DataFrame) -> DataFrame:
    """(doc_id, word, f): each pair once. A pair delivered again has one f; where deliveries differ by a NULL, the number
    wins. NULL words and NULL records are no pairs; a pair with NULLs only has 0."""
    return (
        doc_token.select("doc_id", "word", "f")
        .where(F.col("doc_id").isNotNull() & F.col("word").isNotNull())
        .groupBy("doc_id", "word")
        .agg(F.coalesce(F.max("f"), F.lit(0)).cast("long").alias("f"))
    )


def word_table(doc_token: DataFrame, rare: int = 2, common: float = 0.4) -> DataFrame:
    """(word, f, records, mark): every word with its summed frequency, the records it occurs in, and ``rare`` (at most
    ``rare`` records), ``common`` (more than that share of all records) or ''. A record is a distinct non-null doc_id,
    whether or not it has words. Words are compared exactly; a word both rare and common is common."""
    every = doc_token.agg(F.count_distinct("doc_id").alias("n")).first()["n"]
    pairs = distinct_pairs(doc_token).select("doc_id", F.array("word").alias("terms"), "f")
    counts = ngram_counts(pairs, "doc_id", "terms", "f", 1, every)
    mark = F.when(F.col("records") > F.lit(common * every), "common").when(F.col("records") <= rare, "rare")
    return counts.select(F.col("terms")[0].alias("word"), "f", "records", F.coalesce(mark, F.lit("")).alias("mark"))
