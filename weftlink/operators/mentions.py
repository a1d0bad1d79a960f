"""Documents with marked mentions: tokens, occurrences, and the context of every surface form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.config import Params
from weftlink.functions.hygiene import ship
from weftlink.functions.tokenizer import TOKENIZERS
from weftlink.operators.kb import KnowledgeBase
from weftlink.operators.sif import embed, weighted_words


def parse_markup(text: str | None, tokenizer) -> tuple[list[str], list[tuple[str, int, int]]] | None:
    """(tokens, [(surface form, start, end)]) of a text with mentions in ``[[…]]``, lower-cased; token offsets, end
    exclusive. Mentions and the text between them are tokenised apart. The surface form is the inner text as it is. None
    if a mention is not closed; nothing for a null or empty text."""
    tokens: list[str] = []
    found: list[tuple[str, int, int]] = []
    head, *marked = (text or "").lower().split("[[")
    tokens += tokenizer(head)
    rest = ""
    for part in marked:
        part = rest + part
        inner, close, after = part.partition("]]")
        if not close:  # the next mark is inside this mention
            rest = part + "[["
            continue
        rest = ""
        start = len(tokens)
        tokens += tokenizer(inner)
        found.append((inner, start, len(tokens)))
        tokens += tokenizer(after)
    return None if rest else (tokens, found)


def mention_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "conll") -> DataFrame:
    """(doc_id, tokens array<string>, mentions array<struct<sf, start, end>>) of texts with mentions in ``[[…]]``.

    Documents with a NULL id or text, and those with a mention that is not closed, give no row. One pass, no shuffle: words
    seen before are remembered by the worker.
    """
    ship(docs.sparkSession)
    work = TOKENIZERS[tokenizer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                parsed = parse_markup(t, work)
                if parsed is not None:
                    rows.append((k, parsed[0], [{"sf": s, "start": a, "end": b} for s, a, b in parsed[1]]))
            yield pd.DataFrame(rows, columns=["doc_id", "tokens", "mentions"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    schema = f"doc_id {kind}, tokens array<string>, mentions array<struct<sf: string, start: int, end: int>>"
    return rows.mapInPandas(run, schema)


def occurrences(parsed: DataFrame) -> DataFrame:
    """(doc_id, sf, start, end): every occurrence of a surface form."""
    m = parsed.select("doc_id", F.explode("mentions").alias("m"))
    return m.select("doc_id", "m.sf", "m.start", "m.end")


def context_words(parsed: DataFrame, p: Params | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, sf, word): the distinct words within the window around any occurrence of the form, its own included. The
    window is a slice of the document's token array, so no rows are joined by position. wanted: (doc_id, sf) of the mentions
    to look at, all without it; documents with none of them lose their tokens before anything is exploded."""
    p = p or Params()
    if wanted is not None:
        asked = wanted.select("doc_id", "sf").groupBy("doc_id").agg(F.collect_set("sf").alias("forms"))  # the forms of one document
        mine = F.filter("mentions", lambda x: F.array_contains("forms", x["sf"]))
        parsed = parsed.join(asked, "doc_id").select("doc_id", "tokens", mine.alias("mentions"))
    m = parsed.select("doc_id", "tokens", F.explode("mentions").alias("m"))
    begin = F.greatest(F.col("m.start") - p.window, F.lit(0))
    end = F.least(F.col("m.end") + p.window, F.size("tokens"))
    around = m.select("doc_id", F.col("m.sf").alias("sf"), F.slice("tokens", begin + 1, end - begin).alias("around"))
    return around.select("doc_id", "sf", F.explode(F.array_distinct("around")).alias("word")).distinct()


def context_vectors(parsed: DataFrame, kb: KnowledgeBase, p: Params | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, sf, vec): the embedding of each form's context, every distinct word weighing 1; of the wanted (doc_id, sf)
    only, if given. Forms whose context has no word with a vector give no row."""
    p = p or Params()
    words = context_words(parsed, p, wanted).withColumn("f", F.lit(1).cast("long"))
    return embed(words, ["doc_id", "sf"], weighted_words(kb.word_vec, kb.word_freq, p), kb.dim)
