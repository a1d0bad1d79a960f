"""Incremental building of the knowledge base from a growing directory of pages.

Counts and link sets are mergeable, so each micro-batch is the batch pipeline over its new pages and one upsert. The
versioned tables, numbered by batch, make a batch that runs again after a failure count once; a versioned set of the page
ids that are merged makes a page that is delivered again in a later batch count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftlink.config import Params
from weftlink.functions.hygiene import cut
from weftlink.operators.kb import link_set, mention_dictionary
from weftlink.operators.links import edges_of_links, mentions_of_links, wiki_links
from weftlink.sources.sinks import latest, merge_version

PAGE_SCHEMA = "page_id long, title string, lines array<string>"


def merge_batch(pages: DataFrame, entity: DataFrame, root: str, batch_id: int, p: Params | None = None) -> None:
    """Adds the links of those pages of a batch that no earlier batch had to the versioned tables ``root/mention`` and
    ``root/link``, and their ids to ``root/page``.

    The version a batch writes has its number and is made from the version before, so a batch that runs again replaces its
    own version. The ids are written last: they are only read in a version before the batch's own.
    """
    seen = latest(pages.sparkSession, f"{root}/page", batch_id)
    fresh = pages.where("page_id is not null and lines is not null")
    if seen is not None:
        fresh = fresh.join(seen, "page_id", "left_anti")
    fresh = cut(fresh)
    links = cut(wiki_links(fresh, entity, p))
    merge_version(mentions_of_links(links), f"{root}/mention", batch_id, mention_dictionary)
    merge_version(edges_of_links(links), f"{root}/link", batch_id, link_set)
    merge_version(fresh.select("page_id").distinct(), f"{root}/page", batch_id, lambda *parts: reduce(DataFrame.unionByName, parts))


def stream_pages(spark: SparkSession, pages_dir: str, entity: DataFrame, root: str, available_now: bool = True, p: Params | None = None) -> StreamingQuery:
    """Starts the stream over Parquet files of pages that appear in a directory."""
    source = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", 64).parquet(pages_dir)
    writer = source.writeStream.option("checkpointLocation", f"{root}/checkpoint")
    writer = writer.foreachBatch(lambda batch, i: merge_batch(batch, entity, root, i, p))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
