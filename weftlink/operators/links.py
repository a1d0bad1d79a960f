"""Links of encyclopedia pages: from lines to (source page, surface form, target) rows, mention counts and link sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.config import Params
from weftlink.functions.text import base_title, is_disambiguation, is_entity_title, link_target, links_of, without_external_links
from weftlink.operators.kb import resolve
from weftlink.operators.pages import once


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, title, href, anchor) of every link of every line, links to other sites removed first. Pages with a NULL id
    and NULL lines give nothing; pages delivered again count once."""
    line = once(pages).select("page_id", "title", F.explode("lines").alias("line")).where(F.lower("line").contains("<a"))
    link = line.select("page_id", "title", F.explode(links_of(without_external_links(F.col("line")))).alias("link"))
    return link.select("page_id", "title", F.col("link.href").alias("href"), F.col("link.anchor").alias("anchor"))


def wiki_links(pages: DataFrame, entity: DataFrame, p: Params | None = None) -> DataFrame:
    """(page_id, sf, entity_id, from_disambiguation): one row per link that means an entity.

    The surface form is the lower-case anchor text, not decoded; on a disambiguation page it is the base title for every
    link. Links to disambiguation pages, lists and the like, and surface forms longer than the limit, are dropped; targets
    are resolved by name. An empty anchor is the surface form ''.
    """
    p = p or Params()
    title = F.coalesce("title", F.lit(""))
    rows = page_links(pages).select(
        "page_id",
        is_disambiguation(title).alias("from_disambiguation"),
        F.when(is_disambiguation(title), F.lower(F.trim(base_title(title)))).otherwise(F.lower("anchor")).alias("sf"),
        link_target(F.col("href")).alias("target"),
    )
    rows = rows.where((F.length("sf") <= p.max_token) & is_entity_title(F.col("target")))
    return resolve(rows, entity).select("page_id", "sf", "entity_id", "from_disambiguation")


def mentions_of_links(links: DataFrame) -> DataFrame:
    """(sf, entity_id, n) of links."""
    return links.groupBy("sf", "entity_id").agg(F.count("*").alias("n"))


def edges_of_links(links: DataFrame) -> DataFrame:
    """(to_id, from_id), distinct; disambiguation pages point to nothing."""
    return (
        links.where("not from_disambiguation").select(F.col("entity_id").alias("to_id"), F.col("page_id").alias("from_id")).distinct()
    )


def mentions_of_redirects(redirects: DataFrame, entity: DataFrame) -> DataFrame:
    """(sf, entity_id, n) of (title, target) redirects: the lower-case title stands for the target."""
    rows = redirects.where("title is not null and target is not null").select(F.lower("title").alias("sf"), "target")
    rows = rows.where(is_entity_title(F.col("target")))
    return mentions_of_links(resolve(rows, entity))
