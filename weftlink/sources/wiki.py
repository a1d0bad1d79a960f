"""Extracted encyclopedia pages and redirect dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.text import is_disambiguation, is_entity_title, trimmed, unescaped

#: Head of a page in an extracted file; fixed pattern. Blanks at the end of a title stay in it.
PAGE_HEAD = r"(?i)<doc.+?id=\"(\d+)\".+?title=\"\s*(.+)\s*\".*?>"
#: Title and redirect of a page in a dump; fixed patterns.
TITLE = r"(?i)<title>\s*(.+?)\s*</title>"
REDIRECT = r"(?i)<redirect\s+title=\"\s*(.+?)\s*\"\s*/>"
FILE_NAME = r"(?i)/wiki_\d+\.bz2$"


def read_pages(spark: SparkSession, path: str, keep_disambiguation: bool = False, lower: bool = True) -> DataFrame:
    """(page_id, title, lines) of the ``wiki_NN.bz2`` files under a directory, at any depth; other files are ignored.

    A page is a record of its own: the text source splits at the end tag, inside the codec. Lines are trimmed and blank
    ones dropped, the first (it repeats the title) is skipped, the title is unescaped. Lists, templates, categories and
    the like are skipped, and disambiguation pages unless kept. Text outside pages is ignored.
    """
    rows = (
        spark.read.option("lineSep", "</doc>").option("recursiveFileLookup", "true").text(path)
        .where(F.input_file_name().rlike(FILE_NAME) & F.col("value").contains("<doc"))
    )
    head = F.regexp_extract("value", PAGE_HEAD, 0)
    body = F.expr("substring(value, locate(head, value) + length(head))")
    lines = F.filter(F.transform(F.split("body", "\n"), trimmed), lambda x: x != "")
    if lower:
        lines = F.transform(lines, F.lower)
    rows = rows.withColumn("head", head).where("head <> ''").withColumn("body", body)
    rows = rows.select(
        F.regexp_extract("head", PAGE_HEAD, 1).cast("long").alias("page_id"),
        unescaped(F.regexp_extract("head", PAGE_HEAD, 2)).alias("title"),
        lines.alias("lines"),
    )
    rows = rows.withColumn("lines", F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))))
    good = is_entity_title(F.col("title"))
    return rows.where(good | is_disambiguation(F.col("title"))) if keep_disambiguation else rows.where(good)


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """(title, target) of the redirects of a dump: a page is a record, cut at its end tag inside the codec, so concatenated
    bz2 streams need no index file. The redirect must stand before the page's text. Titles and targets are unescaped."""
    page = spark.read.option("lineSep", "</page>").text(path).where(F.col("value").contains("<redirect"))
    head = F.regexp_replace("value", r"(?s)\n\s*<text.*$", "")
    rows = page.select(
        unescaped(F.regexp_extract("value", TITLE, 1)).alias("title"), unescaped(F.regexp_extract(head, REDIRECT, 1)).alias("target")
    )
    return rows.where("title <> '' and target <> ''")
