"""Text expressions: title and target filters, links in lines, decoding, tag stripping, Unicode-aware trimming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.tokenizer import PROTOCOLS

#: Titles of disambiguation pages, and titles that are no entity; fixed patterns.
DISAMBIGUATION = r"(?i)^(.+)\s+\(disambiguation\)$"
SKIPPED_TITLE = r"(?i)^(?:lists?\s+of|wikipedia:|template:|category:|file:)"
#: A link to another site, with its text in group 3, and any link, with its target and text. Fixed patterns; on a line
#: with several links the first one begins at the first ``<a``, however far its end is.
EXTERNAL_LINK = r"(?i)<a.*?href=['\"]((" + "|".join(PROTOCOLS) + r")(?:%3a|:)|//).*?>\s*(.*?)\s*</a>"
LINK = r"(?i)<a.*?href=\"\s*(.+?)\s*\".*?>\s*(.*?)\s*</a>"


def is_disambiguation(title: Column) -> Column:
    return title.rlike(DISAMBIGUATION)


def is_entity_title(title: Column) -> Column:
    """Neither a disambiguation page nor a list, template, category, file or project page; NULL for NULL."""
    return ~title.rlike(DISAMBIGUATION) & ~title.rlike(SKIPPED_TITLE)


def base_title(title: Column) -> Column:
    """Title of a disambiguation page without its suffix; empty for other titles."""
    return F.regexp_extract(title, DISAMBIGUATION, 1)


def without_external_links(line: Column) -> Column:
    """The line with links to other sites replaced by their texts."""
    return F.regexp_replace(line, EXTERNAL_LINK, "$3")


def links_of(line: Column) -> Column:
    """array<struct<href, anchor>> of the links of a line, in order."""
    pattern = F.lit(LINK)
    return F.arrays_zip(
        F.regexp_extract_all(line, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(line, pattern, F.lit(2)).alias("anchor")
    )


def trimmed(text: Column) -> Column:
    """Text without white space of any script at its ends; ``trim`` would only take blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """White-space words of a text, by Unicode; empty for empty texts."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def unescaped(text: Column) -> Column:
    """Character references replaced by their characters, once."""

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        import html as h

        return s.map(lambda x: h.unescape(x) if x and "&" in x else x)

    return unescape(text)


def link_target(href: Column) -> Column:
    """The entity a link points to: percent-decoded (``+`` stays, bad escapes stay), unescaped, trimmed. Built-in decoding
    would turn ``+`` into a blank and reject bad escapes."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        import html as h
        from urllib.parse import unquote as u

        return s.map(lambda x: x if x is None else h.unescape(u(x)).strip())

    return decode(href)


def stripped_of_tags(line: Column) -> Column:
    """Text of a line of HTML: tags and comments removed, references replaced, trimmed."""

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        import html as h
        import re as r

        tag = r.compile(r"<!--.*?(?:-->|$)|</?[a-zA-Z][^<>]*>|<[!?][^<>]*>")
        return s.map(lambda x: x if x is None else (h.unescape(tag.sub("", x)) if "<" in x or "&" in x else x).strip())

    return strip(line)
