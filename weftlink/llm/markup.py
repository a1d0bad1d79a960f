"""Markup residue in page lines: find it, turn every line into clean text, and find the lines that carry the text.

HTML, wiki, Markdown and LaTeX constructs are recognised line by line; what is carried from line to line are open code
fences, code elements, comments, templates and formula environments. Clean lines keep their structure in one plain notation: ``#`` headings, ``-`` and ``1.``
lists, ``>`` quotations, fenced code, ``|`` table rows, link texts and ``$…$`` formulas. The line-block distribution of
the stripped text then says where the running text begins (surge) and ends (dive).

All of it is per page, whole pages only, and the single shuffle is the one that drops pages delivered again.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import ship

#: Lines summed in a block; block length at which text surges. Parameters of the distribution.
WINDOW, SURGE = 3, 60

#: Element names of HTML and of wiki extensions; fixed values.
ELEMENTS = (
    "a", "abbr", "address", "article", "aside", "audio", "b", "base", "bdi", "bdo", "big", "blockquote", "body", "br",
    "button", "canvas", "caption", "center", "charinsert", "cite", "code", "col", "colgroup", "data", "dd", "del", "details",
    "dfn", "dir", "div", "dl", "dt", "em", "embed", "fieldset", "figcaption", "figure", "font", "footer", "form", "gallery",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hiero", "hr", "html", "i", "iframe", "img", "imagemap",
    "includeonly", "input", "ins", "kbd", "label", "legend", "li", "link", "main", "map", "mark", "math", "meta", "nav",
    "nobr", "noinclude", "noscript", "nowiki", "object", "ol", "onlyinclude", "option", "p", "param", "picture", "poem",
    "pre", "q", "ref", "references", "rp", "rt", "ruby", "s", "samp", "score", "script", "section", "select", "small",
    "source", "span", "strike", "strong", "style", "sub", "summary", "sup", "syntaxhighlight", "table", "tbody", "td",
    "template", "templatestyles", "textarea", "tfoot", "th", "thead", "time", "timeline", "title", "tr", "track", "tt", "u",
    "ul", "var", "video", "wbr",
)
_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_ATTRIBUTE = r"""\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+)|(?=[\s/>]))"""
TAG = re.compile(rf"</?(?:{_NAMES})(?:{_ATTRIBUTE})*\s*/?>", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|$)")
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
AUTOLINK = re.compile(r"<(?:https?|ftp|mailto):[^\s<>]+>")
WIKI_LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|((?:[^\[\]]|\[[^\[\]]*\])*))?\]\]")
FILE_LINK = re.compile(r"\[\[\s*(?:file|image|media)\s*:[^|\]]*((?:\|[^\[\]]*)*)\]\]", re.I)
WEB_LINK = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\]]+(?:\s+([^\]]*))?\]")
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
MD_LINK = re.compile(r"!?\[([^\[\]]*)\]\(\s*[^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'][^\"']*[\"'])?\s*\)")
MD_REFERENCE = re.compile(r"!?\[([^\[\]]+)\]\[[^\[\]]*\]")
MD_DEFINITION = re.compile(r"^\s{0,3}\[[^\]]+\]:\s+\S")
QUOTES = re.compile(r"(?<![\w'])('{2,5})(?=[^\s'])([^\n]*?)(?<=[^\s'])\1(?![\w'])")
STRONG = re.compile(r"(?<![\w*])(\*{2,3})(?=[^\s*])([^\n]+?)(?<=[^\s*])\1(?![\w*])|(?<!\w)(__)(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?!\w)")
EM = re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w/])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w/])")
STRIKE = re.compile(r"~~(?=[^\s~])([^\n]+?)(?<=[^\s~])~~")
CODE = re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*([\w+#.-]*)\s*$")
BLOCK_TAG = re.compile(r"<(/?)(pre|source|syntaxhighlight)\b[^<>]*>", re.I)
WIKI_HEADING = re.compile(r"^\s*(={1,6})\s*([^=\s].*?)\s*\1\s*$")
MD_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(\S.*?)\s*#*\s*$")
BULLET = re.compile(r"^\s*(?:(\*{1,6}|[-+•])\s+(?=\S)|(\*{1,6})(?=\w)(?!.*\*))")
NUMBER = re.compile(r"^\s*(?:#[*#:;]+\s*|\d{1,3}[.)]\s+)(?=\S)")
INDENT = re.compile(r"^[:;]+[*#:;]*\s*(?=\w)")
QUOTATION = re.compile(r"^\s*>+(?:\s+|$)")
RULE = re.compile(r"^\s*(?:([-*_])(?:\s*\1){2,}|={3,})\s*$")
REDIRECT = re.compile(r"^\s*#redirect\b", re.I)
TABLE = re.compile(r"^\s*(?:\{\||\|\}|\|[-+]|\||!\s)")
DELIMITER_ROW = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$")
COMMAND = re.compile(r"\\[A-Za-z]+\*?[{\[]|(?<![\w:\\/.])\\(?:[A-Za-z]+\*?|[%&_#$,;!])")
LINE_BREAK = re.compile(r"(?<=\S)\\\\(?:\[[\d.]+\w+\])?\s*$")
FORMULA = re.compile(
    r"\$\$(?=\S)[^$]+?\$\$|(?<![\\$\w])\$(?=[^\s$])(?:[^$\\]|\\.)*?(?<=[^\s\\])\$(?![\d$\w])|\\\(.+?\\\)|\\\[.+?\\\]"
)
_LINE_STARTS = (MD_DEFINITION, WIKI_HEADING, MD_HEADING, BULLET, NUMBER, INDENT, QUOTATION, RULE, REDIRECT, TABLE, DELIMITER_ROW)
_ANYWHERE = (TAG, AUTOLINK, WIKI_LINK, WEB_LINK, MD_LINK, MD_REFERENCE, QUOTES, STRONG, EM, STRIKE, CODE, FORMULA, COMMAND, LINE_BREAK)


#: Characters that constructs are made of, anywhere or where a line begins.
_SIGNS = re.compile(r"[<>&\[\]{}|*_`~$\\=#\x00]|''|^\s*(?:[-+•:;!=_]|\d{1,3}[.)]\s)")
#: Environments whose body is a formula; fixed values.
MATH = re.compile(r"\\(begin|end)\{(?:equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)\*?\}(?:\{[^{}]*\})?")


def _has_reference(line: str) -> bool:
    return any(html.unescape(m.group()) != m.group() for m in REFERENCE.finditer(line))


def plain(line: str) -> bool:
    """Whether a line has none of the characters, at their place, that every construct needs."""
    return _SIGNS.search(line) is None


def has_construct(line: str) -> bool:
    """Whether a line outside code holds a construct of HTML, wiki, Markdown or LaTeX."""
    if not line or line.isspace() or plain(line):
        return False
    if "<!--" in line or "-->" in line or "{{" in line or "}}" in line:
        return True
    return any(p.search(line) for p in _LINE_STARTS) or any(p.search(line) for p in _ANYWHERE) or _has_reference(line)


def _depth(line: str) -> tuple[int, int]:
    """(closed, opened): template ends on a line that nothing before them on it opened, and begins left open at its end."""
    closed = opened = 0
    for m in re.finditer(r"\{\{|\}\}", line):
        if m.group() == "{{":
            opened += 1
        elif opened:
            opened -= 1
        else:
            closed += 1
    return closed, opened


class _Page:
    """State between the lines of a page: inside a fence (its mark), a code element, a comment, a template (how deep), a
    formula. ends: template ends further on that nothing on their line opened, so that a template never closed takes in nothing."""

    def __init__(self, ends: int = 0) -> None:
        self.fence = ""
        self.element = self.comment = self.math = False
        self.depth, self.ends = 0, ends

    def step(self, line: str | None) -> tuple[str, bool, str | None]:
        """(kind, holds a construct, clean text) of the next line."""
        if line is None:
            return "null", False, None
        if self.fence:
            m = FENCE.match(line)
            if m and m.group(1).startswith(self.fence):
                self.fence = ""
                return "fence", True, "```"
            return "code", False, line
        if self.element:
            end = BLOCK_TAG.search(line)
            if end and end.group(1):
                self.element = False
                return "fence", True, (line[: end.start()] + "\n```").lstrip("\n")
            return "code", False, line
        if self.comment:
            head, mark, tail = line.partition("-->")
            if not mark:
                return "comment", False, ""
            self.comment = False
            return "comment", True, _inline(tail).strip()
        if m := FENCE.match(line):
            self.fence = m.group(1)
            return "fence", True, "```" + m.group(2)
        opened = BLOCK_TAG.search(line)
        if opened and not opened.group(1) and not re.search(r"</" + opened.group(2), line, re.I):
            self.element = True
            return "fence", True, "```\n" + line[opened.end() :] if line[opened.end() :].strip() else "```"
        if plain(line) and not self.depth and not self.math:
            return ("text", False, re.sub(r"[ \t\u00a0]{2,}", " ", line).strip()) if line.strip() else ("blank", False, "")
        self.comment = line.rfind("<!--") > line.rfind("-->")
        if self.math or MATH.search(line):
            return self._formula(line)
        if self.depth or "{{" in line:
            kind, text = self._template(line)
        else:
            kind, text = _block(line)
        return kind, has_construct(line), text

    def _formula(self, line: str) -> tuple[str, bool, str]:
        """A line that begins, ends or lies in a formula environment; the body stays as it is, between ``$$`` lines."""
        out, at, found = [], 0, has_construct(line)
        for m in MATH.finditer(line):
            before = line[at : m.start()].strip()
            out += [before if self.math else _inline(before).strip()] if before else []
            if self.math == (m.group(1) == "end"):
                out.append("$$")
            self.math, at = m.group(1) == "begin", m.end()
        rest = line[at:].strip()
        if rest:
            out.append(rest if self.math else _inline(rest).strip())
        return "formula", found, "\n".join(out)

    def _template(self, line: str) -> tuple[str, str]:
        """A line with template marks, or inside a template. Parameters and what stands beside marks inside a template go; a
        line of prose inside one, as in a quotation, stays."""
        closed, opened = _depth(line)
        self.ends -= closed
        inside = self.depth
        if inside and closed < inside:
            self.depth = inside - closed + min(opened, max(0, self.ends - inside + closed))
            if closed or opened or "{{" in line or line.lstrip().startswith(("|", "!")):
                return "template", ""
            return _block(line)
        for _ in range(inside):  # what stands behind the end that closes the last one
            line = line.partition("}}")[2]
        self.depth = min(opened, max(0, self.ends))
        if self.depth:  # up to the begin of the first that stays open
            at: list[int] = []
            for m in re.finditer(r"\{\{|\}\}", line):
                if m.group() == "{{":
                    at.append(m.start())
                elif at:
                    at.pop()
            line = line[: at[len(at) - self.depth]]  # those before it are never closed: only their marks go
        kind, text = _block(line)
        return ("template", "") if kind == "blank" else (kind, text)


_GROUP = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")


def _innermost(pattern: re.Pattern, by: str, text: str) -> str:
    """Replaces innermost matches until none is left; each round shortens the text, so it ends at any depth."""
    n = 1
    while n:
        text, n = pattern.subn(by, text)
    return text


def _inline(text: str) -> str:
    """A line without inline markup; texts of links, emphasis and code stay, formulas become ``$…$``."""
    held: list[str] = []

    def hold(x: str) -> str:
        held.append(x)
        return f"\x00{len(held) - 1}\x00"

    text = text.replace("\x00", "")
    text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: hold(m.group(1)), text, flags=re.I)
    text = re.sub(r"<math[^<>]*>(.*?)</math>", lambda m: hold(f"${m.group(1).strip()}$"), text, flags=re.I)
    text = FORMULA.sub(lambda m: hold("$" + m.group().strip("$").removeprefix("\\(").removesuffix("\\)").removeprefix("\\[").removesuffix("\\]").strip() + "$"), text)
    text = CODE.sub(lambda m: hold(m.group(2).strip()), text)
    text = COMMENT.sub("", text)
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", text, flags=re.I)
    text = re.sub(r"~?\\(?:cite|ref|label|pageref|eqref)\w*\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    text = _innermost(_GROUP, r"\1", text)
    text = _innermost(TEMPLATE, "", text)
    text = re.sub(r"\{\{[^{}|]*\|?|\}\}", "", text)
    text = FILE_LINK.sub(lambda m: m.group(1).rpartition("|")[2], text)
    text = WIKI_LINK.sub(lambda m: m.group(2) if m.group(2) else m.group(1), text)
    text = MD_LINK.sub(r"\1", text)
    text = MD_REFERENCE.sub(r"\1", text)
    text = WEB_LINK.sub(lambda m: m.group(1) or "", text)
    text = AUTOLINK.sub(lambda m: m.group()[1:-1], text)
    text = TAG.sub(lambda m: " " if re.match(r"</?(?:br|hr|td|th|li|p|div)\b", m.group(), re.I) else "", text)
    text = QUOTES.sub(r"\2", text)
    text = STRONG.sub(lambda m: m.group(2) or m.group(4), text)
    text = EM.sub(lambda m: m.group(1) or m.group(2), text)
    text = STRIKE.sub(r"\1", text)
    text = re.sub(r"\{\\[A-Za-z]+\s+([^{}]*)\}", r"\1", text)
    text = re.sub(r"(?<![\w:\\/.])\\ldots\b", "…", text)
    text = re.sub(r"(?<![\w:\\/.])\\([%&_#$])", r"\1", text)
    text = re.sub(r"(?<![\w:\\/.])\\[A-Za-z]+\*?\s?", "", text)
    text = LINE_BREAK.sub("", text)
    text = html.unescape(html.unescape(text)) if "&" in text else text
    text = re.sub(r"\x00(\d+)\x00", lambda m: held[int(m.group(1))], text)
    return re.sub(r"[ \t\u00a0]{2,}", " ", text)


def _block(line: str) -> tuple[str, str]:
    """(kind, clean text) of a line outside code."""
    if not line.strip():
        return "blank", ""
    if DELIMITER_ROW.match(line) or re.match(r"^\s*(?:\{\||\|\}|\|-)", line):
        return "table", ""
    if RULE.match(line):
        return "rule", ""
    if m := WIKI_HEADING.match(line):
        return "heading", "#" * len(m.group(1)) + " " + _inline(m.group(2)).strip()
    if m := re.match(r"^\s*<h([1-6])\b[^<>]*>(.*?)(?:</h\1>)?\s*$", line, re.I):
        return "heading", "#" * int(m.group(1)) + " " + _inline(m.group(2)).strip()
    if m := re.match(r"^\s*\\(part|chapter|(?:sub)*section|paragraph)\*?\{(.*)\}\s*$", line):
        depth = {"part": 1, "chapter": 1, "section": 2, "subsection": 3}.get(m.group(1), 4)
        return "heading", "#" * depth + " " + _inline(m.group(2)).strip()
    if m := MD_HEADING.match(line):
        return "heading", m.group(1) + " " + _inline(m.group(2)).strip()
    if re.match(r"^\s*\\(?:begin|end)\{", line) or re.match(r"^\s*</?(?:ul|ol|dl|table|tbody|gallery)\b[^<>]*>\s*$", line, re.I):
        return "structure", ""
    if m := re.match(r"^\s*(?:\\item\b(?:\[[^\]]*\])?|<li\b[^<>]*>)\s*", line, re.I):
        return "list", "- " + _inline(line[m.end() :]).strip()
    if m := BULLET.match(line):
        return "list", "  " * (len(m.group(1) or m.group(2)) - 1) + "- " + _inline(line[m.end() :]).strip()
    if m := NUMBER.match(line):
        return "list", "1. " + _inline(line[m.end() :]).strip()
    if m := QUOTATION.match(line):
        return "quotation", "> " + _inline(line[m.end() :]).strip()
    if re.match(r"^\s*<tr\b", line, re.I):
        cells = [_inline(c).strip() for c in re.split(r"<t[dh]\b[^<>]*>", line, flags=re.I)[1:]]
        return "table", "| " + " | ".join(cells) + " |"
    if re.match(r"^\s*(?:\||!\s)", line):
        cells = [_inline(c).strip() for c in re.split(r"\|\||!!|\|", line.strip().strip("|!"))]
        return "table", "| " + " | ".join(cells) + " |"
    if m := INDENT.match(line):
        return "list", "- " + _inline(line[m.end() :]).strip()
    if MD_DEFINITION.match(line):
        return "structure", ""
    return "text", _inline(line).strip()


def block_distribution(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines lie between a surge and the next dive. Block i sums the lengths of lines i .. i + window - 1. Text
    starts at a block of at least ``surge`` whose next block is not empty, and ends before the first empty block."""
    n = len(lengths)
    sums = np.convolve(np.asarray(lengths + [0] * (window - 1), dtype=np.int64), np.ones(window, dtype=np.int64), "valid") if n else []
    keep, inside = [], False
    for i in range(n):
        if not inside and sums[i] >= surge and (i + 1 >= n or sums[i + 1] > 0):
            inside = True
        elif inside and sums[i] == 0:
            inside = False
        keep.append(inside)
    return keep


def clean_page(lines: list[str | None]) -> list[tuple[int, str, bool, str | None, bool]]:
    """(line_no, kind, markup, text, kept) of every line of a page, null and empty ones included."""
    page = _Page(sum(_depth(x)[0] for x in lines if x and "}}" in x))
    steps = [page.step(x) for x in lines]
    kept = block_distribution([len(t or "") for _, _, t in steps])
    return [(i, kind, found, text, k) for i, ((kind, found, text), k) in enumerate(zip(steps, kept, strict=True))]


def kept_text(pages: DataFrame, key: str = "page_id", lines: str = "lines") -> DataFrame:
    """(key, text): the running text of each page by the line-block distribution, that is its clean lines between surge and
    dive, joined by line ends. Pages without such a line give no row; otherwise as ``clean_lines``."""
    kept = clean_lines(pages, key, lines).where("kept and text is not null and text <> ''")
    line = F.sort_array(F.collect_list(F.struct("line_no", "text")))  # a page's own lines, which came as one row
    joined = F.array_join(F.transform(line, lambda x: x["text"]), "\n")
    return kept.groupBy(key).agg(joined.alias("text"))


def clean_lines(pages: DataFrame, key: str = "page_id", lines: str = "lines") -> DataFrame:
    """(key, line_no int, kind, markup, text, kept): each line of each page once.

    markup: the line holds a construct. text: the clean line; NULL for a NULL line, empty for a line that was markup only.
    kept: the line lies in running text by the line-block distribution. Pages delivered again count once (any non-null
    lines win); pages with a NULL key, or with null or empty lines, give no rows. Other columns are ignored.
    """
    ship(pages.sparkSession)
    once = (
        pages.select(F.col(key).alias("k"), F.col(lines).alias("l"))
        .where(F.col("k").isNotNull() & (F.size("l") > 0))
        .groupBy("k")
        .agg(F.first("l").alias("l"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, ls in zip(batch["k"], batch["l"], strict=True) for r in clean_page(list(ls))]
            yield pd.DataFrame(rows, columns=[key, "line_no", "kind", "markup", "text", "kept"])

    kind = pages.schema[key].dataType.simpleString()
    return once.mapInPandas(run, f"`{key}` {kind}, line_no int, kind string, markup boolean, text string, kept boolean")
