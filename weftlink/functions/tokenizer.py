"""Word-local tokenizer in the CoNLL-2003 convention, and the curation of its tokens.

A line is cut at white space. What a word becomes depends on the word alone and on whether it stands first or last in its
line, so results are remembered by (word, first, last): a corpus has far fewer distinct words than words. A word is worked
on as a small list of pieces by a table of rules; a rule either looks at its first piece again or moves past it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import ship

#: Words that keep their full stop. Fixed values.
ABBREVIATIONS = frozenset(
    {
        "apr", "aug", "av", "bldg", "dec", "dr", "calif", "corp", "feb", "fla", "inc", "jan", "jul", "jun", "lt", "ltd",
        "mar", "mr", "mrs", "ms", "nov", "oct", "rev", "sep", "st", "vol", "vols", "vs",
    }
)
#: Sport and agency names that a hyphen follows in datelines. Fixed values.
DATELINES = frozenset(
    {
        "SOCCER", "CRICKET", "BASEBALL", "TENNIS", "GOLF", "CYCLING", "ATHLETICS", "BASKETBALL", "RALLYING", "SQUASH", "BOXING",
        "MOTORCYCLING", "BADMINTON", "MOTOCROSS", "SWIMMING", "ROWING", "HOCKEY", "REUTERS", "RTRS UNION", "RACING",
        "BASKETBALLSOCCER LEAGUE", "Soccer", "Tennis", "Cricket",
    }
)
#: Schemes that make a token a URL. Fixed values.
PROTOCOLS = (
    "bitcoin", "ftp", "ftps", "geo", "git", "gopher", "http", "https", "irc", "ircs", "magnet", "mailto", "mms", "news",
    "nntp", "redis", "sftp", "sip", "sips", "sms", "ssh", "svn", "tel", "telnet", "urn", "worldwind", "xmpp",
)
URL_PATTERN = r"(?i)(?:" + "|".join(PROTOCOLS) + r")(?:%3a|:)/"
MAX_TOKEN = 128

#: Mark of a sentence end within a word's pieces. It counts as a piece and never comes out.
_BREAK = "\n"


class _Rule:
    """A pattern, what its match becomes, and where to look next: at the same place, or ``past`` it. when: a further
    condition on (match, word, first, last)."""

    def __init__(self, pattern: str, pieces: str, past: bool = False, when: Callable | None = None, flags: int = 0) -> None:
        self.match = re.compile(pattern, flags).match
        self.pieces = [int(p) if p.isdigit() else _BREAK if p == "break" else p for p in pieces.split()]
        self.past, self.when = past, when

    def __call__(self, word: str, first: bool, last: bool) -> list[str] | None:
        m = self.match(word)
        if m is None or (self.when and not self.when(m, word, first, last)):
            return None
        return [m.group(p) if isinstance(p, int) else p for p in self.pieces]


class _InnerMark(_Rule):
    """Cuts at the last quote, comma or bracket that has a letter before and behind it; in linear time, which a pattern of
    three open stretches would not be on a very long word."""

    def __init__(self) -> None:
        self.letter, self.past = re.compile(r"[a-z]", re.I).search, False

    def __call__(self, word: str, first: bool, last: bool) -> list[str] | None:
        begin = self.letter(word)
        if begin is None or not any(c in word for c in '",()'):
            return None
        end = len(word) - 1 - self.letter(word[::-1]).start()
        at = max(word.rfind(c, 0, end) for c in '",()')
        return [word[:at], word[at], word[at + 1 :]] if at > begin.start() else None


_CLITIC = re.compile(r"^'(?:[dsm]|re|ve|ll)$", re.I)
_NUMERAL = re.compile(r"^[0-9]+\.")


def is_abbreviation(word: str) -> bool:
    """Holds a full stop and no digit, or is a single letter, or is listed."""
    w = word.lower()
    return ("." in w and not re.search(r"\d", w)) or re.match(r"^[a-z]$", w) is not None or w in ABBREVIATIONS


def _splits_slash(m: re.Match, word: str, first: bool, last: bool) -> bool:
    return not re.match(r"^(?:ht|f)tp", word, re.I) and re.search(r"[^0-9/\-]", word) is not None


def _ends_sentence(m: re.Match, word: str, first: bool, last: bool) -> bool:
    return not re.match(r"^\.+$", word) and not _NUMERAL.match(word) and (last or not is_abbreviation(m.group(1)))


#: The rules in order of priority; fixed patterns. Pieces: group numbers, literal text, or ``break``.
RULES = (
    _Rule(r"^([\"'()\[\]$:;,/%])(.+)$", "1 2", past=True, when=lambda m, w, f, la: not _CLITIC.match(w)),
    _Rule(r"^(.+)([?!.][\"'])$", "1 2 break"),
    _Rule(r"^(.+)([:;,\"')(\[\]%])$", "1 2"),
    _Rule(r"^(.+)([?!])$", "1 2 break"),
    _Rule(r"^(.+[^.])(\.\.+)$", "1 2 break"),
    _Rule(r"^([a-z]+\$)(.+)$", "1 2", past=True, flags=re.I),
    _Rule(r"^(.*)-\$(.*)$", "1 - \\$ 2", past=True),
    _Rule(r"^(.+)('re|'ve|'ll|n't|'[dsm])$", "1 2", flags=re.I),
    _InnerMark(),
    _Rule(r"^(.*[^.]\.\.+)([^.].*)$", "1 2"),
    _Rule(r"^(-+)([^\-].*)$", "1 2"),
    _Rule(r"^([A-Za-z]+)-(.*)$", "1 - 2", when=lambda m, w, f, la: m.group(1) in DATELINES),
    _Rule(r"^([0-9/]+)-([A-Z][a-z].*)$", "1 - 2"),
    _Rule(r"^([0-9/]+\.)([A-Z][a-z].*)$", "1 2"),
    _Rule(r"^(.*\.)-([A-Z][a-z].*)$", "1 - 2"),
    _Rule(r"^([A-Z]\.)([A-Z][a-z].*)$", "1 2"),
    _Rule(r"^(.*[0-9])(\.)$", "1 2 break", when=lambda m, w, f, la: not f),
    _Rule(r"^(.+)(/)(.+)$", "1 2 3", when=_splits_slash),
    _Rule(r"^(.+)(\.)$", "1 2 break", when=_ends_sentence),
)


@lru_cache(maxsize=400_000)
def split_word(word: str, first: bool, last: bool) -> tuple[str, ...]:
    """The tokens of one white-space word that stands first and/or last in its line, or inside it."""
    done: list[str] = []
    todo = [word]
    while todo:
        here = todo[0]
        at_start, at_end = first and not done, last and len(todo) == 1
        for rule in RULES:
            pieces = rule(here, at_start, at_end)
            if pieces is None:
                continue
            todo[:1] = pieces
            if rule.past:
                done.append(todo.pop(0))
            break
        else:
            done.append(todo.pop(0))
    # a piece can hold or be white space only by the break mark, and empty pieces vanish
    return tuple(p for p in done if p and p != _BREAK)


_url = re.compile(URL_PATTERN)


def tokenize(text: str | None) -> list[str]:
    """Tokens of a text, line by line; none for null, empty and blank texts."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        words = line.split()
        for i, w in enumerate(words):
            out.extend(split_word(w, i == 0, i == len(words) - 1))
    return out


def curate(tokens: list[str]) -> list[str]:
    """Tokens of at most MAX_TOKEN characters without a URL in them."""
    return [t for t in tokens if len(t) <= MAX_TOKEN and not (("/" in t) and _url.search(t))]


def tokenize_text(text: str | None) -> list[str]:
    """Curated tokens of a text."""
    return curate(tokenize(text))


def simple_tokens(text: str | None) -> list[str]:
    """White-space words of at most MAX_TOKEN characters: a plain tokenizer that SQL can express."""
    return [t for t in (text or "").split() if len(t) <= MAX_TOKEN]


TOKENIZERS = {"conll": tokenize_text, "simple": simple_tokens}


def curated(tokens: Column) -> Column:
    """Curation as a column expression, for tokens made by built-in functions."""
    return F.filter(tokens, lambda t: (F.length(t) <= MAX_TOKEN) & ~t.rlike(URL_PATTERN))


def tokenize_column(df: DataFrame, key: str, text: str, tokenizer: str = "conll") -> DataFrame:
    """(key, tokens array<string>), one row per input row; an empty list for null and empty texts."""
    ship(df.sparkSession)
    work = TOKENIZERS[tokenizer]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch["k"].to_numpy(), "tokens": [work(t) for t in batch["t"]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, tokens array<string>")
