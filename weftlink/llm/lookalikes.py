"""One consistent form for strings that look the same.

Compatibility normalisation folds full-width forms, ligatures and composed accents; ignorable characters (zero-width,
soft hyphen, joiners, controls) go; every kind of space becomes one blank. What is left are look-alike letters of several
scripts. Each word then spans a lattice in which a letter may be any member of its look-alike class, and Viterbi search
takes the path with the best script-consistent score: frequent letter pairs score high, a change of script within a word
costs. The lattice depends on the classes only, never on which member was typed, so words that look the same have the
same lattice and come out in the same form, and words that look different never do.

Case, accents, letters and punctuation stay as they are: they are visible.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import cut, ship

#: Letters of different scripts (Latin, Cyrillic, Greek, Armenian) that look the same, one class a word. Fixed values.
CLASSES = (
    "aаɑ cс dԁ eе gɡ hһ iі jј lӏ oоοօ pр qԛ sѕ vνѵ wԝ xх yу "
    "AАΑ BВΒ CС EЕΕ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅՏ TТΤ VѴ WԜ XХΧ YҮΥ ZΖ"
)
#: Cost, in log probability, of a script change between two letters of a word.
SCRIPT_CHANGE = 12.0

CLASS_OF = {c: group for group in CLASSES.split() for c in group}


def script(ch: str) -> str:
    """Script of a letter, by its Unicode name; empty for what belongs to every script."""
    return unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""


_SCRIPT = {c: script(c) for c in CLASS_OF}


class _Seen(dict):
    """What each character becomes in the visible text; filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Cc") and ch not in "\t\n\r\v\f\x85" or "︀" <= ch <= "️" or ch in "͏ᅟᅠ឴឵ㅤ":
            out = ""  # ignorable; variation selectors and fillers show nothing either
        else:
            out = " " if kind in ("Zs", "Zl", "Zp", "Cc") else ch
        self[code] = out
        return out


_SEEN = _Seen()
_FIRST = str.maketrans({c: group[0] for c, group in CLASS_OF.items()})


def visible(text: str) -> str:
    """Decomposed compatibility form without ignorable characters, with single blanks for spaces and none at the ends."""
    return " ".join(unicodedata.normalize("NFKD", text).translate(_SEEN).split())


def pair_counts(df: DataFrame, text: str) -> dict[tuple[str, str], int]:
    """How often each pair of neighbouring letters occurs, over all rows, for letters that have look-alikes. The result
    has at most len(CLASS_OF) ** 2 entries, whatever the input."""
    letters = "".join(sorted(CLASS_OF))
    s = F.col(text)
    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))),
        lambda p: F.length(F.translate(p, letters, "")) == 0,
    )
    rows = df.where(F.length(s) > 1).select(F.explode(pairs).alias("p")).groupBy("p").count().collect()
    return {(r["p"][0], r["p"][1]): r["count"] for r in rows if len(r["p"]) == 2}


class Searcher:
    """Viterbi search over look-alike lattices, for many words at once; words seen before are remembered, up to a bound."""

    def __init__(self, pairs: dict[tuple[str, str], int]) -> None:
        self.memo: dict[str, str] = {}
        floor = math.log(sum(pairs.values()) + len(CLASS_OF) ** 2)
        groups = CLASSES.split()
        self.group = {g[0]: i for i, g in enumerate(groups)}
        self.members = [*groups, "\0"]  # the last stands for characters without look-alikes
        self.most = max(map(len, groups))
        self.scripts: dict[str, int] = {"": 0}
        n, m = len(self.members), self.most
        self.valid = np.array([[k < len(g) for k in range(m)] for g in self.members])
        self.script_of = np.array([[self._script(g[k]) if k < len(g) else 0 for k in range(m)] for g in self.members])
        # joint scores of neighbouring letters, so that unseen letters gain nothing; 0 beside characters without look-alikes
        self.joint = np.zeros((n, n, m, m))
        for a, first in enumerate(groups):
            for b, second in enumerate(groups):
                for i, x in enumerate(first):
                    for j, y in enumerate(second):
                        self.joint[a, b, i, j] = math.log(pairs.get((x, y), 0) + 1) - floor

    def _script(self, ch: str) -> int:
        return self.scripts.setdefault(_SCRIPT.get(ch) or script(ch), len(self.scripts))

    def forms(self, words: list[str]) -> list[str]:
        """The best path of each word's lattice, which its first members name; ties go to the member that stands first."""
        keys = [w.translate(_FIRST) for w in words]
        if len(self.memo) > 200_000:
            self.memo.clear()
        by_size: dict[int, list[tuple[str, str]]] = {}
        for key in dict.fromkeys(keys):
            if key not in self.memo:
                letters = key if key.isascii() else "".join(c for c in key if not unicodedata.combining(c))
                by_size.setdefault(len(letters), []).append((key, letters))
        for size, some in by_size.items():
            step = max(1, 2_000_000 // max(1, size))
            for i in range(0, len(some), step):
                self._search(some[i : i + step], size)
        return [self.memo[k] for k in keys]

    def _search(self, some: list[tuple[str, str]], size: int) -> None:
        """Words of one number of letters; an accent belongs to its letter and changes nothing in the lattice."""
        if not size:
            self.memo.update((key, key) for key, _ in some)
            return
        text = "".join(letters for _, letters in some)
        plain = len(self.members) - 1
        known = {c: (self.group.get(c, plain), self._script(c)) for c in set(text)}
        group = np.array([known[c][0] for c in text]).reshape(-1, size)
        own = np.array([known[c][1] for c in text]).reshape(-1, size)
        best, back, before = None, [], None
        order = np.arange(self.most) * 1e-9
        for k in range(size):
            g = group[:, k]
            scripts = np.where((g == plain)[:, None], own[:, k : k + 1], self.script_of[g])
            if best is None:
                best = np.where(self.valid[g], -order, -np.inf)
            else:
                change = (before[1][:, :, None] != scripts[:, None, :]) & (before[1][:, :, None] > 0) & (scripts[:, None, :] > 0)
                reach = best[:, :, None] + self.joint[before[0], g] - SCRIPT_CHANGE * change
                back.append(reach.argmax(1))
                best = np.where(self.valid[g], reach.max(1) - order, -np.inf)
            before = (g, scripts)
        at, rows = best.argmax(1), np.arange(len(some))
        path = np.empty((len(some), size), dtype=np.int64)
        path[:, -1] = at
        for k in range(size - 2, -1, -1):
            at = back[k][rows, at]
            path[:, k] = at
        for (key, letters), groups, chosen in zip(some, group.tolist(), path.tolist(), strict=True):
            best_letters = [c if g == plain else self.members[g][m] for c, g, m in zip(letters, groups, chosen, strict=True)]
            if len(letters) < len(key):
                found = iter(best_letters)
                best_letters = [c if unicodedata.combining(c) else next(found) for c in key]
            self.memo[key] = "".join(best_letters)

    def texts(self, texts: list[str | None]) -> list[str | None]:
        """The consistent forms of texts; NULL stays NULL, a text of nothing visible becomes empty."""
        split = [None if t is None else visible(t).split(" ") for t in texts]
        found = iter(self.forms([w for words in split if words for w in words]))
        return [None if words is None else unicodedata.normalize("NFC", " ".join(next(found) for _ in words)) for words in split]

    def text(self, text: str | None) -> str | None:
        """The same for one text."""
        return self.texts([text])[0]


def _mapper(pairs: dict[tuple[str, str], int], names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Searcher(pairs)
        for batch in batches:
            batch.columns = names
            batch["form"] = search.texts(batch["text"].tolist())
            yield batch[["kind", "key", "form"]]

    return run


def consistent_forms(items: DataFrame) -> DataFrame:
    """(kind, key, form) of (kind string, key string, text string) rows: the consistent form of each text, row by row.

    NULL texts have a NULL form; empty texts and texts of invisible characters have an empty one. Repeated rows come out
    repeated; an empty table gives an empty result. The letter-pair scores come from all rows.
    """
    ship(items.sparkSession)
    rows = items.select("kind", "key", "text")
    pairs = pair_counts(rows.where(F.col("text").isNotNull()), "text")
    return rows.mapInPandas(_mapper(pairs, ["kind", "key", "text"]), "kind string, key string, form string")


def same_looking_pairs(items: DataFrame) -> DataFrame:
    """(kind, key_a, key_b): all pairs of distinct keys of a kind, key_a < key_b by code points, with texts that look the
    same. Texts without anything visible match nothing.

    The pairs come from an equi-join on the consistent form. Before it, forms that only one key has are dropped, so what
    is joined are the groups themselves; adaptive execution splits a group that fills a partition.
    """
    forms = consistent_forms(items.where(F.col("key").isNotNull() & F.col("text").isNotNull()).distinct())
    forms = cut(forms.where(F.col("form") != "").distinct())  # read three times below: the search runs once
    several = forms.groupBy("kind", "form").agg(F.count("*").alias("keys")).where("keys > 1").select("kind", "form")
    grouped = forms.join(several, ["kind", "form"], "left_semi")
    a = grouped.select("kind", "form", F.col("key").alias("key_a"))
    b = grouped.select("kind", "form", F.col("key").alias("key_b"))
    return a.join(b, ["kind", "form"]).where(F.col("key_a") < F.col("key_b")).select("kind", "key_a", "key_b").distinct()


def skeleton(text: str) -> str:
    """The visible text with every look-alike letter replaced by the first of its class: equal for texts that look the
    same, and in Latin letters where there are any."""
    return visible(text).translate(_FIRST)
