"""Variant spellings of typed names, linked to the person or organisation they stand for.

Every entity name is read as a person (a given and a family name, in either order), as an organisation (its own word beside
words that describe it), or as both where nothing tells which. Only names whose head, or qualifier in brackets, is a word of
places or works are neither; other qualifiers may be typed or not. A reading has a core that each of its variants keeps in some spelling. Words that very many entities
have are no core beside rarer ones: word statistics of the whole table decide, not lists; the lists below are hints.

Candidates come from blocks of distinct spellings. A spelling is indexed by what is left of it without up to two letters,
which two spellings of a word share if neither lost more, and by its prefix and suffix of half its length, each without up
to one letter, for what lost three letters and for long words: of three errors one half has at most one. So the blocks are
as selective as the words are long and grow with the tables, not with their square. Pairs of spellings that are near enough
lead to pairs of names, which are dropped unless some other word of the typed name is a form of some other word of the
entity's; entities that share a core with more than ``BLOCK`` others are cut into sub-blocks by hash, which all typed names
of the core meet. What is left is compared by the longest-common-subsequence ratio of the tokens under the readings a typed
name can have: short forms, initials, titles, other order, abbreviations and acronyms of organisations. The best entity of
a name wins.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import cut, ship
from weftlink.llm.lookalikes import skeleton

#: Longest word indexed whole, and less one letter; shortest word with halves; entities of a core before it is cut.
MIN_SUFFIX, MAX_SUFFIX, SHORT_WORD, BLOCK = 3, 5, 6, 200
#: Longest word indexed less two letters; longer ones have halves only.
LONG_WORD = 12
#: Least longest-common-subsequence ratio of two spellings of one token, and most edits between them.
RATIO, EDITS = 0.78, 3
#: A word of more than one in COMMON_SHARE entities, and of more than COMMON_LEAST, is common; so at most COMMON_SHARE times
#: the words of a name are.
COMMON_SHARE, COMMON_LEAST = 2000, 50

#: Titles before and letters after a person's name. Fixed values.
TITLES = frozenset(
    {
        "mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "sir", "dame", "lord", "lady", "rev", "reverend", "fr",
        "father", "capt", "captain", "col", "colonel", "gen", "general", "lt", "lieut", "maj", "major", "sgt", "hon",
        "judge", "justice", "sen", "senator", "rep", "pres", "president", "gov", "hrh", "st",
    }
)
LETTERS_AFTER = frozenset(
    {
        "md", "phd", "obe", "mbe", "cbe", "kbe", "esq", "esquire", "jr", "sr", "ii", "iii", "iv", "jnr", "snr", "ba", "bsc",
        "ma", "msc", "mba", "dds", "rn", "qc", "kc", "frs", "mp",
    }
)
#: Words that carry nothing in a name. Fixed values.
EMPTY = frozenset(
    {
        "the", "of", "and", "for", "de", "la", "le", "du", "in", "at", "an", "et",
    }
)
#: Common given names, beside those of the alias table: hints that a name is a person's. Fixed values.
GIVEN = frozenset(
    {
        "adam", "agnes", "alan", "albert", "alexander", "alfred", "alice", "amanda", "amy", "andrea", "andrew", "angela",
        "ann", "anna", "anne", "anthony", "arthur", "barbara", "beatrice", "benjamin", "bernard", "brian", "bruce",
        "caroline", "carol", "catherine", "charles", "charlotte", "christina", "christine", "christopher", "clara", "claire",
        "clara", "daniel", "david", "deborah", "dennis", "diana", "donald", "dorothy", "douglas", "edith", "edgar", "edmund",
        "edward", "edwin", "eleanor", "elizabeth", "ellen", "emily", "emma", "eric", "ernest", "esther", "eugene", "eva",
        "evelyn", "florence", "frances", "francis", "frank", "fred", "frederick", "gabriel", "geoffrey", "george", "gerald",
        "gilbert", "gloria", "grace", "graham", "gregory", "hannah", "harold", "harriet", "harry", "helen", "henry",
        "herbert", "howard", "hugh", "irene", "isabel", "jack", "jacob", "james", "jane", "janet", "jason", "jean",
        "jennifer", "jeremy", "jessica", "joan", "john", "jonathan", "joseph", "joshua", "joyce", "judith", "julia", "karen",
        "katherine", "kenneth", "kevin", "laura", "lawrence", "leonard", "leopold", "lewis", "lilian", "linda", "louis",
        "louise", "lucy", "margaret", "maria", "marie", "marion", "mark", "martha", "martin", "mary", "matthew", "michael",
        "mildred", "monica", "nancy", "nathaniel", "nicholas", "nora", "norman", "oliver", "oscar", "patricia", "patrick",
        "paul", "peter", "philip", "rachel", "ralph", "raymond", "rebecca", "richard", "robert", "roger", "ronald", "rose",
        "roy", "russell", "ruth", "samuel", "sandra", "sarah", "sebastian", "sharon", "simon", "sophia", "stanley",
        "stephen", "stuart", "susan", "sylvia", "theodore", "theresa", "thomas", "timothy", "valentina", "victor",
        "victoria", "vincent", "virginia", "walter", "william", "zachary",
    }
)
#: Words that hint at an organisation, and their abbreviations. Fixed values.
ORGANISATION = {
    "academy": "acad", "agency": "agcy", "association": "assoc assn ass", "authority": "auth", "bank": "bk", "board": "bd",
    "broadcasting": "bcast broadc", "brothers": "bros bro", "bureau": "bur", "center": "ctr", "centre": "ctr", "college": "coll",
    "commission": "comm", "committee": "cttee", "company": "co comp cpy", "corporation": "corp", "council": "cncl",
    "department": "dept dpt dep", "engineering": "eng engrg", "enterprises": "ent", "federation": "fed", "foundation": "fdn found",
    "group": "grp", "hospital": "hosp", "incorporated": "inc", "industries": "ind inds", "institute": "inst", "institution": "inst",
    "insurance": "ins", "international": "intl int", "laboratories": "labs", "laboratory": "lab", "library": "lib",
    "limited": "ltd", "manufacturing": "mfg manuf", "ministry": "min", "museum": "mus", "national": "natl nat", "office": "off",
    "publishing": "publ pub", "railway": "rly ry", "research": "res", "school": "sch", "shipping": "shpg ship",
    "society": "soc", "sons": "", "steel": "", "trust": "tr", "union": "un", "university": "univ uni u", "works": "wks", "fc": "",
}
#: Words of names of places, events and works, which have no variants here. Fixed values.
PLACE_OR_WORK = frozenset(
    {
        "affair", "airport", "album", "archipelago", "avenue", "band", "battle", "bay", "beach", "book", "borough", "bridge",
        "canal", "cape", "castle", "cathedral", "channel", "church", "city", "coast", "county", "creek", "dialect",
        "district", "duchy", "east", "eastern", "episode", "falls", "festival", "film", "forest", "fort", "gulf", "harbour",
        "highway", "hill", "hills", "hms", "island", "islands", "kingdom", "lake", "language", "lower", "mount", "mountain",
        "mountains", "north", "northern", "novel", "observatory", "ocean", "opera", "palace", "parish", "park", "peninsula",
        "play", "plain", "poem", "province", "region", "republic", "ridge", "river", "road", "sea", "siege", "song", "south",
        "southern", "square", "ss", "state", "station", "strait", "street", "symphony", "territory", "theorem", "tower",
        "town", "township", "treaty", "upper", "uss", "valley", "village", "volcano", "war", "west", "western", "new", "old",
    }
)
#: Those of them that are family names as well, those that come first then, and those that only say which of several. Fixed values.
FAMILY_TOO = frozenset(
    {
        "bay", "beach", "book", "bridge", "castle", "church", "east", "forest", "fort", "hill", "lake", "north", "park", "song", "south",
        "tower", "west",
    }
)
FAMILY_FIRST = frozenset({"park", "song"})
WHICH = frozenset({"east", "eastern", "lower", "new", "north", "northern", "old", "south", "southern", "state", "upper", "west", "western"})
_QUALIFIER = re.compile(r"\(([^()]*)\)\s*$")
ABBREVIATED = {a: w for w, short in ORGANISATION.items() for a in short.split()}


def tokens_of(name: str | None) -> list[str]:
    """Lower-case tokens without accents, look-alike letters and punctuation; ``&`` is a word, ``m.d.`` one token."""
    if not name:
        return []
    if name.isascii() and name.isprintable():  # nothing to fold
        text = name.lower().replace("'", "").replace("`", "").replace("&", " and ")
        text = re.sub(r"\b(?:\w\.){2,}\w?\b\.?", lambda m: m.group().replace(".", "") + " ", text) if "." in text else text
        return re.findall(r"[^\W_]+", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", skeleton(name).lower()) if not unicodedata.combining(c))
    text = skeleton(text)
    text = re.sub(r"['’`]", "", text.replace("&", " and "))
    text = re.sub(r"\b(?:\w\.){2,}\w?\b\.?", lambda m: m.group().replace(".", "") + " ", text)
    return re.findall(r"[^\W_]+", text)


def _places(word: str) -> dict[str, int]:
    """Bit mask of the places of every letter of a word."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the summed lengths; 0 where the lengths alone rule out RATIO. One row of
    the table is a bit vector."""
    if a == b:
        return 1.0
    if not a or not b or 2 * min(len(a), len(b)) < RATIO * (len(a) + len(b)):
        return 0.0
    at, row, full = _places(a), (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two tokens; a column is two bit vectors."""
    if not a:
        return len(b)
    at, full, top = _places(a), (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, diagonal, before, distance = full, 0, 0, 0, len(a)
    for c in b:
        met = at.get(c, 0)
        swap = (~diagonal & met) << 1 & before
        diagonal = (((met & up) + up ^ up) | met | down | swap) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        distance += bool(right & top) - bool(left & top)
        right, left = right << 1 | 1, left << 1
        up, down, before = (left | ~(diagonal | right)) & full, right & diagonal & full, met
    return distance


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    """Ratio of two spellings of one token; 0 where they are too far apart."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 4:
        return 0.0
    ratio = lcs_ratio(a, b)
    if edits(a, b) == 1:
        ratio = max(ratio, 0.9 if len(a) == len(b) else ratio)  # one swap or substitution
    return ratio if ratio >= RATIO and edits(a, b) <= (EDITS if min(len(a), len(b)) >= 8 else 2) else 0.0


def entity_tokens(name: str | None) -> list[str]:
    """The tokens of an entity name; ``(`` stands before those of a qualifier in brackets."""
    found = _QUALIFIER.search(name or "")
    before, after = (tokens_of(name[: found.start()]), tokens_of(found[1])) if found else ([], [])
    return [*before, "(", *after] if before and after else tokens_of(name)


def kind_of(name: str, tokens: list[str], given: frozenset[str]) -> str:
    """``person`` or ``organisation`` where a hint says so, empty for places, works and names of nothing but words that
    carry nothing, else ``either``."""
    at = tokens.index("(") if "(" in tokens else len(tokens)
    tokens, about = tokens[:at], tokens[at:]
    words = [t for t in tokens if t not in EMPTY]
    if len(tokens) >= 2 and tokens[0] in given and len(words + about[1:]) >= 2:
        return "person"
    if not words or any(t in PLACE_OR_WORK for t in about):
        return ""
    placed = [t in PLACE_OR_WORK for t in words]
    head = next((a for a, b in zip(tokens, tokens[1:]) if b in ("of", "for")), "")
    if head in ORGANISATION or len(words) > 1 and words[-1] in ORGANISATION or any(t in ORGANISATION for t in about):
        return "organisation"
    if any(t in ORGANISATION for t in tokens[1:]) and not placed[-1] and (not placed[0] or words[0] in WHICH):
        return "organisation"
    if head in PLACE_OR_WORK:
        return ""
    if not placed[0] and not placed[-1]:
        return "either"
    if sum(placed) > 1 or len(words) < 2:
        return ""
    if words[-1] in FAMILY_TOO or words[0] in FAMILY_FIRST:
        return "either"
    return "organisation" if words[0] in WHICH else ""


def readings(tokens: list[str], kind: str, common: frozenset[str]) -> list[tuple[str, tuple]]:
    """Ways to read an entity name: ("person", (given, family parts, initials)) or ("organisation", (own word, others)).
    A common word is a core only where the name has no other. A qualifier may describe an organisation."""
    if "(" in tokens:
        at = tokens.index("(")
        own = readings(tokens[:at], kind, common)
        return own + [(k, (x[0], (*x[1], *tokens[at + 1 :]))) for k, x in own if k == "organisation"]
    words = [t for t in tokens if t not in EMPTY]
    out: list[tuple[str, tuple]] = []
    if kind in ("person", "either"):
        initials = frozenset(t for t in tokens[1:] if len(t) == 1)
        long = [t for t in words if len(t) > 1] if kind == "either" else [tokens[0], *(t for t in words[words[0] == tokens[0] :] if len(t) > 1)]
        if len(long) >= 2:
            out.append(("person", (long[0], tuple(long[1:]), initials)))
            if len(long) > 2:
                out.append(("person", (long[0], tuple(long[-1:]), initials)))
            if kind == "either":
                out.append(("person", (long[-1], tuple(long[:-1]), initials)))
                if len(long) > 2:
                    out.append(("person", (long[1], tuple(long[:1]), initials)))
    if kind in ("organisation", "either") and words:
        out.append(("organisation", (words[0], tuple(words[1:]))))
        hinted = words[0] in ORGANISATION or words[0] in common
        if len(words) > 1 and (hinted or kind == "either"):
            last = next((w for w in reversed(words) if w not in ORGANISATION), words[-1])
            out.append(("organisation", (last, tuple(w for w in words if w != last))))
    core = lambda r: "".join(r[1][1]) if r[0] == "person" else r[1][0]
    rare = [r for r in out if core(r) not in common and not (r[0] == "organisation" and core(r) in ORGANISATION)]
    return list(dict.fromkeys(rare or out))


def entity_parts(reading: tuple[str, tuple], tokens: list[str], short: dict[str, set[str]]) -> list[tuple[str, list[str], bool]]:
    """(core spelling, forms of the other words, whether the spelling takes in all names) of a reading. A typed name with
    the core must have a word that begins or is near one of the forms, or no other word where there are none."""
    kind, x = reading
    if kind == "organisation":
        whole = [t for t in tokens if t not in (x[0], "(")]
        forms = {f for t in x[1] for f in (t, *ORGANISATION.get(t, "").split())} | {"".join(t[0] for t in w) for w in (x[1], whole) if x[1]}
        return [(x[0], sorted(forms), False)]
    family = "".join(x[1])
    return [(family, sorted({x[0], *short.get(x[0], ())}), False), (x[0] + family, [], True), (family + x[0], [], True)]


def typed_parts(tokens: list[str]) -> list[tuple[str, list[str], bool]]:
    """(spelling, other words, whether there are none but titles) of the tokens of a typed name and of neighbours joined.
    Other words are joined with their neighbours as well."""
    words = [t for t in tokens if t not in EMPTY] or tokens
    out: dict[tuple[str, bool], set[str]] = {}
    for n in range(1, min(4, len(words)) + 1):
        for i in range(len(words) - n + 1):
            part, others = "".join(words[i : i + n]), words[:i] + words[i + n :]
            bare = [t for t in others if t not in TITLES and t not in LETTERS_AFTER]
            joined = {a + b for rest in (others, bare) for a, b in zip(rest, rest[1:])}
            out.setdefault((part, False), set()).update(others, joined)
            if n == 1 and not bare:
                out[part, True] = set()
    return [(w, sorted(o), one) for (w, one), o in out.items()]


class Comparer:
    """Scores a typed name against an entity name; 0 where it is no variant of it."""

    def __init__(self, aliases: dict[str, set[str]]) -> None:
        self.short = aliases  # given name to its short forms
        self.given = GIVEN | aliases.keys()
        self.names = self.given | {a for short in aliases.values() for a in short}

    def _given(self, typed: str, given: str) -> float:
        if typed == given:
            return 1.0
        if typed in self.short.get(given, ()):
            return 0.95
        if len(typed) == 1:
            return 0.8 if typed == given[0] else 0.0
        if typed in self.names:
            return 0.0  # another name
        if len(typed) < len(given) and given.startswith(typed):
            return 0.9
        near = alike(typed, given)
        return max([0.9 * near, *(0.85 * alike(typed, x) for x in self.short.get(given, ()))])

    def person(self, typed: list[str], given: str, family: tuple[str, ...], middle: frozenset[str], between: frozenset[str] = frozenset()) -> float:
        """between: middle names that a typed name may have or leave out."""
        surname = "".join(family)
        words = [t for t in typed if t not in EMPTY]
        kept = [t for t in words if t == given or t in family or t not in TITLES and t not in LETTERS_AFTER] or words
        best = 0.0
        for width in range(1, min(len(kept), max(2, len(family) + 1)) + 1):
            for i in range(len(kept) - width + 1):
                if width > 1 and min(map(len, kept[i : i + width])) == 1:
                    continue  # an initial is no part of a family name
                near = alike("".join(kept[i : i + width]), surname)
                rest = kept[:i] + kept[i + width :]
                if not near or not rest:
                    continue
                for j in range(len(rest)):
                    for k in (1, 2):
                        first = "".join(rest[j : j + k])
                        others = rest[:j] + rest[j + k :]
                        if j + k > len(rest) or len(others) > 2 or any(len(t) > 1 and t not in between for t in others):
                            continue
                        if k == 2 and min(map(len, rest[j : j + 2])) == 1:
                            continue  # an initial is no half of a name
                        score = self._given(first, given)
                        if k == 2 and score < 0.8 or len(first) == 1 and near < 0.85:
                            continue
                        if middle and any(len(t) == 1 and t not in middle for t in others):
                            continue  # somebody else's initial
                        best = max(best, score * near - 0.02 * len(others)) if score else best
        if len(kept) == 1:
            joined = max(alike(kept[0], given + surname), alike(kept[0], surname + given))
            best = max(best, 0.9 * joined)
        return best

    def _word(self, typed: str, word: str) -> float:
        if typed == word:
            return 1.0
        if ABBREVIATED.get(typed) == word or typed in ORGANISATION.get(word, "").split():
            return 0.97
        if len(typed) >= 3 and len(typed) < len(word) and word.startswith(typed):
            return 0.9
        return alike(typed, word)

    def organisation(self, typed: list[str], entity: list[str], own: str, rest: list[str]) -> float:
        words = [t for t in typed if t not in EMPTY]
        best = 0.0
        for width in (1, 2):
            for i in range(len(words) - width + 1):
                joined = "".join(words[i : i + width])
                if width > 1 and not rest and min(map(len, words[i : i + width])) == 1 and joined != own:
                    continue  # an initial is no part of a name of one word
                near = alike(joined, own)
                if near:
                    best = max(best, near * self._rest(words[:i] + words[i + width :], rest, [t for t in entity if t not in (own, "(")]))
        return best

    def _rest(self, typed: list[str], rest: list[str], whole: list[str]) -> float:
        """How well the words beside an organisation's own name agree: each typed word must find its word. whole: the same
        words with those that carry nothing, which an acronym may count."""
        if not typed or not rest:
            return 0.0 if rest else float(not typed)
        if len(typed) == 1 and len(typed[0]) >= 2:
            initials = {"".join(t[0] for t in rest), "".join(t[0] for t in whole)}
            if typed[0] in initials:
                return 0.9
        left, total = list(rest), 0.0
        for t in typed:
            scored = [(self._word(t, w), -k, w) for k, w in enumerate(left)]
            score, _, word = max(scored, default=(0.0, 0, ""))
            if not score:
                return 0.0
            left.remove(word)
            total += score
        covered = (len(rest) - len(left)) / len(rest)
        return total / len(typed) * (0.7 + 0.3 * covered) if covered >= 0.5 else 0.0

    def score(self, typed: list[str], entity: list[str], kind: str, common: frozenset[str]) -> float:
        """The best score of any reading of an entity name."""
        best = 0.0
        for reading, x in readings(entity, kind, common):
            if reading == "person":
                own = frozenset(entity) - {x[0], *x[1]}
                best = max(best, self.person(typed, *x, own))
            else:
                best = max(best, self.organisation(typed, entity, x[0], list(x[1])))
        return best


_PARTS = "array<struct<part: string, others: array<string>, one: boolean>>"


def _tokenised(names: DataFrame, comparer: Comparer, entities: bool) -> DataFrame:
    """(id, tokens, kind) of (id, name) rows; the kind of typed names is empty."""
    kind = names.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [(entity_tokens if entities else tokens_of)(x) for x in batch["name"]]
            kinds = [kind_of(n, t, comparer.given) for n, t in zip(batch["name"], tokens, strict=True)] if entities else ""
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "tokens": tokens, "kind": kinds})

    return names.select("id", "name").mapInPandas(run, f"id {kind}, tokens array<string>, kind string")


def _with_parts(names: DataFrame, work) -> DataFrame:
    """(id, part, others, one) of (id, tokens, kind) rows, a row for each part that work(tokens, kind) gives."""
    kind = names.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [[{"part": p, "others": o, "one": x} for p, o, x in work(list(t), k)] for t, k in zip(batch["tokens"], batch["kind"], strict=True)]
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "parts": parts})

    rows = names.mapInPandas(run, f"id {kind}, parts {_PARTS}")
    return rows.select("id", F.explode("parts").alias("p")).select("id", "p.part", "p.others", "p.one").where("part <> ''").distinct()


def common_words(names: DataFrame) -> frozenset[str]:
    """The words that more than one in COMMON_SHARE names and more than COMMON_LEAST have; a few thousand at most."""
    words = names.select(F.explode(F.array_distinct("tokens")).alias("w"))
    total = names.agg(F.count("*").alias("n"))
    counted = words.groupBy("w").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total))  # one row
    return frozenset(r["w"] for r in counted.where((F.col("k") > COMMON_LEAST) & (F.col("k") * COMMON_SHARE > F.col("n"))).select("w").collect())


def _less(word: Column, size: Column) -> Column:
    """A word without each one of its letters."""
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))


def _less_two(word: Column, size: Column) -> Column:
    """A word without each two of its letters."""
    begun = lambda i, j: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), F.substring(word, j + 1, size))
    return F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(i + 1, size), lambda j: begun(i, j))))


def _most(w: Column, p: Column) -> Column:
    """The letters that two spellings of one word, of these lengths, can have for themselves."""
    return F.floor(F.lit(1 - RATIO + 1e-9) * (w + p)).cast("int")


def _keys(lengths_of: dict[bool, list[int]] | None = None) -> Column:
    """(key, letters left out; -1 for halves) of a spelling. With lengths_of, the lengths of the entities' spellings, those
    of a typed one: it looks for the halves of all lengths of words that can have lost, or got, a third letter, or are long."""
    typed = lengths_of is not None
    part, size, none = F.col("part"), F.length("part"), F.array().cast("array<struct<key: bigint, off: int>>")
    keyed = lambda words, off, *tags: F.transform(words, lambda x: F.struct(F.xxhash64(F.col("one"), *tags, x).alias("key"), F.lit(off).alias("off")))
    upto = LONG_WORD + 2 * int(typed)

    def halves(n: Column) -> Column:
        out = []
        for end, mark, h in ((F.left, "<", F.floor(n / 2).cast("int")), (F.right, ">", F.ceil(n / 2).cast("int"))):
            own = end(part, h)
            words = F.concat(F.array(own), _less(own, F.length(own)))
            if typed:  # a letter less or more in this half
                more = end(part, h + 1)
                words = F.concat(words, F.array(end(part, h - 1)), _less(more, F.length(more)))
            out.append(keyed(F.array_distinct(words), -1, F.lit(mark), n))
        return F.concat(*out)

    if typed:
        # the longer word of a pair that differs by so many letters, with a third one on one side, is that long
        lost = lambda n: F.when(F.abs(n - size) == 3, F.greatest(n, size) >= 9).when(F.abs(n - size) == 2, F.greatest(n, size) >= 11).otherwise((n != size) & (F.greatest(n, size) >= 12))
        there = F.when(F.col("one"), F.lit(lengths_of[True]).cast("array<int>")).otherwise(F.lit(lengths_of[False]).cast("array<int>"))
        lengths = F.filter(there, lambda n: (F.abs(n - size) <= EDITS) & (n >= SHORT_WORD) & ((n > LONG_WORD) | lost(n)))
    else:
        lengths = F.array(size)
    return F.concat(
        F.when(size <= upto, keyed(F.array(part), 0, F.lit("~"))).otherwise(none),
        F.when((size > MIN_SUFFIX) & (size <= upto), keyed(_less(part, size), 1, F.lit("~"))).otherwise(none),
        F.when((size > MAX_SUFFIX) & (size <= upto), keyed(_less_two(part, size), 2, F.lit("~"))).otherwise(none),
        F.when(size >= SHORT_WORD - EDITS * int(typed), F.flatten(F.transform(lengths, halves))).otherwise(none),
    )


def _near(w: str, p: str) -> Column:
    """Whether two parts can be spellings of one word: the ratio bounds their distance, and a swap counts as two of it. This
    is the comparison's own first condition, only tested before Python sees the pair."""
    return F.levenshtein(F.col(w), F.col(p)) <= F.least(F.lit(2 * EDITS), _most(F.length(w), F.length(p)))


def _letters(part: Column) -> Column:
    """The set of a word's letters, as bits of their code points modulo 64."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.ascii(F.substring(part, i, F.lit(1))) % 64).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.length(part)), F.lit(0).cast("bigint"), lambda bits, i: bits.bitwiseOR(bit(i)))


def _growing(df: DataFrame) -> DataFrame:
    """The same rows, for a join that neither broadcasts them nor what they meet: Spark sizes exploded rows as those they
    came from, before and while it runs, and tables cut from their lineage as the compressed files behind them."""
    return df.hint("merge")


def near_parts(typed: DataFrame, entities: DataFrame) -> DataFrame:
    """(w, p, one) of the spellings of (part, one) rows on either side that can be spellings of one word; each once."""
    tasks = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes become many keys
    lengths = [{one: sorted(r["n"] for r in df.select("one", F.length("part").alias("n")).distinct().collect() if r["one"] == one) for one in (False, True)} for df in (typed, entities)]
    reached = lambda by: F.length("part").isin(sorted({n + d for n in by for d in range(-EDITS, EDITS + 1)}))

    def keyed(df: DataFrame, name: str, keys: Column, others: dict[bool, list[int]]) -> DataFrame:
        some = df.where((F.col("one") & reached(others[True])) | (~F.col("one") & reached(others[False])))
        rows = some.repartition(tasks, "part").withColumn("bits", _letters(F.col("part"))).withColumn("k", F.explode(keys))
        return rows.select(F.col("part").alias(name), F.col("bits").alias(f"{name}_bits"), "one", F.col("k.key").alias("key"), F.col("k.off").alias(f"{name}_off"))

    both = keyed(typed, "w", _keys(lengths[1]), lengths[1]).join(_growing(keyed(entities, "p", _keys(), lengths[0])), ["key", "one"])
    size_w, size_p, most = F.length("w"), F.length("p"), _most(F.length("w"), F.length("p"))
    own = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    swapped = (F.col("w_off") == 1) & (F.col("p_off") == 1) & (size_w == size_p)  # one letter for another
    left = (F.col("w_off") + F.col("p_off") <= most) | swapped
    half = (F.col("w_off") < 0) & (own("w_bits", "p_bits") + own("p_bits", "w_bits") <= most) & _near("w", "p")
    return both.where(((F.col("w_off") >= 0) & left) | half).select("w", "p", "one").distinct()


def candidate_pairs(typed: DataFrame, entities: DataFrame) -> DataFrame:
    """(typed_id, entity_id) of (id, part, others, one) rows on either side that have near parts, and another word of the
    typed name that can be one of the forms of the entity's other words."""
    typed, entities = cut(typed), cut(entities)
    counted = entities.groupBy("part", "one").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("cuts"))
    near = cut(near_parts(typed.select("part", "one").distinct(), counted.select("part", "one")))
    cuts = counted.where("cuts > 1").withColumnRenamed("part", "p")
    ours = typed.select(F.col("id").alias("typed_id"), F.col("part").alias("w"), "others", "one").join(_growing(near), ["w", "one"])
    ours = ours.join(cuts, ["p", "one"], "left").withColumn("sub", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))).drop("cuts")
    theirs = entities.select(F.col("id").alias("entity_id"), F.col("part").alias("p"), F.col("others").alias("forms"), "one")
    theirs = theirs.join(cuts, ["p", "one"], "left").withColumn("sub", F.pmod(F.xxhash64("entity_id"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
    close = lambda o, f: f.startswith(o) | (F.levenshtein(o, f) <= F.least(F.lit(2 * EDITS), F.greatest(F.lit(2), _most(F.length(o), F.length(f)))))
    fits = F.when(F.size("forms") == 0, F.size("others") == 0).otherwise(F.exists("others", lambda o: F.exists("forms", lambda f: close(o, f))))
    return ours.join(_growing(theirs), ["p", "one", "sub"]).where(fits).select("typed_id", "entity_id").distinct()


def link_variants(typed: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.6) -> DataFrame:
    """(name, entity_id, score): for each distinct typed name that is a variant of a person's or organisation's name, the
    entity it is most like; ties go to the smaller id.

    typed: (name string); entities: (entity_id, name); aliases: (given_name, alias), a table of fixed size. NULL and empty
    names match nothing; repeated rows count once; other columns are ignored; an empty table of names or entities gives no
    rows, without aliases no short forms are known. Entities whose name has a place or a work for its head, or in brackets at
    its end, are taken for neither persons nor organisations.
    """
    spark = typed.sparkSession
    ship(spark)
    short: dict[str, set[str]] = {}
    for row in aliases.where("given_name is not null and alias is not null").select("given_name", "alias").distinct().collect():
        short.setdefault(row["given_name"].lower(), set()).add(row["alias"].lower())
    comparer = Comparer(short)

    names = typed.select(F.col("name").alias("id"), "name").where("name is not null and name <> ''").distinct()
    ours = cut(_tokenised(names, comparer, False).where(F.size("tokens") > 0))
    known = entities.where("entity_id is not null and name is not null").groupBy("entity_id").agg(F.min("name").alias("name"))
    every = cut(_tokenised(known.select(F.col("entity_id").alias("id"), "name"), comparer, True))
    common = common_words(every)
    theirs = every.where("kind <> ''")

    pairs = candidate_pairs(
        _with_parts(ours, lambda t, _: typed_parts(t)),
        _with_parts(theirs, lambda t, k: [x for r in readings(t, k, common) for x in entity_parts(r, t, comparer.short)]),
    )
    pairs = pairs.join(_growing(theirs.select(F.col("id").alias("entity_id"), F.col("tokens").alias("e"), "kind")), "entity_id")
    pairs = pairs.join(_growing(ours.select(F.col("id").alias("typed_id"), F.col("tokens").alias("t"))), "typed_id")
    id_kind = entities.schema["entity_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = [comparer.score(list(t), list(e), k, common) for t, e, k in zip(batch["t"], batch["e"], batch["kind"], strict=True)]
            out = pd.DataFrame({"name": batch["typed_id"], "entity_id": batch["entity_id"], "score": scores})
            yield out[out["score"] >= least]

    scored = pairs.select("typed_id", "entity_id", "t", "e", "kind").mapInPandas(
        run, f"name string, entity_id {id_kind}, score double"
    )
    best = scored.groupBy("name").agg(F.min_by(F.struct("entity_id", "score"), F.struct(-F.col("score"), "entity_id")).alias("b"))
    return best.select("name", "b.entity_id", "b.score")
