"""Keyword-stuffed and link-list pages, by a hidden Markov model over the pieces of a page.

A page is cut into pieces: its lines, long lines cut every ``PIECE_WORDS`` words. Each piece shows one symbol (what it
looks like by itself, given how often its word pairs recur on the page); the hidden state says what it is: prose, link
list, tag list, menu or keyword run. Viterbi decoding lets neighbours settle doubtful pieces (a short line between menu
lines is menu, after prose it is a heading). A page is flagged when the pieces not labelled prose hold more than half of
its characters. Whole texts are used; every page is decided by itself.

The model is fitted by Baum-Welch on the symbols of all pages, equal pages once with their number, starting from and held by
the prior tables below, which also name the states. Everything else works on arrays of a whole batch of pages: characters,
words, word pairs and pieces are never visited one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import cut, ship

#: Words of a piece; characters of the pages that are worked on together.
PIECE_WORDS, CHUNK_CHARS = 24, 200_000
#: Rounds of the fit, observations of a state the prior stands for among so many pages (more of them weigh no more against
#: it: they would make rare states unreachable), and pieces that are fitted together.
FIT_ROUNDS, PRIOR_WEIGHT, PRIOR_PAGES, FIT_TOGETHER = 8, 400.0, 2048, 100_000
#: A recurring pair occurs so often, and holds this share of the page's pairs (hot) or of the places of its words (bound).
RECURS, HOT, BOUND = 4, 0.025, 0.15
#: Share of recurring pairs that makes a complete sentence part of a keyword run, and words such a sentence has at least.
SENTENCE_RATE, SENTENCE_WORDS = 0.76, 4
STATES = ("prose", "links", "tags", "menu", "keywords")
SYMBOLS = ("sentence", "link", "mention", "tag", "bar", "product", "repeat", "short", "other")

#: Prior of P(symbol | state), rows in the order of STATES, columns in that of SYMBOLS; model parameters.
EMISSION = np.array(
    [
        [0.800, 0.002, 0.004, 0.004, 0.002, 0.002, 0.006, 0.080, 0.100],
        [0.020, 0.600, 0.250, 0.010, 0.030, 0.010, 0.010, 0.050, 0.020],
        [0.010, 0.010, 0.010, 0.500, 0.020, 0.350, 0.030, 0.050, 0.020],
        [0.010, 0.040, 0.030, 0.010, 0.500, 0.010, 0.010, 0.350, 0.040],
        [0.060, 0.005, 0.005, 0.040, 0.010, 0.020, 0.760, 0.060, 0.040],
    ]
)
#: Prior of the first state, and of staying in a state.
START = np.array([0.72, 0.07, 0.07, 0.07, 0.07])
STAY = 0.8

_URL = re.compile(r"(?:https?://|www\.)[^\s)\]\"'<>]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_MARKDOWN_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)")
_MENTION = re.compile(r"\[\[[^\[\]\n]*\]\]")
_CODE = re.compile(r"\b(?:sku|art|ref|no|nr|id|item)[-# ]?\d{2,}\b", re.I)
#: Characters by what they do in a line; fixed values.
_ENDS, _CLOSING, _ITEMS, _BARS, _WEAK, _CURRENCY, _PAUSES = ".!?…。！？", "\"'”’»)]", ",;", "|»·•→", ">/,-", "$€£¥₽", ".!?。！？;,，、"
#: Ends that need no blank after them.
_FULL_ENDS = "。！？"
_LINE_ENDS = "\n\r\v\f\x1c\x1d\x1e\x85  "
#: Digits that stand for letters in disguised words; fixed values.
_DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s"}

_SPACE, _LINE, _WORD, _LETTER, _DIGIT, _END, _CLOSE, _ITEM, _BAR, _THIN, _MONEY, _PAUSE, _FULL = (1 << i for i in range(13))
_TOP = 0x20000  # code points beyond are letters of rare scripts, or nothing


@dataclass(frozen=True)
class Model:
    """P(first state), P(next state | state) and P(symbol | state)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def prior_model() -> Model:
    """The model before any page has been seen."""
    n = len(STATES)
    return Model(START, np.where(np.eye(n, dtype=bool), STAY, (1 - STAY) / (n - 1)), EMISSION)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flags, lower-case code point, the same with disguises lifted) of every code point up to _TOP."""
    every = [chr(i) for i in range(_TOP + 1)]
    flags = np.zeros(_TOP + 1, dtype=np.uint16)
    for bit, test in ((_SPACE, str.isspace), (_WORD, str.isalnum), (_LETTER, str.isalpha)):
        flags[[i for i, c in enumerate(every) if test(c)]] |= bit
    for bit, chars in (
        (_LINE, _LINE_ENDS), (_WORD, "_"), (_DIGIT, "0123456789"), (_END, _ENDS), (_CLOSE, _CLOSING), (_ITEM, _ITEMS), (_BAR, _BARS),
        (_THIN, _WEAK), (_MONEY, _CURRENCY), (_PAUSE, _PAUSES), (_FULL, _FULL_ENDS),
    ):
        flags[[ord(c) for c in chars]] |= bit
    flags[[ord(c) for c in _LINE_ENDS]] |= _SPACE
    flags[_TOP] = _WORD | _LETTER
    lower = np.array([ord(c.lower()[0]) for c in every], dtype=np.uint64)
    plain = lower.copy()
    for digit, letter in _DISGUISE.items():
        plain[ord(digit)] = ord(letter)
    return flags, lower, plain


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.ones(1024, dtype=np.uint64)
    for i in range(1, 1024):
        out[i] = (int(out[i - 1]) * 0x9E3779B97F4A7C15) % (1 << 64)
    return out


def _spans(pattern: re.Pattern, text: str, marks: tuple[str, ...], size: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(inside, begins) masks of a pattern's matches; None where the text has none of the marks it needs."""
    if not any(m in text for m in marks):
        return None, None
    found = [m.span() for m in pattern.finditer(text)]
    if not found:
        return None, None
    at = np.array(found)
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, at[:, 0], 1)
    np.add.at(steps, at[:, 1], -1)
    begins = np.zeros(size, dtype=bool)
    begins[at[:, 0]] = True
    return np.cumsum(steps)[:-1] > 0, begins


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the stretches of a mask."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shifted(mask: np.ndarray, by: int) -> np.ndarray:
    """The mask of what stands ``by`` places further on; false beyond the ends."""
    out = np.zeros_like(mask)
    if by > 0:
        out[:-by] = mask[by:]
    else:
        out[-by:] = mask[:by]
    return out


class Pieces:
    """The pieces of some pages, as arrays: page, size in characters, symbol; pieces of a page stand together, in order."""

    def __init__(self, texts: list[str]) -> None:
        flags_of, lower_of, plain_of = _characters()
        big = "\n".join(texts) + "\n"
        self.code = code = np.minimum(np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _TOP)
        self.big, self.flags = big, flags_of[code]
        size = len(code)
        page_at = np.cumsum([0] + [len(t) + 1 for t in texts])
        space = (self.flags & _SPACE) != 0
        token_at, token_end = _runs(~space)
        line = np.cumsum((self.flags & _LINE) != 0)[token_at]
        fresh = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(fresh)
        own = np.cumsum(fresh) - 1
        place = np.arange(len(line)) - first[own]
        long = np.diff(np.concatenate([first, [len(line)]]))[own] > PIECE_WORDS + PIECE_WORDS // 2
        opens = np.flatnonzero(fresh | (long & (place % PIECE_WORDS == 0)))
        self.begin = token_at[opens]
        self.end = token_end[np.concatenate([opens[1:], [len(line)]]).astype(np.int64) - 1] if len(opens) else token_end[:0]
        self.size = self.end - self.begin
        self.page = np.searchsorted(page_at, self.begin, "right") - 1
        self.tokens = np.diff(np.concatenate([opens, [len(line)]]))
        self._space, self._opens = space, opens
        self._token_at, self._token_end = token_at, token_end
        self.symbols = self._look(size, lower_of, plain_of) if len(opens) else np.zeros(0, dtype=np.int64)

    def _count(self, mask: np.ndarray | None) -> np.ndarray:
        """How many places of a mask each piece has."""
        if mask is None:
            return np.zeros(len(self.begin), dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.end] - sums[self.begin]

    def _ends(self, shown: np.ndarray) -> np.ndarray:
        """Whether the last shown character of each piece, closing quotes and brackets aside, ends a sentence."""
        at = np.maximum.accumulate(np.where(shown & ((self.flags & _CLOSE) == 0), np.arange(len(shown)), -1))[self.end - 1]
        return (at >= self.begin) & ((self.flags[at] & _END) != 0)

    def _look(self, size: int, lower_of: np.ndarray, plain_of: np.ndarray) -> np.ndarray:
        flags, space = self.flags, self._space
        has = lambda bit: (flags & bit) != 0
        in_url, url = _spans(_URL, self.big, ("://", "www."), size)
        in_tag, _ = _spans(_TAG, self.big, (">",), size)
        _, markdown = _spans(_MARKDOWN_LINK, self.big, ("](",), size)
        in_mention, _ = _spans(_MENTION, self.big, ("]]",), size)

        word = has(_WORD)
        if in_url is not None:
            word &= ~in_url
        word_at, word_end = _runs(word)
        word_piece = np.searchsorted(self.begin, word_at, "right") - 1
        words = np.bincount(word_piece, minlength=len(self.begin))
        repeats, tight = self._recurring(word, word_at, word_end, word_piece, lower_of, plain_of)

        end = has(_END)
        inner = self._count(end & _shifted(space, 1)) + self._count(has(_FULL))
        stop = self._ends(~space)
        last = (flags[self.end - 1] & _FULL) == 0
        ends = inner + (stop & last)  # sentence ends; the last one has no blank after it within its piece
        inside = inner - ((flags[self.end - 1] & _END) != 0) * ((self.end < size) & last)
        ends -= ((flags[self.end - 1] & _END) != 0) & last & stop  # counted with the blank after the piece
        closed = (ends >= 1) & (words >= SENTENCE_WORDS * ends)

        links, n_url, n_markdown = np.zeros(len(words), dtype=bool), self._count(url), self._count(markdown)
        linked = (n_url > 0) | (n_markdown > 0)
        if linked.any():
            hidden = np.zeros(size, dtype=bool)
            for m in (in_url, in_tag):
                if m is not None:
                    hidden |= m
            word_starts = np.zeros(size, dtype=bool)
            word_starts[word_at] = True
            bare = self._count(word_starts & ~hidden)
            few = bare <= 5 * np.maximum(n_url, n_markdown) + 1
            links = linked & ((few & ~self._ends(~space & ~hidden)) | (self._count(in_url) > 0.6 * self.size))

        marks = (self.code[self._token_at] == ord("#")) & (self._token_end - self._token_at > 2)
        tagged = np.add.reduceat(marks.astype(np.int64), self._opens)
        hash_tags = (tagged > 0.5 * self.tokens) & (self.tokens > 1)
        mentions = self._count(in_mention) > 0.7 * self.size

        digit = has(_DIGIT)
        money = has(_MONEY) & (_shifted(digit, 1) | (_shifted(space, 1) & _shifted(digit, 2)))
        point = (self.code == ord(".")) | (self.code == ord(","))
        decimal = point & _shifted(digit, -1) & _shifted(digit, 1) & _shifted(digit, 2) & ~_shifted(word, 3)
        product = (self._count(money | decimal) > 0) & (self.tokens <= 14)
        for i in np.flatnonzero(product & stop):
            product[i] = _CODE.search(self.big, self.begin[i], self.end[i]) is not None

        items = self._count(has(_ITEM)) + 1
        tag_list = (items >= 6) & (words <= 2.6 * items) & (inside == 0)
        thin = has(_THIN) & _shifted(space, 1) & _shifted(space, -1)
        bars = self._count(has(_BAR) | thin)
        menu = (bars >= 2) & (words <= 4 * (bars + 1)) & ~stop
        return np.select(
            [links, linked, hash_tags, mentions, product, np.where(closed, tight, repeats), tag_list, menu, stop, words <= 4, self._count(has(_PAUSE)) > 0],
            [1, 0, 3, 2, 5, 6, 3, 4, 0, 7, 0],
            8,
        )

    def _recurring(self, word: np.ndarray, word_at: np.ndarray, word_end: np.ndarray, word_piece: np.ndarray, lower_of: np.ndarray, plain_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether recurring pairs carry a piece that is no complete sentence, whether they carry one that is).

        Prose about one thing repeats its name, and lists of sentences repeat their wording, but with stretches of fresh
        words between; key phrases follow each other or have one fresh word between them. Pairs count within their piece."""
        none = np.zeros(len(self.begin), dtype=bool)
        if len(word_at) < 2:
            return none, none
        at = np.flatnonzero(word)
        own = np.repeat(np.arange(len(word_at)), word_end - word_at)
        weight = _powers()[(at - word_at[own]) & 1023]
        mix = lambda x: (x + np.uint64(0x51ED27)) * weight
        code = self.code[at]
        begins = np.cumsum(word_end - word_at) - (word_end - word_at)
        h = np.add.reduceat(mix(plain_of[code]), begins)
        numbers = np.bitwise_or.reduceat(self.flags[at] & _LETTER, begins) == 0
        if numbers.any():
            h = np.where(numbers, np.add.reduceat(mix(lower_of[code]), begins), h)

        left = np.flatnonzero(word_piece[1:] == word_piece[:-1])
        if not len(left):
            return none, none
        piece = word_piece[left]
        page = self.page[piece].astype(np.uint64)
        a = (h[left] ^ (page * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        b = (h[left + 1] ^ (page * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xC4CEB9FE1A85EC53)
        n = _tally(a + (b ^ (b >> np.uint64(29))))
        often = n >= RECURS
        if not often.any():
            return none, none
        total = np.bincount(self.page[piece], minlength=self.page[-1] + 1)[self.page[piece]]
        hot = often & (n >= HOT * total)
        bound = hot | (often & (n >= BOUND * np.maximum(_tally(a), _tally(b))))
        rate, fresh, runs = _rates(hot, piece, len(self.begin))
        rate_b, fresh_b, runs_b = _rates(bound, piece, len(self.begin))
        loose = (rate >= 0.55) | ((rate >= 0.22) & (fresh <= 3 * runs)) | (rate_b >= 0.6) | ((rate_b >= 0.4) & (fresh_b <= 1.15 * runs_b))
        return loose, rate_b >= SENTENCE_RATE


def _tally(x: np.ndarray) -> np.ndarray:
    """How often each element occurs, element by element."""
    order = np.argsort(x)
    new = np.concatenate([[True], x[order[1:]] != x[order[:-1]]])
    group = np.cumsum(new) - 1
    out = np.empty(len(x), dtype=np.int64)
    out[order] = np.bincount(group)[group]
    return out


def _rates(flags: np.ndarray, piece: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of each piece's pairs that are flagged, number of the others, and of the stretches they form."""
    first = np.concatenate([[True], piece[1:] != piece[:-1]])
    opens = ~flags & (first | np.concatenate([[True], flags[:-1]]))
    all_of = np.bincount(piece, minlength=pieces)
    good = np.bincount(piece, weights=flags, minlength=pieces)
    return good / np.maximum(all_of, 1), all_of - good, np.bincount(piece, weights=opens, minlength=pieces)


def _padded(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the k-th piece of every page that has one, longest first; order of the pages)."""
    return np.cumsum(np.concatenate([[0], lengths[:-1]])), np.argsort(-lengths, kind="stable")


def decode(symbols: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Viterbi for many pages at once: the likeliest state of each piece. lengths: pieces of each page, none 0."""
    begin, order = _padded(symbols, lengths)
    emit, move = np.log(model.emit), np.log(model.move)
    begin, sizes = begin[order], lengths[order]
    best = np.log(model.start) + emit[:, symbols[begin]].T
    back = np.zeros((len(symbols), len(STATES)), dtype=np.int8)
    last = best.copy()
    for k in range(1, int(sizes[0])):
        live = int(np.searchsorted(-sizes, -k, "left"))  # pages with more than k pieces
        reach = best[:live, :, None] + move
        at = begin[:live] + k
        back[at] = reach.argmax(1)
        best = reach.max(1) + emit[:, symbols[at]].T
        last[:live] = best
    states = np.zeros(len(symbols), dtype=np.int64)
    now = last.argmax(1)
    states[begin + sizes - 1] = now
    for k in range(int(sizes[0]) - 1, 0, -1):
        live = int(np.searchsorted(-sizes, -k, "left"))
        at = begin[:live] + k
        states[at - 1] = back[at, states[at]]
    return states


def _expected(pages: list[np.ndarray], times: np.ndarray, model: Model) -> np.ndarray:
    """The expected starts, moves and shown symbols, in one row, of pages that occur so many times; none is empty."""
    start, move, emit = model.start, model.move, model.emit
    lengths = np.array([len(p) for p in pages])
    symbols = np.concatenate(pages).astype(np.int64)
    begin, order = _padded(symbols, lengths)
    begin, sizes, longest = begin[order], lengths[order], int(lengths.max())
    weight = np.repeat(times, lengths).astype(float)[:, None]
    ahead, scale = np.zeros((len(symbols), len(STATES))), np.ones(len(symbols))
    for k in range(longest):
        live = int(np.searchsorted(-sizes, -k, "left"))
        at = begin[:live] + k
        f = (start if k == 0 else ahead[at - 1] @ move) * emit[:, symbols[at]].T
        scale[at] = f.sum(1)
        ahead[at] = f / scale[at][:, None]
    behind = np.ones((len(symbols), len(STATES)))
    moved = np.zeros_like(move)
    for k in range(longest - 1, 0, -1):
        live = int(np.searchsorted(-sizes, -k, "left"))
        at = begin[:live] + k
        step = emit[:, symbols[at]].T * behind[at] / scale[at][:, None]
        behind[at - 1] = step @ move.T
        moved += move * ((ahead[at - 1] * weight[at]).T @ step)
    held = ahead * behind * weight
    shown = np.stack([held[symbols == s].sum(0) for s in range(len(SYMBOLS))], axis=1)
    return np.concatenate([held[begin].sum(0), moved.ravel(), shown.ravel()])


def _updated(sums: np.ndarray) -> Model:
    """The model that expected counts lead to; the prior counts as PRIOR_WEIGHT observations a state for up to
    PRIOR_PAGES pages, and keeps that share beyond."""
    n, prior = len(STATES), prior_model()
    start, moved, shown = sums[:n], sums[n : n + n * n].reshape(n, n), sums[n + n * n :].reshape(n, -1)
    weight = PRIOR_WEIGHT * max(1.0, start.sum() / PRIOR_PAGES)
    smooth = lambda counts, table: (counts + weight * table) / (counts.sum(-1, keepdims=True) + weight)
    return Model(smooth(start, prior.start), smooth(moved, prior.move), smooth(shown, prior.emit))


def fit(pages: list[np.ndarray], rounds: int = FIT_ROUNDS) -> Model:
    """Baum-Welch from the prior model on the symbols of some pages."""
    pages, model = [p for p in pages if len(p)], prior_model()
    for _ in range(rounds if pages else 0):
        model = _updated(_expected(pages, np.ones(len(pages)), model))
    return model


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Pages in runs of about CHUNK_CHARS characters, with the place of the first; a longer page is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def batch_shares(texts: list[str | None], model: Model | None = None) -> np.ndarray:
    """Shares of each text's characters by state, in the order of STATES; zeros without text."""
    model = model or prior_model()
    out = np.zeros((len(texts), len(STATES)))
    for at, some in _chunks([t or "" for t in texts]):
        p = Pieces(some)
        if not len(p.symbols):
            continue
        pages, lengths = np.unique(p.page, return_counts=True)
        states = decode(p.symbols, lengths, model)
        sums = np.bincount(p.page * len(STATES) + states, weights=p.size, minlength=len(some) * len(STATES)).reshape(-1, len(STATES))
        out[at : at + len(some)] = sums / np.maximum(sums.sum(1, keepdims=True), 1)
    return out


def shares(text: str | None, model: Model | None = None) -> list[float]:
    """The same for one text."""
    return batch_shares([text], model)[0].tolist()


def fit_model(docs: DataFrame, text: str = "text") -> Model:
    """The model fitted on all pages of a table, of any length. Each round is a pass over the symbols of the distinct pages,
    of which a row of sums a task reaches the driver."""
    ship(docs.sparkSession)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in _chunks([t or "" for t in batch["t"]]):
                p = Pieces(some)
                _, lengths = np.unique(p.page, return_counts=True)
                parts = np.split(p.symbols.astype(np.uint8), np.cumsum(lengths)[:-1]) if len(lengths) else []
                yield pd.DataFrame({"s": [x.tobytes() for x in parts]})

    symbols = docs.select(F.col(text).alias("t")).mapInPandas(look, "s binary")
    distinct = cut(symbols.groupBy("s").agg(F.count("*").alias("n")))
    model = prior_model()
    for _ in range(FIT_ROUNDS):

        def count(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            sums: np.ndarray | float = 0.0
            for batch in batches:
                pages = [np.frombuffer(x, dtype=np.uint8) for x in batch["s"]]
                group = np.cumsum([len(x) for x in pages]) // FIT_TOGETHER
                for g in np.unique(group):
                    at = np.flatnonzero(group == g)
                    sums = sums + _expected([pages[i] for i in at], batch["n"].to_numpy()[at], model)
            if not np.isscalar(sums):
                yield pd.DataFrame({"sums": [sums]})

        found = distinct.mapInPandas(count, "sums array<double>").collect()
        if not found:
            return model
        model = _updated(np.sum(sorted(r["sums"] for r in found), axis=0))
    return model


def page_shares(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, prose, links, tags, menu, keywords): shares of each text's characters by label, one row per input row.

    Null, empty and blank texts have 0 in every column. Repeated rows come out repeated; other columns are ignored, so
    their names cannot clash; an empty table gives an empty result. Python holds one Arrow batch of texts at a time, and
    the arrays of CHUNK_CHARS characters or of one longer text. Without a model one is fitted on the table.
    """
    ship(docs.sparkSession)
    model = model or fit_model(docs, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = pd.DataFrame(batch_shares(batch["t"].tolist(), model), columns=list(STATES), dtype="float64")
            done.insert(0, key, batch["k"].to_numpy())
            yield done

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{s} double" for s in STATES))


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """(key) of the pages whose non-prose pieces hold more than ``share`` of their characters. Null, empty and blank
    texts never do."""
    done = page_shares(docs.where(F.col(text).isNotNull()), key, text)
    return done.where(sum((F.col(s) for s in STATES[1:]), F.lit(0.0)) > share).select(key)
