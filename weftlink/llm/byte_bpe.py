"""Byte-pair encoding of a whole corpus with a public byte-level vocabulary.

The pieces that the vocabulary's pattern cuts a text into are encoded once per distinct piece of a batch. Pieces of like
length form one padded numpy matrix; in every round each row merges its leftmost pair of least rank, found by one hashed
look-up of all pairs, closes the gap, and leaves the matrix when no pair of it is in the vocabulary. Pieces too long for a
matrix go through a heap over linked positions, which makes the same merges in n log n.

The rank file is read once, on the driver, and broadcast: its size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.hygiene import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of the vocabulary; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece, in bytes, that is merged in a matrix; bound of the memory of distinct pieces in a worker.
MATRIX_BYTES, REMEMBERED = 96, 200_000

_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        firsts, seconds, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    firsts.append(a)
                    seconds.append(b)
                    merged.append(rank)
        keys = np.array(firsts, dtype=np.int64) << 32 | np.array(seconds, dtype=np.int64)
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        values = np.array(merged, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # every round, one of the keys that want a free slot gets it; the others probe on
            slot = at[todo]
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.values[slot[won]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged id of each pair; _NONE where there is none or an id is negative."""
        keys = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Encoder:
    """Encodes texts; one a worker."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN) -> None:
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.table = PairTable(self.ranks)
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, np.ndarray] = {}

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of at most one matrix width. Rows: pieces; columns: their current tokens, then -1."""
        width = max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.first[raw], np.int32(-1))
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = np.full(ids.shape, _NONE, dtype=np.int32)
        if width > 1:
            ranks[:, :-1] = self.table.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of least rank
            line = np.arange(len(rows))
            best = ranks[line, at]
            over = best == _NONE
            if over.any():
                for i in np.flatnonzero(over):
                    done[rows[i]] = ids[i, : size[rows[i]]].copy()
                keep = ~over
                rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            size[rows] -= 1
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns > at[:, None])  # skips the right half of the merged pair
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[line, at] = best
            width = ids.shape[1]
            right = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], -1)
            left = np.where(at > 0, ids[line, np.maximum(at - 1, 0)], -1)
            ranks[line, at] = self.table.look_up(best, right)
            inner = at > 0
            ranks[line[inner], at[inner] - 1] = self.table.look_up(left[inner], best[inner])
            used = int(size[rows].max())
            if used < width:  # compaction of the columns
                ids, ranks = ids[:, :used], ranks[:, :used]
        return done

    def _heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece."""
        ids: list[int] = self.first[np.frombuffer(piece, np.uint8)].tolist()
        words = {i: t for t, i in self.ranks.items()} if not hasattr(self, "_words") else self._words
        self._words = words
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int) -> int | None:
            j = after[i]
            return self.ranks.get(words[ids[i]] + words[ids[j]]) if j < n else None

        heap = [(r, i, ids[i], ids[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one half has been merged since
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    def _learn(self, pieces: list[str]) -> None:
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        buckets: dict[int, list[int]] = {}
        for i, c in enumerate(coded):
            if len(c) > MATRIX_BYTES:
                self.known[pieces[i]] = self._heap(c)
            else:
                buckets.setdefault(len(c) if len(c) < 12 else -(-len(c) // 8) * 8, []).append(i)
        for members in buckets.values():
            for k in range(0, len(members), 65536):
                part = members[k : k + 65536]
                for i, ids in zip(part, self._matrix([coded[i] for i in part]), strict=True):
                    self.known[pieces[i]] = ids

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and empty ones."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cuts = [self.cut(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(cuts)).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        get, none = self.known.__getitem__, np.empty(0, np.int32)
        return [np.concatenate(list(map(get, c))) if c else none for c in cuts]


#: Characters of text encoded at once in a worker; longer texts are encoded alone, whole.
BATCH_CHARS = 4_000_000


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = (), count: bool = False) -> DataFrame:
    """One row per input row: (key, *keep, ids array<int>), or (key, *keep, n_tokens int) with ``count``.

    Ids are those of the vocabulary without special tokens; strings of special tokens in a text are ordinary text. A null
    and an empty text both have the empty list (0 tokens). Texts are encoded whole, however long. Repeated rows come out
    repeated; other columns are ignored; an empty table gives an empty result. There is no shuffle.
    """
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            begin = 0
            while begin < batch.num_rows:
                part, chars = [], 0
                while begin + len(part) < batch.num_rows and (not part or chars < BATCH_CHARS):
                    part.append(texts[begin + len(part)].as_py())
                    chars += len(part[-1] or "")
                done = encoder.encode_batch(part)
                sizes = np.fromiter(map(len, done), dtype=np.int32, count=len(done))
                if count:
                    result = pa.array(sizes)
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    result = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(done)))
                columns = batch.slice(begin, len(part)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, result], names=[*names, "n_tokens" if count else "ids"])
                begin += len(part)

    names = [key, *keep]
    rows = docs.select(*names, F.col(text).alias("text_to_encode"))
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{kinds}, " + ("n_tokens int" if count else "ids array<int>"))
