"""Most similar vectors: an inverted file of coarse centroids with product-quantised residuals.

The index is fitted on a bounded sample and holds every row. A vector belongs to the list of its nearest centroid and is
stored there as a short code of its residual, with the exact length of what the code leaves out. A query visits the lists
of its ``probes`` nearest centroids, sums asymmetric distance tables over the codes, and reranks the rows that pass with
their exact vectors. For a similarity threshold the filter on the tables is lossless (the coding error is known for each
row), so within the visited lists nothing is lost; and a list whose centroid is further from the query than its nearest one
by more than twice the threshold's distance cannot hold a hit, as every row lies in the list of its nearest centroid. Such
lists are not visited; with ``exact`` all others are, however many, and nothing is lost at all.

Long lists and busy lists are split: a task sees a block of a list and a block of its queries, both of bounded size, so a
list that holds a third of all rows costs time but no task's memory. Exact copies are indexed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftlink.functions.hygiene import cut, ship
from weftlink.operators.hot_keys import skew_join


@dataclass(frozen=True)
class IndexParams:
    dim: int = 64
    sample: int = 32_768  # rows the index is fitted on, at most, while it has few lists
    per_list: int = 8  # rows of the sample for each list, where that is more
    max_lists: int = 16_384  # bound of the broadcast centroids (4 MB of float32 at 64 numbers) and of the sample
    probes: int = 24  # lists a query visits
    parts: int = 16  # parts of a residual, each coded in a byte
    rounds: int = 12  # k-means rounds
    list_block: int = 4_096  # rows of a list that a task sees
    query_block: int = 16_384  # queries of a list that a task sees
    rerank: int = 8  # rows reranked exactly for each of the k wanted
    seed: int = 7


def usable(vec: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite numbers, not all 0."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & ~bad & F.exists(vec, lambda x: x != 0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that tiny and huge numbers survive."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest centres of each row, nearest first, in blocks of bounded memory."""
    half = (centres * centres).sum(1) / 2
    out = np.empty((len(x), k), dtype=np.int32)
    step = max(1, 4_000_000 // max(1, len(centres)))
    for i in range(0, len(x), step):
        d = half - x[i : i + step] @ centres.T
        if k == 1:
            out[i : i + step, 0] = d.argmin(1)
        else:
            top = np.argpartition(d, k - 1, axis=1)[:, :k]
            order = np.take_along_axis(d, top, 1).argsort(1, kind="stable")
            out[i : i + step] = np.take_along_axis(top, order, 1)
    return out


def _sums(x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the rows, number of rows) of each of k groups."""
    n = np.bincount(own, minlength=k)
    order = np.argsort(own, kind="stable")
    sums = np.zeros((k, x.shape[1]))
    filled = np.flatnonzero(n)
    sums[filled] = np.add.reduceat(x[order].astype(np.float64), (np.cumsum(n) - n)[filled], axis=0)
    return sums, n


def two_level(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """About k centres: the rows are grouped into about sqrt(k), and each group gets its share of centres, so that a round
    compares a row with sqrt(k) centres and not with k."""
    if k <= 256:
        return k_means(x, k, rounds, seed)
    coarse = k_means(x, int(np.sqrt(k)), rounds, seed)
    own = nearest(x, coarse)[:, 0]
    n = np.bincount(own, minlength=len(coarse))
    order, begin = np.argsort(own, kind="stable"), np.cumsum(n) - n
    parts = [x[order[b : b + m]] for b, m in zip(begin, n, strict=True) if m]
    return np.concatenate([k_means(p, max(1, round(k * len(p) / len(x))), rounds, seed + i) for i, p in enumerate(parts)])


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of the rows; k is cut to the number of rows. Centres that lose all rows move to random rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        sums, n = _sums(x, own, k)
        centres = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


@dataclass(frozen=True)
class Index:
    """Fitted index: coarse centroids and the code book of every part of the residual."""

    centroids: np.ndarray  # lists × dim
    books: np.ndarray  # parts × codes × dim / parts

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, coding error) of unit rows in their lists."""
        residual = x - self.centroids[own]
        parts, _, width = self.books.shape
        codes = np.empty((len(x), parts), dtype=np.uint8)
        left = np.zeros(len(x))
        for p in range(parts):
            piece = residual[:, p * width : (p + 1) * width]
            codes[:, p] = nearest(piece, self.books[p])[:, 0]
            left += ((piece - self.books[p][codes[:, p]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of unit queries to the coded rows of a list, from asymmetric distance tables."""
        residual = queries - self.centroids[cell]
        parts, _, width = self.books.shape
        out = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for p in range(parts):
            piece, book = residual[:, p * width : (p + 1) * width], self.books[p]
            table = (piece * piece).sum(1)[:, None] + (book * book).sum(1) - 2 * piece @ book.T
            out += np.take(table.astype(np.float32), codes[:, p], axis=1)
        return out


_ROWS = "key string, cell int, codes binary, err float, unit binary, short binary, probes array<int>, beyond array<float>"


def shortened(x: np.ndarray) -> np.ndarray:
    """Rows as bytes: a signed byte for each number, the scale, and the exact length of what that leaves out. A query goes
    to many lists, so it travels in this form."""
    scale = (np.abs(x).max(1) / 127).astype(np.float32)
    small = np.rint(x / scale[:, None]).astype(np.int8)
    left = np.linalg.norm(x - small * scale[:, None], axis=1) * (1 + 1e-5) + 1e-6
    return np.concatenate([small.view(np.uint8), scale[:, None].view(np.uint8), left.astype(np.float32)[:, None].view(np.uint8)], axis=1)


def restored(raw: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, length of what each leaves out) of shortened rows."""
    tail = np.ascontiguousarray(raw[:, dim:]).view(np.float32)
    return np.ascontiguousarray(raw[:, :dim]).view(np.int8) * tail[:, :1], tail[:, 1]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres; rounding makes them err by less than 1e-3."""
    squares = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(squares, 0))


def _beyond(x: np.ndarray, centres: np.ndarray, near: np.ndarray) -> np.ndarray:
    """How much further each of a row's near centres is than its nearest one."""
    out = np.empty(near.shape, dtype=np.float32)
    for i in range(0, len(x), 1024):
        far = np.linalg.norm(x[i : i + 1024, None, :] - centres[near[i : i + 1024]], axis=2)
        out[i : i + 1024] = far - far[:, :1]
    return out


def _matrix(column: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype=dtype).reshape(-1, width)


class VectorIndex:
    """An index over (key string, vec array<double>) rows, and searches in it.

    Of the rows, those with a NULL key or an unusable vector (NULL, other length, not finite, all 0) are left out; of rows
    that repeat a key, the least vector counts. Equal vectors form a class named by its least key.
    """

    def __init__(self, rows: DataFrame, params: IndexParams | None = None) -> None:
        self.p = p = params or IndexParams()
        spark = rows.sparkSession
        ship(spark)
        clean = rows.select(F.col("key").cast("string").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
        clean = clean.where(F.col("key").isNotNull() & usable(F.col("vec"), p.dim)).groupBy("key").agg(F.min("vec").alias("vec"))
        mark = F.concat_ws(":", F.xxhash64("vec"), F.xxhash64(F.reverse("vec"), F.lit(1)))
        marked = cut(clean.select("key", "vec", mark.alias("mark")))
        classes = marked.groupBy("mark").agg(F.min("key").alias("class"))
        #: (key, class): every usable key with the least key of its exact copies.
        self.members = skew_join(marked.select("key", "mark"), classes, "mark").select("key", "class")
        first = marked.groupBy("mark").agg(F.min("key").alias("key"), F.first("vec").alias("vec")).select("key", "vec")

        n = marked.agg(F.approx_count_distinct("mark").alias("n")).collect()[0]["n"]
        lists = int(min(p.max_lists, max(1, 1.5 * np.sqrt(n))))
        sample = max(p.sample, p.per_list * lists)
        share = min(1.0, sample / max(1, n))
        drawn = first.where(F.pmod(F.xxhash64("key", F.lit(p.seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
        table = drawn.limit(2 * sample).toPandas().sort_values("key")  # at most 2 × sample rows of dim numbers
        self.index = self._fit(table, lists) if len(table) else None
        if self.index is None:
            self.rows = spark.createDataFrame([], _ROWS)
        else:
            self.shared = spark.sparkContext.broadcast(self.index)
            self.rows = cut(self._assign(first))

    def _fit(self, table: pd.DataFrame, lists: int) -> Index:
        p = self.p
        x = unit_rows(np.stack(table["vec"].to_list()).astype(np.float64))
        centroids = two_level(x, min(lists, max(1, len(x) // p.per_list)), p.rounds, p.seed)
        residual = x - centroids[nearest(x, centroids)[:, 0]]
        width = p.dim // p.parts
        books = [k_means(residual[:, i * width : (i + 1) * width], 256, p.rounds, p.seed + i) for i in range(p.parts)]
        return Index(centroids, np.stack(books))

    def _assign(self, first: DataFrame) -> DataFrame:
        shared, probes = self.shared, self.p.probes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            k = min(probes, len(index.centroids))
            for batch in batches:
                if not len(batch):
                    continue
                x = unit_rows(np.stack(batch["vec"].to_list()))
                near = nearest(x, index.centroids, k)
                codes, err = index.encode(x, near[:, 0])
                yield pd.DataFrame(
                    {
                        "key": batch["key"].to_numpy(),
                        "cell": near[:, 0],
                        "codes": [c.tobytes() for c in codes],
                        "err": err.astype(np.float32),
                        "unit": [u.tobytes() for u in x],
                        "short": [s.tobytes() for s in shortened(x)],
                        "probes": list(near),
                        "beyond": list(_beyond(x, index.centroids, near)),
                    }
                )

        return first.mapInPandas(run, _ROWS)

    def _within(self, reach: float, exact: bool) -> DataFrame:
        """(key, query, probes) of all rows as shortened queries: of the lists that can hold a row within ``reach``, all, or those among
        the nearest ``probes``."""
        if not exact:
            near = F.filter(F.arrays_zip("probes", "beyond"), lambda x: x["beyond"] <= 2 * reach)
            return self.rows.select("key", F.col("short").alias("query"), F.transform(near, lambda x: x["probes"]).alias("probes"))
        shared, dim = self.shared, self.p.dim

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centroids = shared.value.centroids
            for batch in batches:
                lists = []
                for i in range(0, len(batch), 1024):
                    x = np.frombuffer(b"".join(batch["unit"].iloc[i : i + 1024]), dtype=np.float32).reshape(-1, dim)
                    far = _distances(x, centroids)
                    lists += [np.flatnonzero(d <= d.min() + 2 * reach).astype(np.int32) for d in far]
                yield pd.DataFrame({"key": batch["key"].to_numpy(), "query": batch["short"].to_numpy(), "probes": lists})

        return self.rows.select("key", "unit", "short").mapInPandas(run, "key string, query binary, probes array<int>")

    def _blocks(self, queries: DataFrame, schema: str, work) -> DataFrame:
        """Runs work(index, cell, query keys, bytes of the queries, and of the list keys, codes, coding errors and unit rows)
        for every block of a list with every block of its queries (key, query, probes)."""
        p, shared = self.p, self.shared
        asked = queries.select(F.col("key").alias("asked_by"), "query", F.explode("probes").alias("cell"))
        # at most max_lists rows each: how many blocks the rows and the queries of a list fall into
        rows_of = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / p.list_block).cast("int").alias("row_blocks"))
        asked_of = asked.groupBy("cell").agg(F.ceil(F.count("*") / p.query_block).cast("int").alias("query_blocks"))
        blocks = F.broadcast(cut(rows_of.join(asked_of, "cell")))
        block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = (
            self.rows.join(blocks, "cell")
            .select("key", "codes", "err", "unit", "cell", block("key", "row_blocks").alias("rb"), every("query_blocks").alias("qb"))
        )
        right = (
            asked.join(blocks, "cell")
            .select("asked_by", "query", F.col("cell").alias("q_cell"), block("asked_by", "query_blocks").alias("q_qb"), every("row_blocks").alias("q_rb"))
        )

        def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
            if not rows.num_rows or not asks.num_rows:
                return empty
            q = np.frombuffer(b"".join(asks["query"].to_pylist()), dtype=np.uint8).reshape(asks.num_rows, -1)
            codes = _matrix(rows["codes"], np.uint8, p.parts)
            units = _matrix(rows["unit"], np.float32, p.dim)
            return work(shared.value, rows["cell"][0].as_py(), asks["asked_by"].to_numpy(), q, rows["key"].to_numpy(), codes, rows["err"].to_numpy(), units)

        empty = pa.table({"query": pa.array([], pa.string()), "key": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
        return left.groupBy("cell", "rb", "qb").cogroup(right.groupBy("q_cell", "q_rb", "q_qb")).applyInArrow(run, schema)

    def similar_pairs(self, cosine: float, exact: bool = False) -> DataFrame:
        """(class_a, class_b): pairs of class representatives, class_a < class_b, with at least that cosine similarity.
        Copies are in ``members``. exact: every list that can hold a hit is visited, not only the nearest ``probes``."""
        if self.index is None:
            return self.rows.select(F.col("key").alias("class_a"), F.col("key").alias("class_b"))
        reach, dim = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-3, self.p.dim

        def work(index, cell, asks, q, keys, codes, err, units):
            rows, left = restored(q, dim)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in range(0, len(rows), 512):
                d = index.distances(rows[i : i + 512], cell, codes)
                # lossless: the tables err by at most the coding error and what the shortened query leaves out
                a, b = np.nonzero(d <= (reach + err + left[i : i + 512, None]) ** 2)
                near = np.einsum("ij,ij->i", rows[i + a], units[b])
                good = (near >= cosine - left[i + a] - 1e-5) & (asks[i + a] != keys[b])
                found.append((asks[i + a[good]], keys[b[good]], near[good]))
            return pa.table(
                {
                    "query": pa.array(np.concatenate([f[0] for f in found]), pa.string()),
                    "key": pa.array(np.concatenate([f[1] for f in found]), pa.string()),
                    "cosine": pa.array(np.concatenate([f[2] for f in found]).astype(np.float64), pa.float64()),
                }
            )

        found = self._blocks(self._within(reach, exact), "query string, key string, cosine double", work)
        pairs = found.select(F.least("query", "key").alias("class_a"), F.greatest("query", "key").alias("class_b")).distinct()
        return self._reranked(pairs, cosine)

    def _reranked(self, pairs: DataFrame, cosine: float) -> DataFrame:
        """The pairs whose exact vectors have that cosine similarity; rounding of unit rows is below 1e-6."""
        dim = self.p.dim
        unit = lambda side: self.rows.select(F.col("key").alias(f"class_{side}"), F.col("unit").alias(f"unit_{side}"))
        both = pairs.join(unit("a"), "class_a").join(unit("b"), "class_b").select("class_a", "class_b", "unit_a", "unit_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (_matrix(batch.column(k), np.float32, dim).astype(np.float64) for k in (2, 3))
                good = np.einsum("ij,ij->i", a, b) >= cosine - 1e-6
                yield batch.select([0, 1]).filter(pa.array(good))

        return both.mapInArrow(run, "class_a string, class_b string")

    def similar_keys(self, cosine: float, exact: bool = False) -> DataFrame:
        """(key_a, key_b): all pairs of keys, key_a < key_b by code points, with at least that cosine similarity, copies
        included."""
        a = self.members.select(F.col("key").alias("a"), F.col("class").alias("class_a"))
        b = self.members.select(F.col("key").alias("b"), F.col("class").alias("class_b"))
        across = self.similar_pairs(cosine, exact).join(a, "class_a").join(b, "class_b").select("a", "b")
        within = a.join(b, F.col("class_a") == F.col("class_b")).where("a < b").select("a", "b")
        return across.unionByName(within).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()

    def neighbours(self, wanted: DataFrame, k: int) -> DataFrame:
        """(key, neighbour, rank, cosine): for each class that has a key of ``wanted`` (key), the k most similar other
        classes, by their least keys; ties go to the smaller key. Keys that are not in the index give no rows."""
        if self.index is None:
            return self.rows.select("key", F.col("key").alias("neighbour"), F.lit(0).alias("rank"), F.lit(0.0).alias("cosine"))
        again = self.p.rerank * k

        dim = self.p.dim

        def work(index, cell, asks, q, keys, codes, err, units):
            q = np.ascontiguousarray(q).view(np.float32).reshape(-1, dim)
            queries, others, scores = [], [], []
            for i in range(0, len(q), 512):
                part = q[i : i + 512]
                d = index.distances(part, cell, codes)
                m = min(again, len(keys))
                top = np.argpartition(d, m - 1, axis=1)[:, :m]
                exact = np.einsum("qd,qmd->qm", part.astype(np.float64), units[top].astype(np.float64))
                exact[keys[top] == asks[i : i + 512][:, None]] = -2
                m = min(k, m)
                best = np.argsort(-exact, axis=1, kind="stable")[:, :m]
                queries.append(np.repeat(asks[i : i + 512], m))
                others.append(np.take_along_axis(keys[top], best, 1).ravel())
                scores.append(np.take_along_axis(exact, best, 1).ravel())
            score = np.concatenate(scores)
            good = score > -2
            return pa.table(
                {
                    "query": pa.array(np.concatenate(queries)[good], pa.string()),
                    "key": pa.array(np.concatenate(others)[good], pa.string()),
                    "cosine": pa.array(score[good], pa.float64()),
                }
            )

        classes = self.members.join(wanted.select(F.col("key").cast("string").alias("key")).distinct(), "key", "left_semi")
        asked = self.rows.join(classes.select(F.col("class").alias("key")).distinct(), "key", "left_semi")
        found = self._blocks(asked.select("key", F.col("unit").alias("query"), "probes"), "query string, key string, cosine double", work)
        order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "key")
        return (
            found.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select(F.col("query").alias("key"), F.col("key").alias("neighbour"), "rank", "cosine")
        )
