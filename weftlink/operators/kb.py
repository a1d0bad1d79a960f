"""The knowledge base: its tables from pages or from stored increments, all of them mergeable aggregates."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.config import Params
from weftlink.functions.hygiene import cut
from weftlink.functions.vectors import nonzero, usable
from weftlink.operators.hot_keys import skew_join
from weftlink.operators.sif import document_embedding, word_statistics

#: Sources that one piece of an inlink set is made for.
PIECE_LINKS = 4096


#: The tables of a knowledge base, as they are stored.
TABLES = ("entity", "mention", "link", "doc_token", "word_vec", "word_freq", "doc_embedding", "pages")


class KnowledgeBase:
    """The knowledge base of raw, dirty tables, each made on first use:

    entity(entity_id, name, name_lower); word_vec(word, vec); word_freq(word, f); doc_token(doc_id, word, f);
    doc_embedding(doc_id, vec); mention(sf, entity_id, n); link(to_id, from_id), distinct; pages(wp), one row, the number of
    entities. Word frequencies and document embeddings are aggregates that many steps read: they are cut from their lineage.
    ``save`` and ``load`` keep all of them, so that linking reads them and computes none.
    """

    def __init__(self, entity: DataFrame, mention_count: DataFrame, link: DataFrame, doc_token: DataFrame, doc_embedding: DataFrame, word_embedding: DataFrame, params: Params | None = None) -> None:
        self.params = params or Params()
        self._raw = (entity, mention_count, link, doc_token, doc_embedding, word_embedding)

    @classmethod
    def load(cls, spark: SparkSession, root: str, params: Params | None = None) -> KnowledgeBase:
        """A stored knowledge base; nothing of it is computed again."""
        t = {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}
        kb = cls(t["entity"], t["mention"], t["link"], t["doc_token"], t["doc_embedding"], t["word_vec"], params)
        kb.__dict__.update(t)
        return kb

    def save(self, root: str) -> KnowledgeBase:
        """Writes every table under a folder, replacing an earlier state, and opens the result."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{root}/{name}")
        return KnowledgeBase.load(self._raw[0].sparkSession, root, self.params)

    def for_forms(self, forms: DataFrame) -> KnowledgeBase:
        """What linking these surface forms (sf) needs: their part of the dictionary, and of links, document words and
        embeddings what belongs to their candidates. The raw tables are filtered before anything is aggregated; word
        statistics and the number of entities stay those of the whole."""
        forms = forms.select("sf").distinct()
        mention = cut(mention_dictionary(self._raw[1].join(forms, "sf", "left_semi")))
        ids = cut(mention.select("entity_id").distinct())
        of = lambda df, key: df.join(ids.withColumnRenamed("entity_id", key), key, "left_semi")
        part = KnowledgeBase(
            of(self._raw[0], "entity_id"), mention, of(self._raw[2], "to_id"), of(self._raw[3], "doc_id"), of(self._raw[4], "doc_id"),
            self._raw[5], self.params,
        )
        part.__dict__.update(mention=mention, word_vec=self.word_vec, word_freq=self.word_freq, pages=self.pages)
        if "doc_embedding" in self.__dict__:
            part.__dict__["doc_embedding"] = of(self.doc_embedding, "doc_id")
        part.__dict__["link"] = cut(link_set(part._raw[2]))
        return part

    @cached_property
    def dim(self) -> int:
        """Length of the vectors; raises where a length is asked for that no word vector has."""
        found = vector_dim(self._raw[5])
        if self.params.dim and found and not word_vectors(self._raw[5], self.params.dim).take(1):
            raise ValueError(f"no word vector has {self.params.dim} numbers; most have {found}")
        return self.params.dim or found

    @cached_property
    def pages(self) -> DataFrame:
        return self.entity.agg(F.count("*").alias("wp"))

    @cached_property
    def entity(self) -> DataFrame:
        return entity_table(self._raw[0])

    @cached_property
    def mention(self) -> DataFrame:
        return mention_dictionary(self._raw[1])

    @cached_property
    def link(self) -> DataFrame:
        return link_set(self._raw[2])

    @cached_property
    def doc_token(self) -> DataFrame:
        return document_tokens(self._raw[3])

    @cached_property
    def word_vec(self) -> DataFrame:
        return word_vectors(self._raw[5], self.dim)

    @cached_property
    def word_freq(self) -> DataFrame:
        return cut(word_statistics(self.doc_token, self.word_vec))

    @cached_property
    def doc_embedding(self) -> DataFrame:
        stored = stored_embeddings(self._raw[4], self.dim)
        return cut(complete_embeddings(stored, self.doc_token, self.word_vec, self.word_freq, self.params, self.dim))


def entity_table(raw: DataFrame) -> DataFrame:
    """(entity_id, name, name_lower): each entity once. name_lower is recomputed, so missing and stale ones are filled.
    Rows without id or name are left out; of several names of an id the least counts (``duplicate_keys`` reports them)."""
    return (
        raw.where("entity_id is not null and name is not null")
        .groupBy("entity_id")
        .agg(F.min("name").alias("name"))
        .withColumn("name_lower", F.lower("name"))
    )


def duplicate_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, versions): keys that come with more than one value; a bulk insert with unique keys would stop there."""
    return (
        df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
        .groupBy(key)
        .agg(F.count_distinct(value).alias("versions"))
        .where("versions > 1")
    )


def mention_dictionary(*increments: DataFrame) -> DataFrame:
    """(sf, entity_id, n): the merged counts of any number of increments (sf, entity_id, n). NULL names, entities and
    counts add nothing; pairs whose counts sum to 0 or less are no candidates. Merging a merged table again is the
    incremental upsert."""
    rows = None
    for inc in increments:
        part = inc.select("sf", "entity_id", "n").where("sf is not null and entity_id is not null and n is not null")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("sf", "entity_id").agg(F.sum("n").cast("long").alias("n")).where("n > 0")


def link_set(*increments: DataFrame) -> DataFrame:
    """(to_id, from_id): the merged set of links. Self-links count, and the source need not be an entity."""
    rows = None
    for inc in increments:
        part = inc.select("to_id", "from_id").where("to_id is not null and from_id is not null")
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


def inlink_counts(link: DataFrame) -> DataFrame:
    """(to_id, inlinks) of a distinct link set; the partial count makes a hot target one row a task."""
    return link.groupBy("to_id").agg(F.count("*").alias("inlinks"))


def inlink_pieces(link: DataFrame, most: int = PIECE_LINKS) -> DataFrame:
    """(to_id, piece, from_ids) of a distinct link set: every target with its whole set, sorted, in piece 0 up to ``most``
    sources and else in a piece for each range of ``most`` source ids, so no row has more than ``most``. Hot targets meet
    their size by a broadcast join, and (target, piece) spreads them over all tasks."""
    sized = skew_join(link, inlink_counts(link), "to_id")
    range_of = F.floor(F.col("from_id") / F.lit(most)).cast("long") + 1
    placed = sized.select("to_id", "from_id", F.when(F.col("inlinks") <= most, F.lit(0).cast("long")).otherwise(range_of).alias("piece"))
    return placed.groupBy("to_id", "piece").agg(F.array_sort(F.collect_set("from_id")).alias("from_ids"))


def title_mentions(entity: DataFrame) -> DataFrame:
    """(sf, entity_id, n): every entity is meant once by its own lower-case name."""
    return entity.select(F.lower("name").alias("sf"), "entity_id", F.lit(1).cast("long").alias("n"))


def vector_dim(raw: DataFrame) -> int:
    """The most common length of the vectors (the smaller of two as common), 0 without any. One small row comes back."""
    sizes = raw.where(F.col("word").isNotNull() & (F.size("vec") > 0)).groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.min_by("d", F.struct(-F.col("n"), "d")).alias("d")).first()["d"]
    return best or 0


def word_vectors(raw: DataFrame, dim: int) -> DataFrame:
    """(word, vec): usable vectors; of several of a word the least counts."""
    return raw.where(F.col("word").isNotNull() & usable(F.col("vec"), dim)).groupBy("word").agg(F.min("vec").alias("vec"))


def document_tokens(raw: DataFrame) -> DataFrame:
    """(doc_id, word, f): each pair once; NULL keys are left out, a NULL f counts as 0."""
    return (
        raw.where("doc_id is not null and word is not null")
        .groupBy("doc_id", "word")
        .agg(F.coalesce(F.max("f"), F.lit(0)).cast("long").alias("f"))
    )


def stored_embeddings(raw: DataFrame, dim: int) -> DataFrame:
    """(doc_id, vec): stored vectors of the right length, zero vectors included; of several the least counts."""
    return raw.where(F.col("doc_id").isNotNull() & usable(F.col("vec"), dim)).groupBy("doc_id").agg(F.min("vec").alias("vec"))


def complete_embeddings(stored: DataFrame, doc_token: DataFrame, word_vec: DataFrame, word_freq: DataFrame, p: Params, dim: int) -> DataFrame:
    """(doc_id, vec): the stored vector where there is one, else the one computed from the document's words. Only the
    missing documents are computed; zero vectors are left out, as they match nothing."""
    missing = doc_token.join(stored.select("doc_id"), "doc_id", "left_anti")
    made = document_embedding(missing, word_vec, word_freq, p, dim)
    return stored.unionByName(made).where(nonzero(F.col("vec")))


def resolve(targets: DataFrame, entity: DataFrame) -> DataFrame:
    """targets (…, target) with the entity each means: the only one of that lower-case name whatever its case, else the
    one of exactly that name, else none (the row is dropped). Adaptive execution splits hot targets."""
    lower = entity.select("entity_id", "name", "name_lower")
    k = lower.groupBy("name_lower").agg(
        F.count("*").alias("k"), F.min("entity_id").alias("only_id"), F.collect_list(F.struct("name", "entity_id")).alias("same")
    )  # names that differ in case only: a handful
    rows = targets.withColumn("name_lower", F.lower("target")).join(k, "name_lower")
    exact = F.try_element_at(F.filter("same", lambda s: s["name"] == F.col("target")), F.lit(1))["entity_id"]
    return (
        rows.withColumn("entity_id", F.when(F.col("k") == 1, F.col("only_id")).otherwise(exact))
        .where("entity_id is not null")
        .drop("name_lower", "k", "only_id", "same")
    )
