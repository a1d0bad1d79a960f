"""Writing: tables, mergeable upserts, score files and scalars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.operators.kb import link_set, mention_dictionary


def write_table(df: DataFrame, path: str) -> None:
    """Replaces a table; an earlier state of it is dropped, so running a phase again does not count twice."""
    df.write.mode("overwrite").parquet(path)


def insert_unique(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose keys are new and unique. Raises, and writes nothing, if a key occurs twice among the rows or is
    stored already, whatever else the rows hold. NULL keys are refused too; an empty table appends nothing."""
    spark = df.sparkSession
    own = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    rows = own.withColumn("stored", F.lit(False))
    if _exists(spark, path):
        stored = spark.read.parquet(path).select(F.col(key).alias("k"), F.lit(True).alias("there"))
        rows = own.join(stored, "k", "left").select("k", "n", F.col("there").isNotNull().alias("stored"))
    bad = rows.where("n > 1 or stored or k is null").take(1)
    if bad:
        raise ValueError(f"{key} {bad[0]['k']!r} " + ("is stored already" if bad[0]["stored"] else "is NULL" if bad[0]["k"] is None else f"occurs {bad[0]['n']} times"))
    df.write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def latest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The last complete version of a versioned table, or the last one before a number; None if there is none."""
    found = [v for v in _versions(spark, root) if before is None or v < before]
    return spark.read.parquet(f"{root}/v={found[-1]}") if found else None


def merge_version(increment: DataFrame, root: str, version: int, merge: Callable[..., DataFrame], keep: int = 3) -> None:
    """Writes version ``version`` of a table: the version before it merged with the increment. A version is complete or
    absent, so a lost executor or driver leaves the one before. Older versions beyond ``keep`` are removed."""
    spark = increment.sparkSession
    old = latest(spark, root, version)
    (merge(increment) if old is None else merge(old, increment)).write.mode("overwrite").parquet(f"{root}/v={version}")
    jvm = spark.sparkContext._jvm
    for v in _versions(spark, root)[:-keep]:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/v={v}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _next_version(spark: SparkSession, root: str) -> int:
    return max(_versions(spark, root), default=-1) + 1


def upsert_mentions(increment: DataFrame, root: str) -> None:
    """Adds counts (sf, entity_id, n) to a versioned dictionary."""
    merge_version(increment, root, _next_version(increment.sparkSession, root), mention_dictionary)


def upsert_links(increment: DataFrame, root: str) -> None:
    """Adds links (to_id, from_id) to a versioned link set."""
    merge_version(increment, root, _next_version(increment.sparkSession, root), link_set)


def write_scores(scored: DataFrame, entity: DataFrame, path: str) -> None:
    """CSV files with a header: SurfaceForm, Candidate (``id: name``), Count, ContextSimilarity, InitialScore, FinalScore."""
    rows = scored.join(entity.select("entity_id", "name"), "entity_id")
    rows.select(
        F.col("sf").alias("SurfaceForm"),
        F.concat(F.col("entity_id").cast("string"), F.lit(": "), F.col("name")).alias("Candidate"),
        F.col("n").alias("Count"),
        F.col("ctx_sim").alias("ContextSimilarity"),
        F.coalesce("isa", F.lit(0.0)).alias("InitialScore"),
        F.coalesce("pa", F.lit(0.0)).alias("FinalScore"),
    ).write.mode("overwrite").option("header", True).csv(path)


def write_nodes(scored: DataFrame, path: str) -> None:
    """CSV files of the graph's nodes: SurfaceForm, Candidate."""
    nodes = scored.where("forms > 1").select(F.col("sf").alias("SurfaceForm"), F.col("entity_id").alias("Candidate"))
    nodes.write.mode("overwrite").option("header", True).csv(path)


def write_scalar(df: DataFrame, path: str) -> None:
    """A one-row, one-column table as a text file."""
    df.select(F.col(df.columns[0]).cast("string")).coalesce(1).write.mode("overwrite").text(path)
