"""Per-key results although a few keys hold most rows.

A frequent-items sketch (one pass, JVM-side, mergeable) names the keys that may be hot. Its result is at most ``TOP`` keys
whatever the input, so it may be broadcast. Rows of hot keys take a salted path, all others an ordinary shuffle; the two
results are united. Nothing is sampled, capped or dropped: a key the sketch misses merely takes the ordinary path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items the sketch tracks, and keys read from it. The sketch errs by at most 3.5 / TRACKED of the rows, so every key
#: above 1/TOP of the rows is among the TOP largest estimates.
TRACKED, TOP = 16384, 256


def hot_candidates(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that may hold more than ``share`` of the rows: at most TOP rows of (hot_key), without false negatives for
    shares of at least 1/128. NULL is no key. An empty table gives no rows."""
    if not 1 / 128 <= share < 1:
        raise ValueError("share must lie in [1/128, 1)")
    rows = df.select(F.col(key).alias("hot_key")).agg(
        F.count("*").alias("all_rows"),
        F.expr(f"approx_top_k(hot_key, {TOP}, {TRACKED})").alias("top"),
    )
    floor = F.col("all_rows") * (share - 3.5 / TRACKED)
    return (
        rows.select("all_rows", F.explode("top").alias("t"))
        .where(F.col("t.item").isNotNull() & (F.col("t.count") >= floor))
        .select(F.col("t.item").alias("hot_key"))
        .distinct()
    )


def hot_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """(key, rows) of every key with more than ``share`` of all rows, counted exactly.

    Candidates come from the sketch; a broadcast join with them (TOP rows at most) keeps only their rows, which partial
    aggregation reduces to one row a key and task before anything is shuffled. Rows with a NULL key count in the total but
    are no key. Ties, repeated rows and extra columns do not matter; an empty table gives no rows.
    """
    hot = hot_candidates(df, key, share)
    counted = (
        df.select(F.col(key).alias("hot_key"))
        .join(F.broadcast(hot), "hot_key")
        .groupBy("hot_key")
        .agg(F.count("*").alias("rows"))
    )
    total = df.agg(F.count("*").alias("all_rows"))
    return (
        counted.crossJoin(F.broadcast(total))  # one row
        .where(F.col("rows") > F.col("all_rows") * F.lit(share))
        .select(F.col("hot_key").alias(key), "rows")
    )


def _split(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    hot = F.broadcast(hot_candidates(df, key, share))
    same = df[key].eqNullSafe(hot["hot_key"])
    return df.join(hot, same, "left_semi"), df.join(hot, same, "left_anti")


def skew_join(df: DataFrame, per_key: DataFrame, key: str, share: float = 1 / 128) -> DataFrame:
    """df inner join per_key on ``key``; per_key has at most one row a key.

    Rows of hot keys meet their few per_key rows (TOP at most) by a broadcast join and stay where they are; all other rows
    take the ordinary shuffle join. NULL keys join nothing.
    """
    hot = hot_candidates(df, key, share)
    heavy, light = _split(df.where(F.col(key).isNotNull()), key, share)
    few = per_key.join(F.broadcast(hot.withColumnRenamed("hot_key", key)), key, "left_semi")
    return heavy.join(F.broadcast(few), key).unionByName(light.join(per_key, key))


def skew_distinct_count(df: DataFrame, key: str, member: str, out: str, share: float = 1 / 128) -> DataFrame:
    """(key, out): distinct non-null members of each non-null key.

    Duplicates go by (key, member), which spreads a key over all tasks, and the count that follows combines before its
    shuffle: no task holds the members of a key, hot or just below the sketch's threshold. Hot keys are salted as well, so
    the last step sees a row a salt and not a row a task. A key whose members are all NULL has 0.
    """
    rows = df.select(F.col(key), F.col(member)).where(F.col(key).isNotNull())
    heavy, light = _split(rows, key, share)
    salt = F.pmod(F.xxhash64(member), F.lit(64)).alias("salt")
    spread = heavy.groupBy(key, member).agg(F.lit(1).alias("one")).groupBy(key, salt).agg(F.count(member).alias(out))
    heavy_out = spread.groupBy(key).agg(F.sum(out).alias(out))
    light_out = light.groupBy(key, member).agg(F.lit(1).alias("one")).groupBy(key).agg(F.count(member).alias(out))
    return heavy_out.unionByName(light_out)


def skew_sum(df: DataFrame, key: str, sub: str, value: str, out: str, share: float = 1 / 128) -> DataFrame:
    """(key, sub, out): the sum of value for each (key, sub) with both non-null; NULL values add nothing, and a pair with
    NULLs only has 0.

    Hot keys are reduced by (key, sub, salt) first, so the final step sees at most one row a salt, however many rows a
    single pair has. Other keys take one ordinary shuffle by (key, sub).
    """
    rows = df.select(F.col(key), F.col(sub), F.coalesce(F.col(value), F.lit(0)).alias(out)).where(
        F.col(key).isNotNull() & F.col(sub).isNotNull()
    )
    heavy, light = _split(rows, key, share)
    salted = heavy.groupBy(key, sub, _salt().alias("salt")).agg(F.sum(out).alias(out))
    return salted.groupBy(key, sub).agg(F.sum(out).alias(out)).unionByName(light.groupBy(key, sub).agg(F.sum(out).alias(out)))


def _salt(buckets: int = 64) -> Column:
    """A salt a task computes from the row's place: rows of one key and task get few salts, tasks differ."""
    return F.pmod(F.spark_partition_id(), F.lit(buckets))
