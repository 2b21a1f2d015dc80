"""Reproducible samples: fixed-size draws, exact splits and small samples.

Rows are ordered by a hash of their key and a seed. The order does not depend
on partitions, so a retried task or another cluster size gives the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEX_DIGITS = 15  # 60 bits: exact as a bigint
_GROUP_DIGITS = 4


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_number(digest: Column) -> Column:
    """The leading hexadecimal digits of a digest as a whole number."""
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """`n` random rows without replacement, for small `n` (a top-k plan)."""
    return (
        df.withColumn("__hash", seeded_hash(key, seed)).orderBy("__hash").limit(n).drop("__hash")
    )


def _grouped(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with their hash and its leading digits as a group."""
    hashed = df.withColumn("__hash", seeded_hash(F.col(key), seed))
    return hashed.withColumn("__group", F.substring("__hash", 1, _GROUP_DIGITS))


def _group_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("__group").agg(F.count(F.lit(1)).alias("__size"))


def with_dense_index(
    df: DataFrame, key: str, seed: int = 42, index: str = "row_index", total: str | None = None
) -> DataFrame:
    """Number all rows 1..N in hash order without a single-task window.

    Rows fall into 65,536 groups by the leading hash digits. Group sizes are
    counted with a map-side combine, turned into offsets over that bounded
    number of groups, and added to the position within the group. Hashing
    spreads the groups evenly, whatever the distribution of the keys; `key`
    must be unique. `total` names an optional column that holds N.
    """
    grouped = _grouped(df, key, seed)
    everything = Window.orderBy("__group").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    running = Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _group_sizes(grouped).select(
        "__group",
        F.coalesce(F.sum("__size").over(running), F.lit(0)).alias("__offset"),
        *([F.sum("__size").over(everything).alias(total)] if total else []),
    )
    within = Window.partitionBy("__group").orderBy("__hash", key)
    return (
        grouped.withColumn("__position", F.row_number().over(within))
        .join(offsets, "__group")
        .withColumn(index, (F.col("__offset") + F.col("__position")).cast("bigint"))
        .drop("__group", "__position", "__offset", "__hash")
    )


def bootstrap_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows drawn with replacement; `draw` numbers the draws from 1.

    Every draw picks a row number from a hash of its own number, and one
    equi-join on that number fetches the row.
    """
    indexed = with_dense_index(df, key, seed)
    total = _group_sizes(_grouped(df, key, seed)).agg(F.sum("__size")).scalar()
    draws = df.sparkSession.range(1, n + 1).select(
        F.col("id").alias("draw"),
        (hash_number(seeded_hash(F.col("id"), seed)) % total + 1).alias("row_index"),
    )
    return draws.join(indexed, "row_index")


def mark_test_rows(
    df: DataFrame, key: str, test_percent: int = 30, seed: int = 42
) -> DataFrame:
    """Add `is_test`: exactly trunc(N * percent / 100) rows, the first in hash order.

    The rows are not numbered: the sizes of the 65,536 groups of leading hash
    digits tell in which one the last test row lies, and that group alone is
    put in order to find it. Each row is then compared with the last test row,
    so the table is neither shuffled nor joined. `key` must be unique. The keys
    are read twice before the rows are; write a table that is costly to compute.
    """
    keys = _grouped(df.select(key), key, seed)
    sizes = sorted((r["__group"], r["__size"]) for r in _group_sizes(keys).collect())
    wanted = sum(n for _, n in sizes) * test_percent // 100
    group, before = None, 0
    for name, n in sizes:
        if wanted and before + n >= wanted:
            group = name
            break
        before += n
    if group is None:
        return df.withColumn("is_test", F.lit(False))
    ordered = keys.filter(F.col("__group") == group).orderBy("__hash", key)
    last = ordered.limit(wanted - before).orderBy(F.desc("__hash"), F.desc(key)).first()
    own, hashed = F.col(key), seeded_hash(F.col(key), seed)
    border = F.lit(last[key]).cast(df.schema[key].dataType)
    is_test = (hashed < last["__hash"]) | ((hashed == last["__hash"]) & (own <= border))
    return df.withColumn("is_test", is_test)


def complement(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key is not among the chosen."""
    return df.join(chosen.select(key), key, "left_anti")
