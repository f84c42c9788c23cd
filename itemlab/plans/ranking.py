"""Ranks and running sums over a whole table without sorting it in one task.

A window without a partition key, or partitioned by a class column with two values, puts all
rows into one or two tasks. Here the order key is cut into buckets first: bucket sizes are
counted (a small table), their running sum gives each bucket its offset, and only the rows of
one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlab.config import DEFAULTS
from itemlab.plans.staging import stage


def draw_key(seed: int | Column, *parts: str | Column) -> Column:
    """A repeatable pseudo-random key: the md5 of the seed and the identifying columns.

    It does not depend on partitioning, so a recomputed task gives the same draw.
    """
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", seed.cast("string"), *[c.cast("string") for c in columns]))


def draw_uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a draw key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _bucket_offsets(df: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    """Per (by, bucket): rows before this bucket, rows in it, and rows of the whole group."""
    sizes = df.groupBy(*by, bucket.alias("_bucket")).agg(F.count("*").alias("_size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(group).alias("group_size"),
    )


def rank_by_draw(
    df: DataFrame,
    draw: Column,
    by: list[str],
    tie: str = "id",
    rank: str = "rank",
    limit: Column | int | None = None,
    digits: int = DEFAULTS.rank_digits,
) -> DataFrame:
    """1-based position of each row inside its group in draw order, plus `group_size`.

    The draw is a uniform hex string, so its leading digits cut every group into equal buckets
    however large the group is. With `limit`, rows whose rank must exceed it are dropped by
    their bucket alone, before anything is sorted; `limit` may use the `by` columns and
    `group_size`.

    The offsets have at most 16**digits rows per group. They are staged, so that Catalyst knows
    their true size: for a class column they are broadcast, and with so many groups that they
    exceed spark.sql.autoBroadcastJoinThreshold they are shuffled by the same key as the ranks.
    """
    drawn = df.withColumn("_draw", draw)
    bucket = F.substring("_draw", 1, digits)
    offsets = _bucket_offsets(drawn, by, bucket)
    if limit is not None:
        limit = limit if isinstance(limit, Column) else F.lit(limit)
        offsets = offsets.withColumn("_limit", limit)
    # Rows without a group form one too: the join must not lose them.
    offsets = stage(offsets.toDF(*[f"_of_{c}" for c in offsets.columns]), "offsets")
    same = F.col("_bucket") == F.col("_of__bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    known = ["_before", "group_size", *(["_limit"] if limit is not None else [])]
    keyed = drawn.withColumn("_bucket", bucket).join(offsets, same).select(
        *drawn.columns, "_bucket", *[F.col(f"_of_{c}").alias(c) for c in known]
    )
    if limit is not None:
        keyed = keyed.where(F.col("_before") < F.col("_limit"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_draw", tie)
    ranked = keyed.withColumn(rank, (F.col("_before") + F.row_number().over(inside)).cast("long"))
    if limit is not None:
        ranked = ranked.where(F.col(rank) <= F.col("_limit")).drop("_limit")
    return ranked.drop("_draw", "_bucket", "_before")


def rank_in_order(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """0-based position of each row in the order of the given columns, for tables of any size.

    The rows are range-partitioned, sorted and staged once with their (partition, row) number;
    the partition sizes then turn it into a global position. The staged numbers cannot change
    when a later task is recomputed.
    """
    row_bits = 33  # monotonically_increasing_id keeps the row number in its low 33 bits
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_place", row_bits)
    offsets = _bucket_offsets(placed, [], part).select("_bucket", "_before")
    # One row per range partition: bounded by spark.sql.shuffle.partitions.
    return (
        placed.withColumn("_bucket", part)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(
            rank, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << row_bits) - 1))
        )
        .drop("_place", "_bucket", "_before")
    )
