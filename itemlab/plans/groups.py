"""Attaching per-group facts to the rows of the group, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemlab.config import DEFAULTS
from itemlab.plans.staging import stage

#: Groups that are broadcast at most, one short row each.
MOST_HOT = 20_000


def attach(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    size: str,
    row_id: str = "id",
    hot_rows: int = DEFAULTS.hot_rows,
) -> DataFrame:
    """Left-join one row of facts per group onto the group's rows.

    `groups` holds `key`, its row count `size` and the facts. A group of at least `hot_rows`
    rows would send all of them to one task, so such groups are broadcast instead. Their number
    is checked: where there are more than MOST_HOT, only larger groups count as hot, and the
    others go the way of all groups. Rows of hot groups leave the key out of the shuffle join and
    are spread by `row_id`. Keys are strings or numbers from 0 on; rows with a NULL key get NULL
    facts.
    """
    facts = [c for c in groups.columns if c != key]
    packed = stage(groups.select(F.col(key).alias("_key"), F.struct(*facts).alias("_f")), "facts")
    while (found := packed.where(F.col(f"_f.{size}") >= hot_rows).count()) > MOST_HOT:
        hot_rows *= 4
    hot = packed.where(F.col(f"_f.{size}") >= hot_rows)
    cold = packed.where(F.col(f"_f.{size}") < hot_rows)

    # Stand-in keys for rows that must not meet a cold group: they match nothing.
    if isinstance(rows.schema[key].dataType, T.StringType):
        nowhere = F.concat(F.lit("#"), F.col(row_id).cast("string"))
    else:
        nowhere = -1 - F.xxhash64(row_id).bitwiseAND(F.lit((1 << 62) - 1))

    first = rows.withColumn("_own", F.col(key))
    if found:
        named = hot.select(F.col("_key").alias("_own"), F.col("_f").alias("_hot"))
        first = first.join(F.broadcast(named), "_own", "left")
    else:
        first = first.withColumn("_hot", F.lit(None).cast(packed.schema["_f"].dataType))
    keeps_key = F.col("_hot").isNull() & F.col("_own").isNotNull()
    second = (
        first.withColumn("_key", F.when(keeps_key, F.col("_own")).otherwise(nowhere))
        .join(cold, "_key", "left")
        .withColumn("_facts", F.coalesce("_hot", "_f"))
    )
    return second.select(
        *[F.col(c) for c in rows.columns], *[F.col(f"_facts.{f}").alias(f) for f in facts]
    )
