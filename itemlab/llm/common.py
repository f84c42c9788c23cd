"""Small helpers that several of the operators share."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that Catalyst knows the size of, so that it picks the join."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, fields.names), fields)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(columns: list[str]) -> list[str]:
    """Names to work under, one for each column: apart from an operator's own, without dots or quotes."""
    return [f"odd_{i}" if "." in c or "`" in c else f"own_{c}" for i, c in enumerate(columns)]


def word_count(text: str | Column) -> Column:
    """Number of words (runs without ASCII white space); NULL counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(
    rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], bins: Column
) -> DataFrame:
    """Add, for each name in `values`, its sum over the rows of the same `by` that sort earlier.

    `bins` is a number that does not decrease along `order`, so that no sort sees more than one
    bin of a `by`: sums are taken inside a bin and shifted by the totals of earlier bins. The
    caller chooses enough bins for the table, and `order` leaves no ties between unlike rows.
    """
    binned = rows.withColumn("_bin", bins)
    totals = binned.groupBy(*by, "_bin").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("_bin").alias("_k_bin"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in values],
    )
    same = F.col("_bin") == F.col("_k_bin")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = (
        Window.partitionBy(*by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    own = binned.withColumns(
        {f"_i_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}
    )
    sums = [(F.col(f"_i_{n}") + F.col(f"_s_{n}")).alias(n) for n in values]
    return own.join(shifts, same, "left").select(*rows.columns, *sums)


def draw(seed: int, *parts: str | Column) -> Column:
    """A repeatable number from 0 to 2^62 - 1, evenly spread."""
    return F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 62) - 1))


def draw_bin(drawn: Column, bins: int) -> Column:
    """Which of `bins` equal ranges a drawn number falls into."""
    return F.floor(F.shiftright(drawn, 31) * F.lit(bins) / F.lit(1 << 31)).cast("long")


def bins_for(rows: int) -> int:
    """As many bins as rows in each, so that neither the bins nor their rows crowd a task."""
    return max(1, math.isqrt(rows))
