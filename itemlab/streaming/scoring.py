"""Admission and scoring of arriving rows, by the functions that batches use.

Both steps look at one row at a time, so they need no state, watermark or late-data rule, and
append each row once: the file sink's log makes a restarted query skip what it has written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlab.config import DEFAULTS
from itemlab.operators.evaluation import decide
from itemlab.plans.staging import scratch_path

# The HTTP status of each reason to reject an upload.
OK, UNSUPPORTED, BAD, TOO_LARGE = 200, 415, 400, 413


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Arriving parquet files as a stream, with the schema of those already there.

    `path` is a glob, so it may name single files as well as folders.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def admission_filter(
    rows: DataFrame,
    kind: Column,
    content: Column,
    readable: Column,
    kinds: Sequence[str],
    max_bytes: int = DEFAULTS.max_upload_bytes,
) -> DataFrame:
    """Add `status` and `admitted`: type first, then empty, too large, unreadable."""
    size = F.octet_length(content)
    status = (
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), UNSUPPORTED)
        .when(F.coalesce(size, F.lit(0)) == 0, BAD)
        .when(size > max_bytes, TOO_LARGE)
        .when(~readable, BAD)
        .otherwise(OK)
    )
    return rows.withColumn("status", status).withColumn("admitted", F.col("status") == OK)


def score_stream(rows: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Score and decide; the same call serves a stream and a batch."""
    return decide(rows.withColumn("p", score), threshold)


def run_available(stream: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process everything that has arrived into a parquet table and return that table.

    Partitioned by `admitted`, the table keeps accepted and rejected rows apart: one pass over
    the source, two folders to read from.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_progress")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
