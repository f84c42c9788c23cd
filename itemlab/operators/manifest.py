"""The whole split: usable items, copies removed, one class cut, the rest split and named.

The manifest has every input row exactly once. Copies are removed over the whole table before
anything is sampled, so a copy can neither replace its original nor land in another split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlab.config import DEFAULTS, Defaults
from itemlab.functions.hashing import WORDS
from itemlab.operators.dedup import exact_dedup, near_dedup
from itemlab.operators.sampling import stratified_split, subsample_class
from itemlab.plans.staging import stage
from itemlab.sources.files import assign_output_names

MANIFEST = ("split", "class", "file", "source", "md5", "note")


def split_manifest(
    items: DataFrame,
    majority: str,
    cfg: Defaults = DEFAULTS,
    limit: int | None = None,
) -> DataFrame:
    """(split, class, file, source, md5, note) for every item.

    `items` has a `reason` for unusable rows (see quality.with_reason) and the hash words.
    `split` is train, val or test, or tells why the item is in none: skipped, removed or
    not_sampled. `limit` caps the class `majority`.
    """
    limit = cfg.majority_limit if limit is None else limit
    # The decisions need the hashes, the naming after them does not; no step carries anything else.
    record = ["id", "cls", "path", "name", "md5"]
    columns = [*record, "size", *WORDS]

    def left_out(df: DataFrame, split: str, note: str) -> DataFrame:
        return df.select(
            F.lit(split).alias("split"),
            F.col("cls").alias("class"),
            F.lit("").alias("file"),
            F.col("path").alias("source"),
            "md5",
            F.col(note).alias("note"),
        )

    skipped = left_out(items.where("reason IS NOT NULL"), "skipped", "reason")
    usable = items.where("reason IS NULL").select(*columns)
    # Each step is read by two others: by its successor and by the manifest.
    unique = stage(exact_dedup(usable), "unique")
    distinct = stage(
        near_dedup(unique.where("status = 'kept'").select(*columns), cfg.near_max_bits)
        .select(*record, "status", "note"),
        "distinct",
    )
    kept = distinct.where("status = 'kept'").select(*record)
    sampled = stage(subsample_class(kept, majority, limit, cfg.seed), "sampled")
    chosen = sampled.where("status = 'kept'").select(*record)
    named = assign_output_names(stratified_split(chosen, cfg.fractions, cfg.seed, cfg.splits))
    return (
        named.select(
            "split",
            F.col("cls").alias("class"),
            F.concat_ws("/", "split", "cls", "file").alias("file"),
            F.col("path").alias("source"),
            "md5",
            F.lit("").alias("note"),
        )
        .unionByName(skipped)
        .unionByName(left_out(unique.where("status = 'removed'"), "removed", "note"))
        .unionByName(left_out(distinct.where("status = 'removed'"), "removed", "note"))
        .unionByName(
            left_out(
                sampled.where("status = 'not_sampled'").withColumn(
                    "note", F.lit(f"left out by the limit of {limit}")
                ),
                "not_sampled",
                "note",
            )
        )
    )


def manifest_is_complete(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """One row: items, manifest rows, and sources listed other than once."""
    listed = manifest.groupBy("source").agg(F.count("*").alias("n"))
    matched = items.select(F.col("path").alias("source")).join(listed, "source", "full")
    return matched.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("not_once"),
    )


def split_sizes(manifest: DataFrame, splits: Sequence[str] = DEFAULTS.splits) -> DataFrame:
    return manifest.where(F.col("split").isin(*splits)).groupBy("split", "class").count()
