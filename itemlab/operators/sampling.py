"""Reproducible samples, splits, folds and orders.

Every draw orders rows by md5(seed | id), so it depends on the seed and the rows alone. A class
may hold most of the table, so ranks inside a class come from bucket counts (see plans.ranking)
and never from one sort of the class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlab.config import DEFAULTS, Defaults
from itemlab.operators.evaluation import is_positive, worst_errors
from itemlab.plans.ranking import draw_key, rank_by_draw, rank_in_order
from itemlab.plans.staging import stage


def _class_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("cls").agg(F.count("*").alias("n"))


def balanced_sample(items: DataFrame, seed: int = DEFAULTS.seed) -> DataFrame:
    """Every class cut down to the size of the smallest one."""
    smallest = _class_sizes(items).agg(F.min("n")).scalar()
    picked = rank_by_draw(items, draw_key(seed, "id"), ["cls"], limit=smallest)
    return picked.drop("rank", "group_size")


def subsample_class(
    items: DataFrame,
    cls: str,
    limit: int = DEFAULTS.majority_limit,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """At most `limit` rows of one class, all others whole: `status` kept or not_sampled."""
    ranked = rank_by_draw(items.where(F.col("cls") == cls), draw_key(seed, "id"), ["cls"])
    status = F.when(F.col("rank") <= limit, "kept").otherwise("not_sampled")
    one = ranked.withColumn("status", status).drop("rank", "group_size")
    # A row without a class belongs to the others.
    others = items.where((F.col("cls") != cls) | F.col("cls").isNull())
    return one.unionByName(others.withColumn("status", F.lit("kept")))


def stratified_split(
    items: DataFrame,
    fractions: Sequence[float] = DEFAULTS.fractions,
    seed: int = DEFAULTS.seed,
    splits: Sequence[str] = DEFAULTS.splits,
) -> DataFrame:
    """Each class cut by the fractions: replaces `split`.

    Every part but the last has round(n * fraction) rows, halves to the even number; the last
    takes the rest. A class too small to give every part a row makes the job fail.
    """
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError(f"the parts {tuple(fractions)} are not a whole")
    ranked = rank_by_draw(items.drop("split"), draw_key(seed, "id"), ["cls"])
    n = F.col("group_size").cast("double")
    ends, end = [], F.lit(0).cast("long")
    for fraction in fractions[:-1]:
        end = end + F.rint(n * F.lit(fraction)).cast("long")
        ends.append(end)
    split = F.lit(splits[-1])
    for name, upto in reversed(list(zip(splits, ends))):
        split = F.when(F.col("rank") <= upto, name).otherwise(split)
    starts = [F.lit(0).cast("long"), *ends]
    stops = [*ends, F.col("group_size")]
    short = F.lit(False)
    for start, stop in zip(starts, stops):
        short = short | (stop <= start)
    failure = F.format_string("class %s: a part would be empty", F.coalesce("cls", F.lit("(none)")))
    checked = F.when(short, F.raise_error(failure).cast("string")).otherwise(split)
    return ranked.withColumn("split", checked).drop("rank", "group_size")


def capped_stratified_sample(
    items: DataFrame, cap: int = DEFAULTS.leak_cap, seed: int = DEFAULTS.seed
) -> DataFrame:
    """All rows, or round(cap * n_class / n) rows of each class when there are more than `cap`."""
    total = items.agg(F.count("*")).scalar()
    share = F.rint(F.lit(float(cap)) * F.col("group_size") / total).cast("long")
    limit = F.when(total > cap, share).otherwise(F.col("group_size"))
    picked = rank_by_draw(items, draw_key(seed, "id"), ["cls"], limit=limit)
    return picked.drop("rank", "group_size")


def stratified_folds(items: DataFrame, k: int = DEFAULTS.leak_folds, seed: int = DEFAULTS.seed) -> DataFrame:
    """Add `fold` 0..k-1, each class dealt out evenly."""
    ranked = rank_by_draw(items, draw_key(seed, "id"), ["cls"])
    fold = ((F.col("rank") - 1) % k).cast("int")
    return ranked.withColumn("fold", fold).drop("rank", "group_size")


def systematic_sample(items: DataFrame, n: int, order: Sequence[str] = ("id",)) -> DataFrame:
    """min(n, rows) rows evenly spaced in the given order, the first and the last included.

    The order columns must identify a row: only they are sorted, and the sample's at most n keys
    then pick the whole rows.
    """
    ranked = rank_in_order(items.select(*order), list(order))
    total = ranked.agg(F.count("*").alias("rows"))
    steps = F.greatest(F.least(F.lit(n).cast("long"), F.col("rows")) - 1, F.lit(0).cast("long"))
    places = (
        total.where("rows > 0")
        .withColumn("steps", steps)
        .select("rows", "steps", F.explode(F.sequence(F.lit(0).cast("long"), "steps")).alias("k"))
        .select(
            F.when(F.col("k") == F.col("steps"), F.when(F.col("steps") == 0, 0).otherwise(F.col("rows") - 1))
            .otherwise(F.floor(F.col("k") * ((F.col("rows") - 1) / F.col("steps"))))
            .cast("long")
            .alias("rank")
        )
        .distinct()
    )
    keys = stage(ranked.join(stage(places, "places"), "rank", "left_semi").drop("rank"), "picked")
    # Staged, so that Catalyst knows how many they are and joins accordingly.
    return items.join(keys, list(order), "left_semi")


def pick_examples(
    preds: DataFrame, threshold: float, k: int = 2, wrong: int = 4, seed: int = DEFAULTS.seed
) -> DataFrame:
    """k random correct rows of each label and the `wrong` worst errors: adds `kind`."""
    right = preds.where(is_positive(F.col("p"), threshold).cast("int") == F.col("y"))
    drawn = rank_by_draw(right, draw_key(seed, "id"), ["y"], limit=k)
    columns = preds.columns
    return (
        drawn.select(*columns)
        .withColumn("kind", F.lit("correct"))
        .unionByName(
            worst_errors(preds, threshold, wrong).select(*columns).withColumn("kind", F.lit("wrong"))
        )
    )


def class_weights(items: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """(cls, n, weight) with weight n_total / (n_classes * n); fails on an empty class."""
    sizes = _class_sizes(items)
    if classes is not None:
        wanted = items.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")
        )
        empty = F.raise_error(F.concat(F.lit("no items of class "), F.col("cls"))).cast("long")
        sizes = wanted.join(sizes, "cls", "left").withColumn(
            "n", F.when(F.col("n").isNull(), empty).otherwise(F.col("n"))
        )
    totals = sizes.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return sizes.withColumn("_t", totals).select(
        "cls", "n", (F.col("_t.rows") / (F.col("_t.classes") * F.col("n"))).alias("weight")
    )


def epoch_shuffle(
    items: DataFrame, epoch: int | Column, batch: int, seed: int = DEFAULTS.seed
) -> DataFrame:
    """Add `position` and `batch` (from 0) in the random order of one epoch."""
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    ranked = rank_by_draw(items, draw_key(seed, epoch, "id"), [])
    position = F.col("rank") - 1
    return (
        ranked.withColumn("position", position)
        .withColumn("batch", F.floor(position / batch).cast("int"))
        .drop("rank", "group_size")
    )


def value_profile(batch: DataFrame, value: Column, classes: Sequence[str]) -> DataFrame:
    """Smallest and largest value and rows per class of one batch: shows wrong scaling or labels."""
    return batch.agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        *[F.count_if(F.col("cls") == c).alias(f"n_{c}") for c in classes],
    )
