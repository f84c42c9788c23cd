"""Samples and splits: sizes, disjointness, repeatability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemlab.operators import sampling
from itemlab.plans.ranking import rank_in_order


def items_of(spark, sizes):
    rows, i = [], 0
    for cls, n in sizes.items():
        for _ in range(n):
            rows.append((i, cls, "all"))
            i += 1
    return spark.createDataFrame(rows, "id long, cls string, split string")


def counts(df, *by):
    return {tuple(r[:-1]) if len(by) > 1 else r[0]: r[-1] for r in df.groupBy(*by).count().collect()}


def test_split_sizes_round_half_to_even(spark):
    items = items_of(spark, {"a": 525, "b": 30})
    split = sampling.stratified_split(items)
    assert counts(split, "cls", "split") == {
        ("a", "train"): 368, ("a", "val"): 79, ("a", "test"): 78,
        ("b", "train"): 21, ("b", "val"): 4, ("b", "test"): 5,
    }
    again = sampling.stratified_split(items.repartition(11))
    assert split.exceptAll(again.select(*split.columns)).count() == 0
    other = sampling.stratified_split(items, seed=43)
    assert split.exceptAll(other.select(*split.columns)).count() > 0


def test_a_class_too_small_to_split_fails(spark):
    with pytest.raises(Exception, match="class b: a part would be empty"):
        sampling.stratified_split(items_of(spark, {"a": 100, "b": 2})).collect()
    with pytest.raises(ValueError):
        sampling.stratified_split(items_of(spark, {"a": 100}), (0.5, 0.2, 0.2))


def test_balanced_and_capped(spark):
    items = items_of(spark, {"a": 500, "b": 40, "c": 90})
    assert counts(sampling.balanced_sample(items), "cls") == {"a": 40, "b": 40, "c": 40}
    capped = counts(sampling.capped_stratified_sample(items, 100), "cls")
    assert capped == {"a": round(100 * 500 / 630), "b": round(100 * 40 / 630), "c": round(100 * 90 / 630)}
    assert sampling.capped_stratified_sample(items, 10_000).count() == 630
    cut = counts(sampling.subsample_class(items, "a", 70), "cls", "status")
    assert cut == {("a", "kept"): 70, ("a", "not_sampled"): 430, ("b", "kept"): 40, ("c", "kept"): 90}


def test_folds_are_even(spark):
    folds = counts(sampling.stratified_folds(items_of(spark, {"a": 52, "b": 9}), 5), "cls", "fold")
    assert max(folds.values()) == 11 and folds[("b", 4)] == 1 and folds[("a", 0)] == 11


@pytest.mark.parametrize("n", [1, 2, 7, 32, 300])
def test_systematic_sample_is_evenly_spaced(spark, n):
    items = items_of(spark, {"a": 100}).withColumn("path", F.format_string("%05d", "id"))
    got = sorted(r.id for r in sampling.systematic_sample(items, n, ["path"]).collect())
    assert got == sorted(set(np.linspace(0, 99, min(n, 100)).astype(int).tolist()))


def test_rank_in_order_counts_all_rows(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    got = [r.rank for r in rank_in_order(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1000))


def test_epoch_order_is_a_permutation_that_differs_by_epoch(spark):
    items = items_of(spark, {"a": 70})
    first = sampling.epoch_shuffle(items, 1, 32)
    assert sorted(r.position for r in first.collect()) == list(range(70))
    assert counts(first, "batch") == {0: 32, 1: 32, 2: 6}
    second = sampling.epoch_shuffle(items, 2, 32)
    assert [r.id for r in first.orderBy("position").collect()] != [
        r.id for r in second.orderBy("position").collect()
    ]


def test_class_weights(spark):
    weights = {r.cls: r.weight for r in sampling.class_weights(items_of(spark, {"a": 700, "b": 368})).collect()}
    assert weights["a"] == pytest.approx(1068 / (2 * 700)) and weights["b"] == pytest.approx(1068 / (2 * 368))
    with pytest.raises(Exception, match="no items of class z"):
        sampling.class_weights(items_of(spark, {"a": 7}), ["a", "z"]).collect()


def test_rows_without_a_class_are_kept(spark):
    rows = [(i, ("a", "b", None)[i % 3], f"p{i}") for i in range(60)]
    items = spark.createDataFrame(rows, "id long, cls string, path string")
    parts = sampling.stratified_split(items).collect()
    assert sorted(r.id for r in parts) == list(range(60))
    assert sorted(r.id for r in sampling.stratified_folds(items).collect()) == list(range(60))
    assert sampling.balanced_sample(items).count() == 60
    assert sampling.capped_stratified_sample(items, cap=30).count() == 30
