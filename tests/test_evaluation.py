"""Evaluation on hand tables, against brute force and against published numbers."""

import random

import pytest
from pyspark.sql import functions as F

from itemlab.operators import evaluation as ev
from itemlab.operators import runs

# True and false positives of the published validation sweep at 0.05, 0.10, ...,
# 0.95, with 79 positives and 150 negatives.
VAL_TP = [79] * 9 + [78] * 3 + [77] * 6 + [74]
VAL_FP = [33, 23, 21, 14, 14, 13, 10, 10, 7, 6, 5, 5, 4, 3, 3, 3, 1, 0, 0]
# Published validation AUC of three seeds.
FROZEN_AUC = {42: 0.9962025284767151, 43: 0.9958649873733521, 44: 0.997679340839386}


def preds_of(spark, rows):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)], "id long, y int, p double")


def random_rows(seed, n=400, digits=2):
    rng = random.Random(seed)
    return [(y, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.25 * y, 0.2))), digits)) for y in rng.choices((0, 1), k=n)]


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y != 1]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def published_sweep(spark):
    rows = [
        (round(0.05 * (i + 1), 2), tp, fp, 150 - fp, 79 - tp)
        for i, (tp, fp) in enumerate(zip(VAL_TP, VAL_FP))
    ]
    return ev.with_rates(spark.createDataFrame(rows, "threshold double, tp long, fp long, tn long, fn long"))


def test_published_choice_of_thresholds(spark):
    swept = published_sweep(spark)
    chosen = ev.choose_threshold(swept).first()
    assert (chosen.threshold, chosen.met_floor) == (0.3, True)
    assert chosen.precision == pytest.approx(0.8586956521739131, abs=1e-15)
    assert ev.threshold_for_recall(swept).first().threshold == 0.9
    assert ev.nearest_threshold(swept, 0.325).first().threshold in (0.3, 0.35)


def test_published_report_at_the_tuned_threshold(spark):
    # 138 true negatives, 12 false positives, 1 false negative, 77 true positives.
    rows = [(0, 0.1)] * 138 + [(0, 0.9)] * 12 + [(1, 0.1)] + [(1, 0.9)] * 77
    report = {r.row: r for r in ev.classification_report(preds_of(spark, rows), 0.3).collect()}
    assert [round(report["1"][c], 3) for c in ("precision", "recall", "f1")] == [0.865, 0.987, 0.922]
    assert [round(report["0"][c], 3) for c in ("precision", "recall", "f1")] == [0.993, 0.92, 0.955]
    assert [round(report["macro"][c], 3) for c in ("precision", "recall", "f1")] == [0.929, 0.954, 0.939]
    assert [round(report["weighted"][c], 3) for c in ("precision", "recall", "f1")] == [0.949, 0.943, 0.944]
    assert ev.positive_share(preds_of(spark, rows)).first()[0] == pytest.approx(0.34210526315789475)


def test_published_seed_statistics(spark):
    rows = [(s, "frozen", "val_auc", v) for s, v in FROZEN_AUC.items()]
    one = runs.seed_summary(spark.createDataFrame(rows, "seed int, variant string, metric string, value double")).first()
    assert one["values"] == [FROZEN_AUC[s] for s in (42, 43, 44)]
    assert (round(one["mean"], 4), round(one["std"], 4)) == (0.9966, 0.001)


def test_sweep_equals_confusion_at_every_threshold(spark):
    preds = preds_of(spark, random_rows(1) + [(1, t) for t in ev.sweep_thresholds()])
    swept = {r.threshold: r for r in ev.sweep(preds).collect()}
    assert len(swept) == 19
    for cut in ev.sweep_thresholds()[::6]:
        one = ev.confusion(preds, cut).first()
        assert all(swept[round(cut, 2)][c] == one[c] for c in ev.COUNTS)


def test_a_score_on_the_threshold_is_positive_and_zero_division_is_zero(spark):
    preds = preds_of(spark, [(0, 0.5), (0, 0.4)])
    one = ev.scores(preds, 0.5).first()
    assert (one.tp, one.fp, one.tn, one.fn) == (0, 1, 1, 0)
    assert (one.precision, one.recall, one.f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("seed", [2, 3])
def test_areas_equal_brute_force_and_mirror(spark, seed):
    rows = random_rows(seed)
    preds = preds_of(spark, rows)
    area = ev.roc_auc(preds).first()[0]
    assert area == pytest.approx(brute_auc(rows), abs=1e-12)
    mirrored = preds.withColumn("p", 1 - F.col("p"))
    assert ev.roc_auc(mirrored).first()[0] == pytest.approx(1 - area, abs=1e-9)
    assert ev.roc_auc(preds.repartition(7)).first()[0] == pytest.approx(area, abs=1e-12)


def test_curves_of_tied_scores(spark):
    preds = preds_of(spark, [(1, 0.5), (0, 0.5), (1, 0.5)])
    assert ev.roc_auc(preds).first()[0] == 0.5
    assert {tuple(r) for r in ev.roc_curve(preds).collect()} == {(0.0, 0.0, None), (1.0, 1.0, 0.5)}
    assert {tuple(r) for r in ev.pr_curve(preds).collect()} == {(1.0, 2 / 3, 0.5), (0.0, 1.0, None)}


def test_roc_curve_leaves_out_straight_points_only(spark):
    rows = random_rows(4, digits=3)
    kept = ev.roc_curve(preds_of(spark, rows)).collect()
    points = sorted({(r.fpr, r.tpr) for r in kept})
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(brute_auc(rows), abs=1e-12)
    assert len(kept) < len({p for _, p in rows}) + 1


def test_consistency(spark):
    a = preds_of(spark, [(1, 0.5), (0, 0.25)])
    b = a.withColumn("p", F.col("p") + 0.125)
    assert not ev.consistency_check(a, b).first().within
    assert ev.consistency_check(a, a).first().within
    with pytest.raises(Exception, match="scorings differ"):
        ev.require_consistent(a, b).collect()


def test_patience(spark):
    values = [0.5, 0.7, 0.7, 0.6, 0.69, 0.65, 0.9]
    log = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "seed int, epoch int, val_auc double")
    assert tuple(runs.patience_stop(log, patience=3).first()) == (1, 5, 2, True)
    assert tuple(runs.patience_stop(log, patience=5).first()) == (1, None, 7, False)
    assert tuple(runs.best_epoch(log).first()) == (1, 7, 7)


def test_rows_without_a_score_are_not_evaluated(spark):
    rows = [(1, 0.9), (0, 0.1), (1, None), (0, float("nan"))]
    preds = spark.createDataFrame(rows, "y int, p double")
    areas = ev.curve_areas(preds).first()
    assert (areas.roc_auc, areas.average_precision) == (1.0, 1.0)
    assert max(r.recall for r in ev.pr_curve(preds).collect()) == 1.0
