"""Exact evaluation of binary scores: counts, sweeps, threshold choice, curves and areas.

Inputs are prediction tables with a 0/1 label `y` and a score `p`. Everything at a threshold is
derived from one pass that counts rows per (score bin, label); the curves work on one row per
distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemlab.config import DEFAULTS, Defaults
from itemlab.functions.scalars import ratio
from itemlab.plans.staging import stage

COUNTS = ("tp", "fp", "tn", "fn")
RATES = ("precision", "recall", "f1", "specificity", "accuracy", "balanced_accuracy")


def sweep_thresholds(cfg: Defaults = DEFAULTS) -> list[float]:
    """start + i * step in unrounded doubles, the stop included."""
    n = int((cfg.sweep_stop + 1e-9 - cfg.sweep_start) / cfg.sweep_step) + 1
    return [cfg.sweep_start + i * cfg.sweep_step for i in range(n)]


def is_positive(p: Column, threshold: Column | float) -> Column:
    """The decision rule: a score on the threshold is positive."""
    return p >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))


def decide(
    preds: DataFrame, threshold: Column | float, positive: str = "pos", negative: str = "neg"
) -> DataFrame:
    """Add the predicted class name as `label`; NULL where the score is missing."""
    return preds.withColumn(
        "label",
        F.when(is_positive(F.col("p"), threshold), positive).when(F.col("p").isNotNull(), negative),
    )


def _count_columns(threshold: Column | float) -> list[Column]:
    said = is_positive(F.col("p"), threshold)
    truth = F.col("y") == 1
    return [
        F.count_if(~truth & ~said).alias("tn"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"),
        F.count_if(truth & said).alias("tp"),
    ]


def confusion(preds: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp at one threshold: one row, or one per `by` group."""
    return preds.groupBy(*by).agg(*_count_columns(threshold))


def with_rates(counts: DataFrame) -> DataFrame:
    """Add the six rates to a table with tp, fp, tn and fn; every 0/0 is 0.0."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn(
            "f1",
            ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
        .withColumn("specificity", ratio(tn, tn + fp))
        .withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))
        .withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
    )


def scores(preds: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at one threshold; the threshold is stored with two digits."""
    rated = with_rates(confusion(preds, threshold, by))
    return rated.select(
        *by, F.lit(round(float(threshold), 2)).alias("threshold"), *COUNTS, *RATES
    )


def sweep(
    preds: DataFrame,
    thresholds: Sequence[float] | None = None,
    by: Sequence[str] = (),
    p: str = "p",
) -> DataFrame:
    """Counts and rates at every threshold, from one pass over the predictions.

    A row's bin is the number of thresholds its score reaches; at the i-th threshold (from 0) a
    bin above i is positive. What is left after the pass is at most 2 * (thresholds + 1) rows
    per group.
    """
    cuts = sorted(sweep_thresholds() if thresholds is None else thresholds)
    reached = F.lit(0)
    for cut in cuts:
        reached = reached + (F.col(p) >= F.lit(float(cut))).cast("int")
    bins = preds.groupBy(*by, "y", reached.alias("_bin")).agg(F.count("*").alias("_n"))
    grid = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("t")) for i, c in enumerate(cuts)]
    )
    cells = bins.withColumn("_cut", F.explode(grid))
    said, truth = F.col("_bin") > F.col("_cut.i"), F.col("y") == 1

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    counted = cells.groupBy(*by, F.col("_cut.t").alias("_t")).agg(
        total(truth & said).alias("tp"),
        total(~truth & said).alias("fp"),
        total(~truth & ~said).alias("tn"),
        total(truth & ~said).alias("fn"),
    )
    return with_rates(counted).select(
        *by, F.round("_t", 2).alias("threshold"), *COUNTS, *RATES
    )


def choose_threshold(
    swept: DataFrame, floor: float = DEFAULTS.precision_floor, by: Sequence[str] = ()
) -> DataFrame:
    """The lowest threshold whose precision reaches the floor.

    Where none does: the highest precision, then the lowest threshold. `met_floor` says which.
    """
    met = F.col("precision") >= floor
    preference = F.struct(
        met.cast("int"), F.when(met, 0.0).otherwise(F.col("precision")), -F.col("threshold")
    )
    row = F.struct(
        *[c for c in swept.columns if c not in by], met.alias("met_floor")
    )
    return swept.groupBy(*by).agg(F.max_by(row, preference).alias("_r")).select(*by, "_r.*")


def threshold_for_recall(
    swept: DataFrame, target: float = DEFAULTS.target_recall, by: Sequence[str] = ()
) -> DataFrame:
    """The highest threshold whose recall reaches the target; all NULL where none does."""
    row = F.struct(*[c for c in swept.columns if c not in by])
    reaches = F.when(F.col("recall") >= target, F.col("threshold"))
    best = F.max_by(F.when(F.col("recall") >= target, row), reaches)
    return swept.groupBy(*by).agg(best.alias("_r")).select(*by, "_r.*")


def select_then_apply(
    val: DataFrame,
    test: DataFrame,
    cfg: Defaults = DEFAULTS,
) -> DataFrame:
    """Choose on validation, score the test rows there: roles tuned, default and recall.

    The stored thresholds have two digits, so the test rows are swept once over the rounded
    thresholds plus the default, and the wanted rows are picked by equality.
    """
    val_sweep = sweep(val, sweep_thresholds(cfg))
    rounded = sorted({round(t, 2) for t in sweep_thresholds(cfg)} | {cfg.default_threshold})
    test_sweep = sweep(test, rounded)
    tuned = choose_threshold(val_sweep, cfg.precision_floor).select(
        F.lit("tuned").alias("role"), "threshold"
    )
    recall = threshold_for_recall(val_sweep, cfg.target_recall).select(
        F.lit("recall").alias("role"), "threshold"
    )
    default = tuned.select(
        F.lit("default").alias("role"), F.lit(cfg.default_threshold).alias("threshold")
    )
    wanted = tuned.unionByName(recall).unionByName(default)
    # A role whose threshold no value reaches stays, with NULLs.
    return wanted.join(test_sweep, "threshold", "left").select("role", *test_sweep.columns)


def classification_report(preds: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, f1 and support per class, with the accuracy, macro and weighted rows."""
    base = confusion(preds, threshold)

    def side(name: str, hit: str, false_alarm: str, missed: str) -> Column:
        """One class: its hits, rows wrongly given to it, and its rows given away."""
        h, f, m = F.col(hit), F.col(false_alarm), F.col(missed)
        precision, recall = ratio(h, h + f), ratio(h, h + m)
        return F.struct(
            F.lit(name).alias("row"),
            precision.alias("precision"),
            recall.alias("recall"),
            ratio(2 * precision * recall, precision + recall).alias("f1"),
            (h + m).alias("support"),
        )

    classes = base.select(
        F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"),
        side("0", "tn", "fn", "fp").alias("n"),
        side("1", "tp", "fp", "fn").alias("q"),
    )
    rows = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    accuracy = ratio(F.col("tp") + F.col("tn"), rows)

    def mean(field: str) -> Column:
        return (F.col(f"n.{field}") + F.col(f"q.{field}")) / 2

    def weighted(field: str) -> Column:
        top = F.col(f"n.{field}") * F.col("n.support") + F.col(f"q.{field}") * F.col("q.support")
        return ratio(top, rows)

    def summary(name: str, pick) -> Column:
        return F.struct(
            F.lit(name).alias("row"),
            *[pick(f).alias(f) for f in ("precision", "recall", "f1")],
            rows.alias("support"),
        )

    lines = F.array(
        F.col("n"),
        F.col("q"),
        summary("accuracy", lambda _: accuracy),
        summary("macro", mean),
        summary("weighted", weighted),
    )
    return classes.select(F.inline(lines))


def false_negatives(preds: DataFrame, threshold: float) -> DataFrame:
    """Positive rows the threshold misses, with the score at four digits."""
    missed = (F.col("y") == 1) & ~is_positive(F.col("p"), threshold)
    return preds.where(missed).select("id", F.bround("p", 4).alias("p"))


def wrong(preds: DataFrame, threshold: float) -> DataFrame:
    return preds.where(is_positive(F.col("p"), threshold).cast("int") != F.col("y"))


def misclassified(preds: DataFrame, threshold: float, first: int = 16) -> DataFrame:
    """The first wrongly classified rows in id order."""
    return wrong(preds, threshold).orderBy("id").limit(first)


def worst_errors(preds: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k wrong rows furthest from the threshold."""
    gap = F.abs(F.col("p") - threshold)
    return wrong(preds, threshold).withColumn("gap", gap).orderBy(F.desc("gap"), "id").limit(k)


# --- curves ---------------------------------------------------------------------------------


def score_counts(preds: DataFrame, p: str = "p") -> DataFrame:
    """Positives and negatives at every distinct score."""
    return preds.groupBy(F.col(p).alias("p")).agg(
        F.count_if(F.col("y") == 1).alias("tp"), F.count_if(F.col("y") != 1).alias("fp")
    )


def _score_bounds(counts: DataFrame) -> list[float]:
    """Cut points that spread the scores evenly, fetched once so that every task cuts alike.

    The list is bounded by the number of shuffle partitions, not by the data. Any cut points
    give the same result; these only balance the work.
    """
    spark = counts.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = counts.approxQuantile("p", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return [-float("inf"), *sorted(set(found)), float("inf")]


def cumulative_counts(preds: DataFrame, p: str = "p") -> DataFrame:
    """One row per distinct score with the counts at or above it, and the totals.

    Columns: p, tp, fp (at this score), tps, fps (at this score or higher), pos, neg (all
    rows), next_tp, next_fp (at the next lower score; NULL on the lowest), first (the highest
    score). The running sums are taken inside score ranges and shifted by the range totals, so
    no task sorts more than one range. Rows without a score (NULL or NaN) are not evaluated, as
    in the confusion counts. The counts are staged, so the rows themselves are read once.
    """
    counts = stage(score_counts(preds.where(F.col(p).isNotNull() & ~F.isnan(p)), p), "scores")
    bounds = _score_bounds(counts)
    ranged = Bucketizer(splits=bounds, inputCol="p", outputCol="_range").transform(counts)

    whole = Window.partitionBy(F.lit(0))
    high_first = whole.orderBy(F.desc("_range"))
    above = high_first.rowsBetween(Window.unboundedPreceding, -1)
    # One row per score range: at most as many as there are cut points.
    totals = ranged.groupBy("_range").agg(
        F.sum("tp").alias("_tp"),
        F.sum("fp").alias("_fp"),
        F.max_by(F.struct("tp", "fp"), "p").alias("_top"),
    ).select(
        "_range",
        F.coalesce(F.sum("_tp").over(above), F.lit(0)).alias("_tps_above"),
        F.coalesce(F.sum("_fp").over(above), F.lit(0)).alias("_fps_above"),
        F.sum("_tp").over(whole).alias("pos"),
        F.sum("_fp").over(whole).alias("neg"),
        F.lead("_top").over(high_first).alias("_next_top"),
        (F.row_number().over(high_first) == 1).alias("_first_range"),
    )
    inside = Window.partitionBy("_range").orderBy(F.desc("p"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead(F.struct("tp", "fp")).over(inside), F.col("_next_top"))
    return (
        ranged.join(F.broadcast(totals), "_range")
        .withColumn("tps", F.col("_tps_above") + F.sum("tp").over(so_far))
        .withColumn("fps", F.col("_fps_above") + F.sum("fp").over(so_far))
        .withColumn("_next", following)
        .withColumn("first", F.col("_first_range") & (F.row_number().over(inside) == 1))
        .select(
            "p", "tp", "fp", "tps", "fps", "pos", "neg",
            F.col("_next.tp").alias("next_tp"), F.col("_next.fp").alias("next_fp"), "first",
        )
    )


def roc_curve(preds: DataFrame, p: str = "p") -> DataFrame:
    """(fpr, tpr, threshold): corner points of the ROC curve, from (0, 0, NULL) on.

    A point on a straight piece between its neighbours is left out.
    """
    points = cumulative_counts(preds, p)
    last = F.col("next_tp").isNull()
    bends = (F.col("tp") != F.col("next_tp")) | (F.col("fp") != F.col("next_fp"))
    kept = points.where(F.col("first") | last | bends).select(
        ratio(F.col("fps"), F.col("neg")).alias("fpr"),
        ratio(F.col("tps"), F.col("pos")).alias("tpr"),
        F.col("p").alias("threshold"),
        F.col("first"),
    )
    # The start of the curve rides along with the first point instead of needing another scan.
    start = F.struct(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    point = F.struct("fpr", "tpr", "threshold")
    return kept.select(
        F.inline(F.when(F.col("first"), F.array(start, point)).otherwise(F.array(point)))
    )


def pr_curve(preds: DataFrame, p: str = "p") -> DataFrame:
    """(recall, precision, threshold) at every distinct score, and the end point (0, 1, NULL)."""
    points = cumulative_counts(preds, p).select(
        ratio(F.col("tps"), F.col("pos")).alias("recall"),
        ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        F.col("p").alias("threshold"),
        F.col("first"),
    )
    end = F.struct(
        F.lit(0.0).alias("recall"),
        F.lit(1.0).alias("precision"),
        F.lit(None).cast("double").alias("threshold"),
    )
    point = F.struct("recall", "precision", "threshold")
    return points.select(
        F.inline(F.when(F.col("first"), F.array(point, end)).otherwise(F.array(point)))
    )


def curve_areas(preds: DataFrame, p: str = "p") -> DataFrame:
    """roc_auc and average_precision as one row, both exact.

    The ROC area sums trapezoids over the distinct scores, so ties count one half. The average
    precision sums (gain in recall) * precision without interpolation.
    """
    area = F.col("fp").cast("double") * (2.0 * F.col("tps") - F.col("tp")) / 2.0
    step = F.col("tp") * ratio(F.col("tps"), F.col("tps") + F.col("fps"))
    return cumulative_counts(preds, p).agg(
        ratio(F.sum(area), F.max("pos").cast("double") * F.max("neg")).alias("roc_auc"),
        ratio(F.sum(step), F.max("pos")).alias("average_precision"),
    )


def roc_auc(preds: DataFrame, p: str = "p") -> DataFrame:
    return curve_areas(preds, p).select("roc_auc")


def average_precision(preds: DataFrame, p: str = "p") -> DataFrame:
    return curve_areas(preds, p).select("average_precision")


def auc_grid(preds: DataFrame, n: int = 200, p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """The area on a fixed grid of n thresholds: one pass, mergeable, approximate; one row, or one per `by` group.

    The inner thresholds are i / (n - 1), the outer two lie just outside 0..1, and a score must
    exceed a threshold to count. All scores between two thresholds act as one tie.
    """
    above = F.greatest(F.lit(0), F.ceil(F.col(p) * (n - 1)) - 1).cast("int")
    cell = F.least(above, F.lit(n - 2))
    cells = preds.groupBy(*by, cell.alias("cell")).agg(
        F.count_if(F.col("y") == 1).alias("tp"), F.count_if(F.col("y") != 1).alias("fp")
    )
    # At most n - 1 rows a group: the running sums may sit in one task.
    high_first = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("cell"))
    tps = F.sum("tp").over(high_first)
    area = F.col("fp") * (2.0 * F.col("tps") - F.col("tp")) / 2.0
    return cells.withColumn("tps", tps).groupBy(*by).agg(
        ratio(F.sum(area), F.sum("tp").cast("double") * F.sum("fp")).alias("auc")
    )


def positive_share(preds: DataFrame) -> DataFrame:
    return preds.agg(ratio(F.count_if(F.col("y") == 1), F.count("*")).alias("positive_share"))


def probability_histogram(preds: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per score bin and class, empty bins included: (bin, low, neg, pos)."""
    index = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    counted = preds.groupBy(index.alias("bin")).agg(
        F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos")
    )
    spine = preds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counted, "bin", "left").select(
        "bin",
        (F.col("bin") / bins).alias("low"),
        F.coalesce("neg", F.lit(0)).alias("neg"),
        F.coalesce("pos", F.lit(0)).alias("pos"),
    )


def operating_point(swept: DataFrame) -> DataFrame:
    """Where a scored threshold lies on the two curves."""
    return swept.select("threshold", "recall", "precision", (1.0 - F.col("specificity")).alias("fpr"))


def headline(preds: DataFrame, threshold: float) -> DataFrame:
    """The key figures at the deployed threshold as one row."""
    areas = curve_areas(preds).select(F.struct("roc_auc", "average_precision")).scalar()
    at = scores(preds, threshold).withColumn("_areas", areas)
    return at.select(
        "recall",
        "precision",
        "f1",
        "accuracy",
        "_areas.roc_auc",
        "_areas.average_precision",
        F.col("fn").alias("false_negatives"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("fp") + F.col("fn")).alias("misclassified"),
    )


def sweep_long(val_sweep: DataFrame, test_sweep: DataFrame) -> DataFrame:
    """Both sweeps in one table, tagged by split."""
    columns = ("threshold", "precision", "recall", "f1")
    return val_sweep.select(F.lit("validation").alias("split"), *columns).unionByName(
        test_sweep.select(F.lit("test").alias("split"), *columns)
    )


def confusion_pair(
    preds: DataFrame, tuned: float, default: float = DEFAULTS.default_threshold
) -> DataFrame:
    """The confusion matrices at the default and the tuned threshold, cell by cell.

    `share` is the cell's part of all rows, `shade` its step 0..4 against the largest cell.
    """
    both = sweep(preds, sorted({default, tuned}))
    largest = F.greatest("tn", "fp", "fn", "tp")
    rows = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")

    def cell(actual: int, predicted: int, name: str) -> Column:
        value = F.col(name)
        step = F.floor(value / largest * 4.999).cast("int")
        return F.struct(
            F.lit(actual).alias("actual"),
            F.lit(predicted).alias("predicted"),
            value.alias("n"),
            ratio(value, rows).alias("share"),
            F.when(largest == 0, 0).otherwise(F.least(F.lit(4), step)).alias("shade"),
        )

    cells = F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    matrices = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(round(t, 2)).alias("at"))
            for name, t in (("default", default), ("tuned", tuned))
        ]
    )
    named = both.withColumn("_m", F.explode(matrices)).where(F.col("_m.at") == F.col("threshold"))
    return named.select(F.col("_m.name").alias("matrix"), "threshold", F.inline(cells))


# --- comparing scorings ---------------------------------------------------------------------


def model_agreement(
    reference: DataFrame,
    other: DataFrame,
    threshold: float,
    default: float = DEFAULTS.default_threshold,
) -> DataFrame:
    """How far a second scoring of the same rows moves scores and decisions.

    Both tables hold one row per id; `reference` also holds y.
    """
    pairs = reference.select("id", "y", F.col("p").alias("_p")).join(
        other.select("id", F.col("p").alias("_q")), "id"
    )
    p, q, truth = F.col("_p"), F.col("_q"), F.col("y") == 1
    same_default = is_positive(p, default) == is_positive(q, default)
    same_tuned = is_positive(p, threshold) == is_positive(q, threshold)
    said = is_positive(q, threshold)
    counted = pairs.agg(
        F.count("*").alias("n"),
        F.max(F.abs(p - q)).alias("max_abs_diff"),
        F.count_if(same_default).alias("_same_default"),
        F.count_if(same_tuned).alias("_same_tuned"),
        F.count_if(truth & said).alias("tp"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"),
    )
    return counted.select(
        "n",
        "max_abs_diff",
        (ratio(F.col("_same_default"), F.col("n")) * 100).alias("agree_default_pct"),
        (ratio(F.col("_same_tuned"), F.col("n")) * 100).alias("agree_tuned_pct"),
        (F.col("n") - F.col("_same_tuned")).alias("changed"),
        "tp",
        "fp",
        "fn",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def nearest_threshold(swept: DataFrame, value: float) -> DataFrame:
    """The swept row nearest to a value; the lower threshold on a tie."""
    order = F.struct(F.abs(F.col("threshold") - value), F.col("threshold"))
    return swept.agg(F.min_by(F.struct(*swept.columns), order).alias("_r")).select("_r.*")


def consistency_check(
    reference: DataFrame, other: DataFrame, tolerance: float = DEFAULTS.agree_tolerance
) -> DataFrame:
    """The largest gap between two scorings of the same rows, and whether it is tolerable."""
    gap = reference.select("id", F.col("p").alias("_p")).join(
        other.select("id", F.col("p").alias("_q")), "id"
    ).agg(F.max(F.abs(F.col("_p") - F.col("_q"))).alias("max_gap"), F.count("*").alias("n"))
    return gap.select("n", "max_gap", (F.col("max_gap") <= tolerance).alias("within"))


def require_consistent(
    reference: DataFrame, other: DataFrame, tolerance: float = DEFAULTS.agree_tolerance
) -> DataFrame:
    """As `consistency_check`, but running the result fails when the gap is too large."""
    checked = consistency_check(reference, other, tolerance)
    failure = F.concat(
        F.lit("scorings differ by "), F.col("max_gap").cast("string"), F.lit(f" (> {tolerance})")
    )
    return checked.withColumn("within", F.when(F.col("within"), True).otherwise(F.raise_error(failure).cast("boolean")))
