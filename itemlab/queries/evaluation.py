"""Section F and the scoring comparisons: evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.operators import evaluation as ev
from itemlab.queries import Registry
from itemlab.queries.views import counts, rates, with_views
from itemlab.sources.tables import document_preds, line_preds

registry = Registry()
query = registry.query

# The two scorers live on different scales, so each has its own operating threshold.
TUNED = 0.75
STRICT = 0.85
SWEEP_COLUMNS = ["threshold", *ev.COUNTS, *ev.RATES]


def _val(spark, sf_dir):
    return document_preds(spark, sf_dir).where("split = 'val'")


def _test(spark, sf_dir):
    return document_preds(spark, sf_dir).where("split = 'test'")


def _sweep_sql(where: str, source: str = "preds", p: str = "p") -> str:
    return f"""SELECT round(t, 2) AS threshold, tp, fp, tn, fn, {rates()}
      FROM (SELECT t, {counts('t', p)} FROM {source}, cuts WHERE {where} GROUP BY t)"""


@query(
    "b03_decide",
    with_views(
        f"SELECT id, p, CASE WHEN p >= {TUNED}::DOUBLE THEN 'pos' ELSE 'neg' END AS label FROM preds",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.decide(document_preds(spark, sf_dir), TUNED).select("id", "p", "label")


@query(
    "b04_false_negatives",
    with_views(
        f"SELECT id, round_even(p, 4) AS p FROM preds WHERE y = 1 AND p < {STRICT}::DOUBLE", "preds"
    ),
)
def _(spark, sf_dir):
    return ev.false_negatives(document_preds(spark, sf_dir), STRICT)


@query(
    "b05_misclassified",
    with_views(
        f"""SELECT id, y, p FROM preds WHERE (CASE WHEN p >= {TUNED}::DOUBLE THEN 1 ELSE 0 END) <> y
        ORDER BY id LIMIT 16""",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.misclassified(document_preds(spark, sf_dir), TUNED).select("id", "y", "p")


@query(
    "b06_worst_errors",
    with_views(
        f"""SELECT id, y, p, abs(p - {TUNED}::DOUBLE) AS gap FROM preds
        WHERE (CASE WHEN p >= {TUNED}::DOUBLE THEN 1 ELSE 0 END) <> y
        ORDER BY gap DESC, id LIMIT 10""",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.worst_errors(document_preds(spark, sf_dir), TUNED, 10).select("id", "y", "p", "gap")


@query(
    "f01_confusion",
    with_views(f"SELECT {counts(f'{TUNED}::DOUBLE')} FROM preds", "preds"),
)
def _(spark, sf_dir):
    return ev.confusion(document_preds(spark, sf_dir), TUNED)


@query(
    "f02_scores",
    with_views(
        f"""SELECT split, {TUNED}::DOUBLE AS threshold, tp, fp, tn, fn, {rates()}
        FROM (SELECT split, {counts(f'{TUNED}::DOUBLE')} FROM preds GROUP BY split)""",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.scores(document_preds(spark, sf_dir), TUNED, by=["split"])


@query("f03_sweep", with_views(_sweep_sql("split = 'val'"), "preds", "cuts"))
def _(spark, sf_dir):
    return ev.sweep(_val(spark, sf_dir))


@query("f03_sweep_lines", with_views(_sweep_sql("true", "line_preds"), "line_preds", "cuts"))
def _(spark, sf_dir):
    return ev.sweep(line_preds(spark, sf_dir))


_CHOOSE_SQL = """
  (SELECT *, true AS met_floor FROM swept WHERE precision >= {floor}::DOUBLE ORDER BY threshold LIMIT 1)
  UNION ALL
  (SELECT *, false AS met_floor FROM swept
   WHERE NOT EXISTS (SELECT 1 FROM swept WHERE precision >= {floor}::DOUBLE)
   ORDER BY precision DESC, threshold LIMIT 1)
"""


def _choose_sql(floor: float, where: str = "split = 'val'") -> str:
    return with_views(
        f"WITH swept AS ({_sweep_sql(where)}) {_CHOOSE_SQL.format(floor=floor)}", "preds", "cuts"
    )


@query("f04_choose_threshold", _choose_sql(0.95))
def _(spark, sf_dir):
    return ev.choose_threshold(ev.sweep(_val(spark, sf_dir)), 0.95)


@query("f04_choose_threshold_fallback", _choose_sql(1.01))
def _(spark, sf_dir):
    return ev.choose_threshold(ev.sweep(_val(spark, sf_dir)), 1.01)


@query(
    "f05_threshold_for_recall",
    with_views(
        f"""WITH swept AS ({_sweep_sql("split = 'val'")})
        SELECT * FROM swept WHERE recall >= 0.9::DOUBLE ORDER BY threshold DESC LIMIT 1""",
        "preds",
        "cuts",
    ),
)
def _(spark, sf_dir):
    return ev.threshold_for_recall(ev.sweep(_val(spark, sf_dir)), 0.9)


@query(
    "f06_select_then_apply",
    with_views(
        f"""WITH swept AS ({_sweep_sql("split = 'val'")}),
        chosen AS ({_CHOOSE_SQL.format(floor=0.85)}),
        wanted AS (
          SELECT 'tuned' AS role, threshold FROM chosen
          UNION ALL SELECT 'default', 5e-1::DOUBLE
          UNION ALL SELECT 'recall', max(threshold) FROM swept WHERE recall >= 0.95::DOUBLE)
        SELECT role, threshold, tp, fp, tn, fn, {rates()}
        FROM (SELECT role, threshold, {counts('threshold')}
              FROM preds, wanted WHERE split = 'test' AND threshold IS NOT NULL
              GROUP BY role, threshold)""",
        "preds",
        "cuts",
    ),
)
def _(spark, sf_dir):
    return ev.select_then_apply(_val(spark, sf_dir), _test(spark, sf_dir))


@query(
    "f07_classification_report",
    with_views(
        f"""WITH c AS (SELECT {counts(f'{TUNED}::DOUBLE')} FROM preds),
        per AS (
          SELECT '0' AS row, coalesce(tn / nullif(tn + fn, 0), 0) AS p,
                 coalesce(tn / nullif(tn + fp, 0), 0) AS r, tn + fp AS support FROM c
          UNION ALL
          SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0),
                 coalesce(tp / nullif(tp + fn, 0), 0), tp + fn FROM c),
        f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM per)
        SELECT row, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support FROM f
        UNION ALL
        SELECT 'accuracy', round((tp + tn) / (tp + fp + tn + fn), 9), round((tp + tn) / (tp + fp + tn + fn), 9),
               round((tp + tn) / (tp + fp + tn + fn), 9), tp + fp + tn + fn FROM c
        UNION ALL
        SELECT 'macro', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL
        SELECT 'weighted', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9),
               round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f""",
        "preds",
    ),
)
def _(spark, sf_dir):
    report = ev.classification_report(document_preds(spark, sf_dir), TUNED)
    return report.select(
        "row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def _cumulative_sql(source: str, p: str = "p") -> str:
    """One row per distinct score with the running counts, by one window over all scores."""
    return f"""
      pts AS (SELECT {p} AS p, count(*) FILTER (y = 1) AS tp, count(*) FILTER (y <> 1) AS fp
              FROM {source} GROUP BY 1),
      run AS (SELECT p, tp, fp,
                sum(tp) OVER (ORDER BY p DESC) AS tps, sum(fp) OVER (ORDER BY p DESC) AS fps,
                sum(tp) OVER () AS pos, sum(fp) OVER () AS neg,
                lead(tp) OVER (ORDER BY p DESC) AS ntp, lead(fp) OVER (ORDER BY p DESC) AS nfp,
                row_number() OVER (ORDER BY p DESC) AS k
              FROM pts)"""


def _roc_sql(source: str) -> str:
    return with_views(
        f"""WITH {_cumulative_sql(source)}
        SELECT 0::DOUBLE AS fpr, 0::DOUBLE AS tpr, NULL::DOUBLE AS threshold
        UNION ALL
        SELECT (fps / neg)::DOUBLE, (tps / pos)::DOUBLE, p FROM run
        WHERE k = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp""",
        source,
    )


def _pr_sql(source: str) -> str:
    return with_views(
        f"""WITH {_cumulative_sql(source)}
        SELECT 0::DOUBLE AS recall, 1::DOUBLE AS precision, NULL::DOUBLE AS threshold
        UNION ALL
        SELECT (tps / pos)::DOUBLE, (tps / (tps + fps))::DOUBLE, p FROM run""",
        source,
    )


def _auc_sql(source: str) -> str:
    return with_views(
        f"""WITH {_cumulative_sql(source)}
        SELECT round(sum(fp::DOUBLE * (2.0::DOUBLE * tps - tp) / 2) / (max(pos)::DOUBLE * max(neg)), 9) AS roc_auc
        FROM run""",
        source,
    )


def _ap_sql(source: str) -> str:
    return with_views(
        f"""WITH {_cumulative_sql(source)}
        SELECT round(sum(tp * (tps / (tps + fps)))::DOUBLE / max(pos), 9) AS average_precision FROM run""",
        source,
    )


@query("f08_roc_curve", _roc_sql("preds"))
def _(spark, sf_dir):
    return ev.roc_curve(document_preds(spark, sf_dir))


@query("f08_roc_curve_lines", _roc_sql("line_preds"))
def _(spark, sf_dir):
    return ev.roc_curve(line_preds(spark, sf_dir))


@query("f09_roc_auc", _auc_sql("preds"))
def _(spark, sf_dir):
    return ev.roc_auc(document_preds(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("f09_roc_auc_lines", _auc_sql("line_preds"))
def _(spark, sf_dir):
    return ev.roc_auc(line_preds(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query("f10_pr_curve", _pr_sql("preds"))
def _(spark, sf_dir):
    return ev.pr_curve(document_preds(spark, sf_dir))


@query("f10_pr_curve_lines", _pr_sql("line_preds"))
def _(spark, sf_dir):
    return ev.pr_curve(line_preds(spark, sf_dir))


@query("f11_average_precision", _ap_sql("preds"))
def _(spark, sf_dir):
    found = ev.average_precision(document_preds(spark, sf_dir))
    return found.select(F.round("average_precision", 9).alias("average_precision"))


@query("f11_average_precision_lines", _ap_sql("line_preds"))
def _(spark, sf_dir):
    found = ev.average_precision(line_preds(spark, sf_dir))
    return found.select(F.round("average_precision", 9).alias("average_precision"))


@query(
    "f12_auc_grid",
    with_views(
        """WITH grid AS (
          SELECT CASE i WHEN 0 THEN -1e-7::DOUBLE WHEN 199 THEN (1 + 1e-7)::DOUBLE ELSE i / 199::DOUBLE END AS t
          FROM range(200) r(i)),
        hits AS (SELECT t, count(*) FILTER (y = 1 AND p > t) AS tp, count(*) FILTER (y <> 1 AND p > t) AS fp
               FROM line_preds, grid GROUP BY t),
        seg AS (SELECT tp, fp, lag(tp) OVER (ORDER BY t DESC) AS tp0, lag(fp) OVER (ORDER BY t DESC) AS fp0 FROM hits)
        SELECT round(sum((fp - fp0)::DOUBLE * (tp + tp0) / 2) / (max(tp)::DOUBLE * max(fp)), 9) AS auc FROM seg""",
        "line_preds",
    ),
)
def _(spark, sf_dir):
    return ev.auc_grid(line_preds(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(
    "f13_positive_share",
    with_views("SELECT count(*) FILTER (y = 1) / count(*) AS positive_share FROM preds", "preds"),
)
def _(spark, sf_dir):
    return ev.positive_share(document_preds(spark, sf_dir))


@query(
    "f14_probability_histogram",
    with_views(
        """SELECT CAST(i AS INTEGER) AS bin, i / 20::DOUBLE AS low,
          count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1) AS pos
        FROM range(20) r(i) LEFT JOIN preds ON least(19, floor(p * 20)) = i
        GROUP BY i""",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.probability_histogram(document_preds(spark, sf_dir))


@query(
    "f15_operating_point",
    with_views(
        f"""WITH swept AS ({_sweep_sql("split = 'test'")})
        SELECT threshold, recall, precision, 1.0::DOUBLE - specificity AS fpr FROM swept""",
        "preds",
        "cuts",
    ),
)
def _(spark, sf_dir):
    return ev.operating_point(ev.sweep(_test(spark, sf_dir)))


@query(
    "f16_headline",
    with_views(
        f"""WITH {_cumulative_sql('preds')},
        c AS (SELECT tp, fp, tn, fn, {rates()} FROM (SELECT {counts(f'{TUNED}::DOUBLE')} FROM preds))
        SELECT recall, precision, f1, accuracy,
          (SELECT round(sum(fp::DOUBLE * (2.0::DOUBLE * tps - tp) / 2) / (max(pos)::DOUBLE * max(neg)), 9) FROM run) AS roc_auc,
          (SELECT round(sum(tp * (tps / (tps + fps)))::DOUBLE / max(pos), 9) FROM run) AS average_precision,
          fn AS false_negatives, tp + fn AS positives, fp + fn AS misclassified
        FROM c""",
        "preds",
    ),
)
def _(spark, sf_dir):
    line = ev.headline(document_preds(spark, sf_dir), TUNED)
    return line.withColumns(
        {c: F.round(c, 9) for c in ("roc_auc", "average_precision")}
    )


@query(
    "f17_sweep_long",
    with_views(
        f"""WITH v AS ({_sweep_sql("split = 'val'")}), t AS ({_sweep_sql("split = 'test'")})
        SELECT 'validation' AS split, threshold, precision, recall, f1 FROM v
        UNION ALL SELECT 'test', threshold, precision, recall, f1 FROM t""",
        "preds",
        "cuts",
    ),
)
def _(spark, sf_dir):
    return ev.sweep_long(ev.sweep(_val(spark, sf_dir)), ev.sweep(_test(spark, sf_dir)))


@query(
    "f18_confusion_pair",
    with_views(
        f"""WITH m AS (
          SELECT 'default' AS matrix, 5e-1::DOUBLE AS threshold, {counts('5e-1::DOUBLE')} FROM preds
          UNION ALL SELECT 'tuned', {TUNED}::DOUBLE, {counts(f'{TUNED}::DOUBLE')} FROM preds),
        cells AS (
          SELECT matrix, threshold, 0 AS actual, 0 AS predicted, tn AS n FROM m
          UNION ALL SELECT matrix, threshold, 0, 1, fp FROM m
          UNION ALL SELECT matrix, threshold, 1, 0, fn FROM m
          UNION ALL SELECT matrix, threshold, 1, 1, tp FROM m)
        SELECT matrix, threshold, actual, predicted, n,
          (n / sum(n) OVER (PARTITION BY matrix))::DOUBLE AS share,
          CAST(least(4, floor(n / max(n) OVER (PARTITION BY matrix) * 4.999::DOUBLE)) AS INTEGER) AS shade
        FROM cells""",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.confusion_pair(document_preds(spark, sf_dir), TUNED)


def _two_models(spark, sf_dir):
    preds = document_preds(spark, sf_dir)
    return preds.select("id", "y", "p"), preds.select("id", F.col("p2").alias("p"))


@query(
    "c10_model_agreement",
    with_views(
        f"""WITH c AS (SELECT count(*) AS n, max(abs(p - p2)) AS max_abs_diff,
          count(*) FILTER ((p >= 5e-1::DOUBLE) = (p2 >= 5e-1::DOUBLE)) AS sd,
          count(*) FILTER ((p >= {TUNED}::DOUBLE) = (p2 >= {TUNED}::DOUBLE)) AS st,
          count(*) FILTER (y = 1 AND p2 >= {TUNED}::DOUBLE) AS tp,
          count(*) FILTER (y <> 1 AND p2 >= {TUNED}::DOUBLE) AS fp,
          count(*) FILTER (y = 1 AND p2 < {TUNED}::DOUBLE) AS fn FROM preds)
        SELECT n, max_abs_diff, sd / n * 100 AS agree_default_pct, st / n * 100 AS agree_tuned_pct,
          n - st AS changed, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
          coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c""",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.model_agreement(*_two_models(spark, sf_dir), TUNED)


@query(
    "c11_nearest_threshold",
    with_views(
        f"""WITH swept AS ({_sweep_sql("split = 'val'")})
        SELECT * FROM swept ORDER BY abs(threshold - 0.63::DOUBLE), threshold LIMIT 1""",
        "preds",
        "cuts",
    ),
)
def _(spark, sf_dir):
    return ev.nearest_threshold(ev.sweep(_val(spark, sf_dir)), 0.63)


@query(
    "h07_consistency_check",
    with_views(
        "SELECT count(*) AS n, max(abs(p - p2)) AS max_gap, max(abs(p - p2)) <= 1e-3::DOUBLE AS within FROM preds",
        "preds",
    ),
)
def _(spark, sf_dir):
    return ev.consistency_check(*_two_models(spark, sf_dir))
