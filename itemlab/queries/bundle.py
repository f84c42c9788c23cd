"""The report document: all results of the other sections under one roof, read back and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from itemlab.plans.staging import scratch_path
from itemlab.queries import Registry, audit, evaluation, evidence, runs
from itemlab.queries.evaluation import TUNED
from itemlab.queries.views import with_views
from itemlab.sources import reports
from itemlab.sources.logs import event_runs
from itemlab.sources.tables import document_preds, labelled_items

registry = Registry()
query = registry.query

#: The parts that are results of registered queries.
FROM_QUERIES = {
    "headline": (evaluation, "f16_headline"),
    "comparison": (runs, "g10_comparison"),
    "history": (runs, "g01_history_long"),
    "roc": (evaluation, "f08_roc_curve"),
    "roc_auc": (evaluation, "f09_roc_auc"),
    "pr": (evaluation, "f10_pr_curve"),
    "average_precision": (evaluation, "f11_average_precision"),
    "positive_share": (evaluation, "f13_positive_share"),
    "operating_point": (evaluation, "f15_operating_point"),
    "threshold_sweep": (evaluation, "f17_sweep_long"),
    "confusion": (evaluation, "f18_confusion_pair"),
    "export": (runs, "g12_export_table"),
    "attention": (evidence, "h04_attention_summary"),
    "deletion": (evidence, "h05_deletion_test"),
    "audit": (audit, "e13_compare_audits"),
}
DEPLOYED = ("g09_select_deployed", "g03_combine_phases")

OWN_SQL = {
    "meta": f"""SELECT 'poor' AS negative, 'good' AS positive, d.selected_variant, d.deployed_seed, {TUNED}::DOUBLE AS threshold,
      n_train, n_val, n_test FROM ({runs.registry.sql[DEPLOYED[0]]}) d,
      ({with_views("SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, "
                   "count(*) FILTER (split = 'test') AS n_test FROM labelled", "labelled")}) c""",
    "class_counts": with_views("SELECT split, cls, count(*) AS n FROM labelled GROUP BY ALL", "labelled"),
    "seed_note": with_views(
        "SELECT 'mean and sample deviation over ' || count(DISTINCT seed) || ' seeds' AS note FROM run_rows", "run_rows"),
    "seeds": with_views("SELECT DISTINCT seed FROM run_rows", "run_rows"),
    "finetune_start_epoch": f"SELECT DISTINCT seed, fine_tune_start FROM ({runs.registry.sql[DEPLOYED[1]]})",
    "probabilities": with_views("SELECT id, CASE WHEN y = 1 THEN 'good' ELSE 'poor' END AS true_class, p FROM preds", "preds"),
}


def _own_parts(spark, sf_dir):
    labelled = labelled_items(spark, sf_dir)
    counts = labelled.groupBy("split", "cls").agg(F.count("*").alias("n"))
    preds = document_preds(spark, sf_dir)
    positives = preds.agg(F.count_if(F.col("y") == 1)).scalar()
    order = reports.infer_class_order(counts.groupBy("cls").agg(F.sum("n").alias("n")), positives)
    deployed = runs.registry.functions[DEPLOYED[0]](spark, sf_dir).select(F.struct("*")).scalar()
    sizes = counts.agg(
        F.struct(*[F.sum(F.when(F.col("split") == s, F.col("n"))).alias(f"n_{s}") for s in ("train", "val", "test")])
    ).scalar()
    seeds = event_runs(spark, sf_dir).select("seed").distinct()
    meta = order.withColumns({"_d": deployed, "_n": sizes, "threshold": F.lit(TUNED)})
    return {
        "meta": meta.select("negative", "positive", "_d.selected_variant", "_d.deployed_seed", "threshold", "_n.*"),
        "class_counts": counts,
        "seed_note": seeds.agg(F.format_string("mean and sample deviation over %d seeds", F.count("*")).alias("note")),
        "seeds": seeds,
        "finetune_start_epoch": runs.registry.functions[DEPLOYED[1]](spark, sf_dir).select("seed", "fine_tune_start").distinct(),
        "probabilities": preds.select("id", F.when(F.col("y") == 1, "good").otherwise("poor").alias("true_class"), "p"),
    }


_SQL = OWN_SQL | {key: section.registry.sql[name] for key, (section, name) in FROM_QUERIES.items()}


@query("a09_report_document", " UNION ALL BY NAME ".join(f"SELECT '{key}' AS part, * FROM ({sql})" for key, sql in _SQL.items()))
def _(spark, sf_dir):
    parts = _own_parts(spark, sf_dir)
    parts |= {key: section.registry.functions[name](spark, sf_dir) for key, (section, name) in FROM_QUERIES.items()}
    path = scratch_path(spark, "report")
    read = reports.read_document(spark, path, reports.write_document(spark, parts, path))
    lines = [part.select(F.lit(key).alias("part"), "*") for key, part in read.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines)
