"""Section A: scans, item records, report files."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.operators import evaluation as ev
from itemlab.plans.staging import scratch_path
from itemlab.queries import Registry
from itemlab.queries.evaluation import _sweep_sql
from itemlab.queries.views import counts, with_views
from itemlab.sources import reports
from itemlab.sources.files import read_item_metadata, scan_items, scan_source
from itemlab.sources.tables import document_items, document_preds, labelled_items, table

registry = Registry()
query = registry.query

TEXT_FILES = (".txt",)
PATHS_OF_A_DIGIT = 4096


def _as_files(items, *folders):
    """The items' paths as text files, one folder level per column.

    A folder's paths are dealt by their digest over more files the more items there are, so that
    no file grows with the table; a file has its paths in order.
    """
    path = scratch_path(items.sparkSession, "files")
    digits = len(f"{items.count() // PATHS_OF_A_DIGIT:x}")
    part = F.substring(F.md5("path"), 1, digits).alias("part")
    lines = items.select(F.col("path").alias("value"), *folders, part)
    names = [c for c in lines.columns if c != "value"]
    ordered = lines.repartition(*names).sortWithinPartitions(*names, "value")
    ordered.write.partitionBy(*names).text(path)
    return path


def _part(source):
    return f"substr(md5(path), 1, (SELECT length(to_hex(count(*) // {PATHS_OF_A_DIGIT})) FROM {source}))"


def _file_sql(source):
    return f"count(DISTINCT {_part(source)}) AS files, sum(strlen(path) + 1)::BIGINT AS bytes"


@query(
    "a01_scan_items",
    with_views(f"SELECT split, cls, {_file_sql('items')}, true AS txt FROM items GROUP BY split, cls", "items"),
)
def _(spark, sf_dir):
    root = _as_files(document_items(spark, sf_dir), "split", "cls")
    found = scan_items(spark, root, TEXT_FILES)
    return found.groupBy("split", "cls").agg(
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        F.bool_and(F.col("name").endswith(".txt")).alias("txt"),
    )


@query(
    "a02_scan_source",
    with_views(f"SELECT 'all' AS split, cls, {_file_sql('labelled')} FROM labelled GROUP BY cls", "labelled"),
)
def _(spark, sf_dir):
    folder = F.when(F.col("cls") == "good", "usable").otherwise("junk").alias("folder")
    root = _as_files(labelled_items(spark, sf_dir).select("path", folder), "folder")
    folders = {"good": "usable", "poor": "junk"}
    found = scan_source(spark, root, folders, TEXT_FILES)
    return found.groupBy("split", "cls").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(
    "a03_read_item_metadata",
    with_views(
        f"""SELECT split, cls, 'CORRUPT' AS mode, 0 AS w, 0 AS h, true AS loadable, NULL::VARCHAR AS format,
          'the first bytes are those of no known format' AS error,
          md5(string_agg(path, chr(10) ORDER BY path) || chr(10)) AS md5
        FROM items GROUP BY split, cls, {_part('items')}""",
        "items",
    ),
)
def _(spark, sf_dir):
    root = _as_files(document_items(spark, sf_dir), "split", "cls")
    found = read_item_metadata(spark, scan_items(spark, root, TEXT_FILES), root, TEXT_FILES)
    return found.select("split", "cls", "mode", "w", "h", "loadable", "format", "error", "md5")


@query("a04_items_from_table", with_views("SELECT * FROM items", "items"))
def _(spark, sf_dir):
    return document_items(spark, sf_dir)


@query("a05_read_report_csv", with_views(_sweep_sql("true"), "preds", "cuts"))
def _(spark, sf_dir):
    path = scratch_path(spark, "sweep")
    reports.write_sweep(ev.sweep(document_preds(spark, sf_dir)), path)
    return reports.read_report_csv(spark, path, reports.SWEEP_SCHEMA)


@query(
    "a06_write_manifest",
    with_views("SELECT id, path, md5, split, cls AS class FROM items", "items"),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    items = document_items(spark, sf_dir)
    reports.write_manifest(items.select("id", "path", "md5", "split", F.col("cls").alias("class")), path)
    return spark.read.parquet(path)


@query(
    "a06_write_predictions",
    with_views(
        "SELECT id, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END AS true_class, p FROM preds", "preds"
    ),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    reports.write_predictions(document_preds(spark, sf_dir), path)
    return reports.read_report_csv(spark, path, reports.PREDICTION_SCHEMA)


@query(
    "a08_outputs_exist",
    with_views("SELECT false AS before, true AS after, count(*) AS n_rows FROM items", "items"),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "items")
    before = reports.outputs_exist(spark, [path])
    document_items(spark, sf_dir).write.parquet(path)
    after = reports.outputs_exist(spark, [path])
    return spark.read.parquet(path).agg(
        F.lit(before).alias("before"), F.lit(after).alias("after"), F.count("*").alias("n_rows")
    )


@query(
    "a09_bundle_report",
    with_views(
        f"""WITH swept AS ({_sweep_sql("true")}),
        c AS (SELECT {counts('0.75::DOUBLE')} FROM preds)
        SELECT (SELECT CAST(count(*) AS INTEGER) FROM swept) AS sweep_rows,
          (SELECT max(threshold) FROM swept) AS last_threshold,
          tp + fn AS positives, fp + fn AS misclassified, 8 AS confusion_cells,
          (SELECT CAST(count(DISTINCT split || cls) AS INTEGER) FROM items) AS count_rows,
          'poor' AS negative, 'good' AS positive
        FROM c""",
        "preds",
        "cuts",
        "items",
    ),
)
def _(spark, sf_dir):
    preds = document_preds(spark, sf_dir)
    items = document_items(spark, sf_dir)
    classes = labelled_items(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))
    positives = preds.agg(F.count_if(F.col("y") == 1)).scalar()
    document = reports.bundle_report(
        spark,
        {
            "sweep": ev.sweep(preds),
            "headline": ev.scores(preds, 0.75),
            "confusion": ev.confusion_pair(preds, 0.75),
            "counts": items.groupBy("split", "cls").agg(F.count("*").alias("n")),
            "classes": reports.infer_class_order(classes, positives),
        },
    )
    head = F.col("headline")[0]
    return document.select(
        F.size("sweep").alias("sweep_rows"),
        F.array_max("sweep.threshold").alias("last_threshold"),
        (head["tp"] + head["fn"]).alias("positives"),
        (head["fp"] + head["fn"]).alias("misclassified"),
        F.size("confusion").alias("confusion_cells"),
        F.size("counts").alias("count_rows"),
        F.col("classes")[0]["negative"].alias("negative"),
        F.col("classes")[0]["positive"].alias("positive"),
    )


@query(
    "a10_infer_class_order",
    with_views(
        """SELECT max(cls) FILTER (n <> p) AS negative, max(cls) FILTER (n = p) AS positive
        FROM (SELECT cls, count(*) AS n, (SELECT count(*) FROM labels WHERE quality = 1) AS p FROM labelled GROUP BY cls)""",
        "labelled",
    ),
)
def _(spark, sf_dir):
    counted = labelled_items(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))
    positives = table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1)).scalar()
    return reports.infer_class_order(counted, positives)


@query(
    "a11_load_threshold",
    with_views(
        f"""WITH swept AS ({_sweep_sql("split = 'val'")})
        SELECT coalesce((SELECT min(threshold) FROM swept WHERE precision >= 0.95::DOUBLE),
          (SELECT threshold FROM swept ORDER BY precision DESC, threshold LIMIT 1)) AS threshold, 'saved' AS origin
        UNION ALL SELECT 5e-1::DOUBLE, 'default'""",
        "preds",
        "cuts",
    ),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "threshold")
    val = document_preds(spark, sf_dir).where("split = 'val'")
    reports.write_report(ev.choose_threshold(ev.sweep(val), 0.95), path)
    saved = reports.read_report_json(spark, path, "threshold double")
    return reports.load_threshold(saved, spark).unionByName(reports.load_threshold(None, spark))
