"""Section E: the dataset audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.functions.images import image_features, text_as_image
from itemlab.operators import audit, sampling
from itemlab.operators.learning import fold_weights, leak_rows, source_leak
from itemlab.plans.staging import scratch_path, spread, stage
from itemlab.queries import Registry
from itemlab.queries.dedup import FINGERPRINT_SQL
from itemlab.queries.views import differing, draw, with_views
from itemlab.sources.reports import read_report_json
from itemlab.sources.tables import document_items, hashed_items, labelled_items, table

registry = Registry()
query = registry.query

CLASSES = ("de", "en", "es", "fr")
SIDE = 3


def leak_sql(source: str) -> str:
    """The leave-one-out guess row by row: the commonest class among the others of equal size."""
    return f"""
  sized AS (SELECT * FROM {source} WHERE mode <> 'CORRUPT'),
  cells AS (SELECT w, h, cls, count(*) AS n, min(id) AS f FROM sized GROUP BY w, h, cls),
  overall AS (SELECT cls, count(*) AS n, min(id) AS f FROM sized GROUP BY cls),
  major AS (SELECT cls FROM overall ORDER BY n DESC, f LIMIT 1),
  others AS (
    SELECT s.id, c.cls, row_number() OVER (PARTITION BY s.id
      ORDER BY c.n - CASE WHEN c.cls = s.cls THEN 1 ELSE 0 END DESC, c.f) AS k
    FROM sized s JOIN cells c USING (w, h)
    WHERE c.n - CASE WHEN c.cls = s.cls THEN 1 ELSE 0 END > 0),
  guessed AS (SELECT s.id, s.cls, o.cls AS found, coalesce(o.cls, (SELECT cls FROM major)) AS guess
    FROM sized s LEFT JOIN others o ON o.id = s.id AND o.k = 1),
  leak AS (SELECT count(*) AS n,
      (SELECT round(avg(r) * 100, 9) FROM (SELECT avg(CASE WHEN guess = cls THEN 1 ELSE 0 END) AS r FROM guessed GROUP BY cls)) AS balanced_accuracy,
      round(count(*) FILTER (guess = cls) / count(*) * 100, 9) AS plain_accuracy,
      (SELECT cls FROM major) AS majority,
      round((SELECT max(n) FROM overall) / count(*) * 100, 9) AS majority_pct,
      round(count(*) FILTER (found IS NULL) / count(*) * 100, 9) AS fallback_pct
    FROM guessed),
  groups AS (SELECT w, h, CAST(sum(n) AS BIGINT) AS items, max(n) AS top_n,
      arg_min(cls, struct_pack(a := -n, b := f)) AS cls FROM cells GROUP BY w, h),
  blocks AS (SELECT w, h, items, cls, top_n / items AS share, items / (SELECT count(*) FROM sized) * 100 AS pct
    FROM groups JOIN (SELECT cls, n AS cls_rows FROM overall) USING (cls)
    WHERE items >= 5 AND top_n / items >= 0.95::DOUBLE
      AND top_n / items - cls_rows / (SELECT count(*) FROM sized) >= 0.10::DOUBLE)
"""


def _leak(body: str, source: str = "items") -> str:
    return with_views(f"WITH {leak_sql(source)} {body}", source)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(
    "e01_count_matrix",
    with_views(
        f"SELECT split, {', '.join(f'''count(*) FILTER (cls = '{c}') AS n_{c}''' for c in CLASSES)} "
        "FROM items GROUP BY split",
        "items",
    ),
)
def _(spark, sf_dir):
    return audit.count_matrix(document_items(spark, sf_dir), CLASSES)


@query("e02_metadata_leak", _leak("SELECT * FROM leak"))
def _(spark, sf_dir):
    found = audit.metadata_leak(document_items(spark, sf_dir))
    return _rounded(found, "balanced_accuracy", "plain_accuracy", "majority_pct", "fallback_pct")


@query("e03_single_class_blocks", _leak("SELECT w, h, items, cls, round(share, 9) AS share, round(pct, 9) AS pct FROM blocks"))
def _(spark, sf_dir):
    return _rounded(audit.single_class_blocks(document_items(spark, sf_dir)), "share", "pct")


@query(
    "e03_top_blocks",
    _leak(
        "SELECT w, h, items, cls, round(share, 9) AS share, round(pct, 9) AS pct FROM blocks "
        "ORDER BY items DESC, w DESC, h DESC LIMIT 3",
    ),
)
def _(spark, sf_dir):
    blocks = audit.single_class_blocks(document_items(spark, sf_dir))
    return _rounded(audit.top_blocks(blocks), "share", "pct")


@query(
    "e04_distinct_keys_per_class",
    _leak("SELECT cls, count(*) AS distinct_keys FROM cells GROUP BY cls"),
)
def _(spark, sf_dir):
    return audit.distinct_keys_per_class(document_items(spark, sf_dir))


SEVERITY_SQL = """CASE WHEN balanced_accuracy >= 90 OR block_pct > 35 THEN 'FAIL'
  WHEN balanced_accuracy >= 65 THEN 'WARN' ELSE 'OK' END"""


@query(
    "e05_leak_verdict",
    _leak(
        f"""SELECT balanced_accuracy, block_pct, {SEVERITY_SQL} AS severity
        FROM (SELECT balanced_accuracy, (SELECT round(coalesce(sum(pct), 0), 9) FROM blocks) AS block_pct FROM leak)""",
        "labelled",
    ),
)
def _(spark, sf_dir):
    found = audit.leak_verdict(labelled_items(spark, sf_dir))
    return _rounded(found, "balanced_accuracy", "block_pct")


QUALITY_SQL = f"""
  SELECT 'unreadable' AS key, count(*) FILTER (mode = 'CORRUPT') AS value FROM {{source}}
  UNION ALL SELECT 'unloadable', count(*) FILTER (NOT loadable AND mode <> 'CORRUPT') FROM {{source}}
  UNION ALL SELECT 'smaller', count(*) FILTER (mode <> 'CORRUPT' AND least(w, h) < {SIDE}) FROM {{source}}
  UNION ALL SELECT 'smaller.' || cls, count(*) FILTER (mode <> 'CORRUPT' AND least(w, h) < {SIDE}) FROM {{source}} GROUP BY cls
  UNION ALL SELECT 'mode.' || mode, count(*) FROM {{source}} GROUP BY mode
"""


@query("e06_quality_audit", with_views(QUALITY_SQL.format(source="items"), "items"))
def _(spark, sf_dir):
    return audit.quality_audit(document_items(spark, sf_dir), SIDE)


@query(
    "e07_filename_pattern",
    """WITH named AS (SELECT page_id AS id, regexp_extract(url, 'example\\.([a-z]+)/', 1) AS cls,
        regexp_replace(url, '^[a-z]+://', '') AS name FROM pages),
      c AS (SELECT cls, lower(substr(name, 1, 6)) AS prefix, count(*) AS n, min(id) AS f FROM named GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY cls) AS total FROM c)
    SELECT r.cls, (SELECT arg_min(name, id) FROM named m WHERE m.cls = r.cls) AS example,
      prefix AS top_prefix, (n / total)::DOUBLE AS share FROM r WHERE k = 1""",
)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_extract("url", r"example\.([a-z]+)/", 1).alias("cls"),
        F.regexp_replace("url", "^[a-z]+://", "").alias("name"),
    )
    return audit.filename_pattern(pages)


@query(
    "e08_balanced_accuracy",
    with_views(
        """SELECT round(avg(r) * 100, 9) AS balanced_accuracy FROM (
          SELECT avg(CASE WHEN CASE WHEN mode = 'WIDE' THEN 'fr' ELSE 'en' END = cls THEN 1 ELSE 0 END) AS r
          FROM items GROUP BY cls)""",
        "items",
    ),
)
def _(spark, sf_dir):
    guess = F.when(F.col("mode") == "WIDE", "fr").otherwise("en")
    guesses = document_items(spark, sf_dir).select(F.col("cls").alias("truth"), guess.alias("guess"))
    return _rounded(audit.balanced_accuracy(guesses), "balanced_accuracy")


@query(
    "e09_vector_features",
    """WITH v AS (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS i, embedding AS e FROM embeddings),
      x AS (SELECT id, i, e[i]::DOUBLE AS x, CASE WHEN i > 1 AND i < len(e)
        THEN e[i - 1]::DOUBLE + e[i + 1]::DOUBLE - 2 * e[i]::DOUBLE END AS bend FROM v),
      s AS (SELECT id, (i - 1) % 4 AS ch, stddev_pop(x) AS sd FROM x GROUP BY ALL)
    SELECT id, round(var_pop(bend), 9) AS blur, round(stddev_pop(x), 9) AS contrast,
      round((SELECT avg(sd) FROM s WHERE s.id = x.id), 9) AS spread FROM x GROUP BY id""",
)
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    found = audit.vector_features(vectors, "embedding")
    return _rounded(found.select("id", "blur", "contrast", "spread"), "blur", "contrast", "spread")


@query("e09_image_features")
def _(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    images = text_as_image(docs, "doc_id", "text")
    features = image_features(images, "squash").withColumn("framing", F.lit("squash"))
    centred = image_features(images, "centre_crop").withColumn("framing", F.lit("centre_crop"))
    return features.unionByName(centred)


def _leak_features(spark, sf_dir):
    """Content-free numbers of every vector, whole and of its middle half."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "low").otherwise("high").alias("cls"), "embedding"
    )
    n = F.size("embedding")
    framings = {"squash": F.col("embedding"), "centre_crop": F.slice("embedding", (n / 4 + 1).cast("int"), (n / 2).cast("int"))}
    parts = [
        audit.vector_features(vectors.withColumn("embedding", part), "embedding").withColumn("framing", F.lit(name)).drop("embedding")
        for name, part in framings.items()
    ]
    return stage(parts[0].unionByName(parts[1]), "features")


LEAK_ROWS_SQL = f"""
  v AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS cls FROM embeddings),
  sized AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {draw(42, 'id')}, id) AS rank,
    count(*) OVER (PARTITION BY cls) AS n_cls, count(*) OVER () AS n FROM v),
  leak_rows AS (SELECT id, cls, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM sized
    WHERE rank <= CASE WHEN n > 2000 THEN round_even(2000.0::DOUBLE * n_cls / n, 0) ELSE n_cls END)
"""


@query("e10_leak_rows", f"WITH {LEAK_ROWS_SQL} SELECT * FROM leak_rows")
def _(spark, sf_dir):
    return leak_rows(_leak_features(spark, sf_dir))


@query(
    "e10_leak_weights",
    f"""WITH {LEAK_ROWS_SQL},
      outside AS (SELECT f.fold, r.cls, count(*) AS items FROM (SELECT DISTINCT fold FROM leak_rows) f
        JOIN leak_rows r ON r.fold <> f.fold GROUP BY ALL)
    SELECT fold, cls, items, round(sum(items) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * items), 9) AS weight
    FROM outside""",
)
def _(spark, sf_dir):
    return _rounded(fold_weights(leak_rows(_leak_features(spark, sf_dir))), "weight")


@query("e10_source_leak")
def _(spark, sf_dir):
    return source_leak(_leak_features(spark, sf_dir), framing="framing")


def checks_sql(source: str) -> str:
    return f"""
  {leak_sql(source)},
  g AS (SELECT count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT cls) AS c
    FROM {source} GROUP BY md5 HAVING count(*) > 1),
  near AS (SELECT a.split <> b.split AS s, a.cls <> b.cls AS c FROM {source} a JOIN {source} b
    ON a.id < b.id AND a.md5 <> b.md5 WHERE {differing('a', 'b')} <= 25),
  prefixes AS (SELECT cls, lower(substr(name, 1, 6)) AS prefix, count(*) AS n FROM {source} GROUP BY ALL),
  {FINGERPRINT_SQL.format(source=source).strip()},
  checks AS (
    SELECT 'counts' AS "check", split || '/' || cls AS key, count(*)::DOUBLE AS value FROM {source} GROUP BY split, cls
    UNION ALL SELECT 'size_leak', 'balanced_accuracy', balanced_accuracy FROM leak
    UNION ALL SELECT 'size_leak', 'plain_accuracy', plain_accuracy FROM leak
    UNION ALL SELECT 'size_leak', 'majority_pct', majority_pct FROM leak
    UNION ALL SELECT 'size_leak', 'fallback_pct', fallback_pct FROM leak
    UNION ALL SELECT 'size_leak', 'block_pct', round(coalesce(sum(pct), 0), 9) FROM blocks
    UNION ALL SELECT 'size_leak', 'blocks', count(*) FROM blocks
    UNION ALL SELECT 'distinct_sizes', cls, count(*) FROM cells GROUP BY cls
    UNION ALL SELECT 'duplicates', 'exact_extra_copies', coalesce(sum(n - 1), 0) FROM g
    UNION ALL SELECT 'duplicates', 'near_pairs', count(*) FROM near
    UNION ALL SELECT 'duplicates', 'across_splits', (SELECT count(*) FROM g WHERE s > 1) + (SELECT count(*) FROM near WHERE s)
    UNION ALL SELECT 'duplicates', 'across_classes', (SELECT count(*) FROM g WHERE c > 1) + (SELECT count(*) FROM near WHERE c)
    UNION ALL SELECT 'quality', key, value FROM ({QUALITY_SQL.format(source=source)})
    UNION ALL SELECT 'filenames', cls, round(max(n) / sum(n), 9) FROM prefixes GROUP BY cls
    UNION ALL SELECT 'top_blocks', w || 'x' || h || '/' || cls, items
      FROM (SELECT * FROM blocks ORDER BY items DESC, w DESC, h DESC LIMIT 3)
    UNION ALL SELECT 'fingerprint', fingerprint, (SELECT count(*) FROM {source}) FROM l0)
"""


ISSUES_SQL = """
  v AS (SELECT max(value) FILTER ("check" = 'size_leak' AND key = 'balanced_accuracy') AS balanced_accuracy,
      max(value) FILTER ("check" = 'size_leak' AND key = 'block_pct') AS block_pct,
      max(value) FILTER ("check" = 'duplicates' AND key = 'across_splits') AS x_split,
      max(value) FILTER ("check" = 'duplicates' AND key = 'across_classes') AS x_cls,
      coalesce(sum(value) FILTER ("check" = 'quality' AND key IN ('unreadable', 'unloadable')), 0) AS unusable,
      max(value) FILTER ("check" = 'quality' AND key = 'smaller') AS smaller,
      sum(value) FILTER ("check" = 'counts') AS n,
      (SELECT max(n) / greatest(min(n), 1) FROM (SELECT sum(value) AS n FROM checks WHERE "check" = 'counts'
        GROUP BY string_split(key, '/')[2])) AS ratio
    FROM checks),
  issues AS (
    SELECT 'WARN' AS severity, 'counts' AS "check", 'classes are imbalanced ' || CAST(round_even(ratio, 1) AS VARCHAR)
      || ':1; use class weights and balanced metrics' AS message FROM v WHERE ratio > 3
    UNION ALL SELECT 'WARN', 'counts', 'only ' || CAST(n AS BIGINT) || ' items; report mean and deviation over several seeds'
      FROM v WHERE n < 1000
    UNION ALL SELECT 'FAIL', 'size_leak', CAST(round_even(block_pct, 0) AS BIGINT)
      || '% of items sit in single-class blocks; the keys alone score '
      || CAST(round_even(balanced_accuracy, 0) AS BIGINT) || '% balanced accuracy'
      FROM v WHERE balanced_accuracy >= 90 OR block_pct > 35
    UNION ALL SELECT 'WARN', 'size_leak', 'the keys alone score ' || CAST(round_even(balanced_accuracy, 0) AS BIGINT)
      || '% balanced accuracy' FROM v WHERE balanced_accuracy >= 65 AND balanced_accuracy < 90 AND block_pct <= 35
    UNION ALL SELECT 'FAIL', 'duplicates', CAST(x_split AS BIGINT) || ' copies lie in more than one split' FROM v WHERE x_split > 0
    UNION ALL SELECT 'FAIL', 'duplicates', CAST(x_cls AS BIGINT) || ' copies lie in more than one class' FROM v WHERE x_cls > 0
    UNION ALL SELECT 'FAIL', 'quality', CAST(unusable AS BIGINT) || ' items cannot be read' FROM v WHERE unusable > 0
    UNION ALL SELECT 'WARN', 'quality', CAST(smaller AS BIGINT) || ' items are smaller than the input size'
      FROM v WHERE smaller > 0.10::DOUBLE * n)
"""


@query("e11_audit_verdict", with_views(
    f"""WITH {checks_sql('hashed')}, {ISSUES_SQL}
    SELECT CASE WHEN count(*) FILTER (severity = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
      count(*) AS issues FROM issues""", "hashed"))
def _(spark, sf_dir):
    checks = stage(audit.run_audit(hashed_items(spark, sf_dir), side=SIDE), "checks")
    return audit.audit_verdict(audit.audit_issues(checks))


@query("e12_run_audit", with_views(f"WITH {checks_sql('hashed')} SELECT * FROM checks", "hashed"))
def _(spark, sf_dir):
    checks = audit.run_audit(hashed_items(spark, sf_dir), side=SIDE)
    return _rounded(checks, "value")


@query(
    "e12_audit_issues",
    with_views(f"WITH {checks_sql('hashed')}, {ISSUES_SQL} SELECT * FROM issues", "hashed"),
)
def _(spark, sf_dir):
    checks = stage(audit.run_audit(hashed_items(spark, sf_dir), side=SIDE), "checks")
    return audit.audit_issues(checks)


def _summary_sql(name: str, source: str) -> str:
    """One saved report in SQL; a subquery of its own, since each names its steps alike."""
    return f"""(WITH {checks_sql(source)}, {ISSUES_SQL}
      SELECT '{name}' AS target, CAST(n AS BIGINT) AS n_items, balanced_accuracy,
        (SELECT plain_accuracy FROM leak) AS plain_accuracy, block_pct, NULL::DOUBLE AS content_free, 50.0::DOUBLE AS chance,
        'split' AS mode, (SELECT fingerprint FROM l0) AS fingerprint,
        (SELECT CAST(least(count(*), 3) AS INTEGER) FROM blocks) AS n_blocks,
        CASE WHEN (SELECT count(*) FROM issues WHERE severity = 'FAIL') > 0 THEN 'FAIL'
          WHEN (SELECT count(*) FROM issues) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict,
        (SELECT CAST(count(*) AS INTEGER) FROM issues) AS n_issues,
        (SELECT coalesce(count(*) FILTER (severity = 'FAIL') / nullif(count(*), 0), 0) FROM issues) AS failing_share
      FROM v)"""


@query(
    "e13_compare_audits",
    with_views(
        f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {draw(42, 'id')}, id) AS rn,
            count(*) OVER (PARTITION BY cls) AS n_cls FROM hashed),
        balanced AS (SELECT * EXCLUDE (rn, n_cls) FROM ranked WHERE rn <= (SELECT min(n_cls) FROM ranked))
        SELECT * FROM {_summary_sql('all documents', 'hashed')}
        UNION ALL SELECT * FROM {_summary_sql('balanced sample', 'balanced')}""",
        "hashed",
    ),
)
def _(spark, sf_dir):
    items = hashed_items(spark, sf_dir)
    datasets = {
        "all documents": items,
        "balanced sample": stage(sampling.balanced_sample(items), "balanced"),
    }
    folder = scratch_path(spark, "reports")
    for name, data in datasets.items():
        checks = stage(audit.run_audit(data, side=SIDE), "checks")
        audit.audit_report(checks, name).write.mode("append").json(folder)
    compared = audit.compare_audits(read_report_json(spark, folder, audit.REPORT_SCHEMA))
    return _rounded(compared, "balanced_accuracy", "plain_accuracy", "block_pct")
