"""Section I: arriving rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.queries import Registry
from itemlab.sources.tables import letter_share
from itemlab.streaming.scoring import admission_filter, read_stream, run_available, score_stream

registry = Registry()
query = registry.query

THRESHOLD = 0.75
KINDS = ("en", "fr", "de")
MAX_BYTES = 6000


@query(
    "i01_score_stream",
    f"""SELECT doc_id AS id, p, CASE WHEN p >= {THRESHOLD}::DOUBLE THEN 'pos' ELSE 'neg' END AS label
    FROM (SELECT doc_id, floor(length(regexp_replace(text, '[^a-z ]', '', 'g')) / length(text) * 1e6) / 1e6 AS p FROM documents)""",
)
def _(spark, sf_dir):
    arriving = read_stream(spark, f"{sf_dir}/documents*.parquet")
    scored = score_stream(arriving, letter_share(F.col("text")), THRESHOLD)
    return run_available(scored.select(F.col("doc_id").alias("id"), "p", "label"), "scored")


@query(
    "i02_admission_filter",
    f"""SELECT doc_id AS id, CAST(status AS INTEGER) AS status, status = 200 AS admitted FROM (
      SELECT doc_id, CASE WHEN lang NOT IN {KINDS} THEN 415 WHEN strlen(text) = 0 THEN 400
        WHEN strlen(text) > {MAX_BYTES} THEN 413 WHEN length(text) < 20 THEN 400 ELSE 200 END AS status FROM documents)""",
)
def _(spark, sf_dir):
    arriving = read_stream(spark, f"{sf_dir}/documents*.parquet")
    checked = admission_filter(
        arriving, F.col("lang"), F.col("text"), F.length("text") >= 20, KINDS, MAX_BYTES
    )
    picked = checked.select(F.col("doc_id").alias("id"), "status", "admitted")
    return run_available(picked, "admission", ["admitted"])
