"""Section B: rules, labels and crop windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.functions.scalars import extension_of, has_extension
from itemlab.operators import quality
from itemlab.queries import Registry
from itemlab.queries.views import draw, with_views
from itemlab.sources.tables import document_items, table

registry = Registry()
query = registry.query

PAGE_EXTENSIONS = (".com", ".html", ".net", ".org")
CLASSES = ("en", "fr", "de")


@query(
    "b01_usable_with_reason",
    """SELECT doc_id AS id,
      CASE WHEN length(trim(text)) = 0 THEN 'empty text'
        WHEN length(text) < 20 THEN 'too short'
        WHEN len(list_distinct(string_split_regex(trim(text), '[ \\n]+'))) < 25 THEN 'flat text' END AS reason
    FROM documents""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return quality.with_reason(docs, quality.text_rules("text", min_words=25)).select("id", "reason")


@query(
    "b02_loadable",
    """SELECT page_id AS id, regexp_matches(lower(url), '(\\.com|\\.html|\\.net|\\.org)$') AS loadable,
      regexp_extract(url, '[^/.](\\.[^./]*)$', 1) AS extension FROM pages""",
)
def _(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        has_extension(url, PAGE_EXTENSIONS).alias("loadable"),
        extension_of(url).alias("extension"),
    )


@query(
    "b07_undersized",
    with_views("SELECT id, w, h FROM items WHERE w > 0 AND least(w, h) < 3", "items"),
)
def _(spark, sf_dir):
    return quality.undersized(document_items(spark, sf_dir), 3).select("id", "w", "h")


@query(
    "b08_label_index",
    with_views(
        """SELECT id, cls, CASE cls WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS y FROM items""",
        "items",
    ),
)
def _(spark, sf_dir):
    return quality.label_index(document_items(spark, sf_dir), CLASSES).select("id", "cls", "y")


_WINDOW_SQL = """
  sized AS (SELECT *, sqrt(h::DOUBLE * w * area * aspect) AS cw, sqrt(h::DOUBLE * w * area / aspect) AS ch FROM shaped),
  shrunk AS (SELECT *, least(1::DOUBLE, least(w::DOUBLE / cw, h::DOUBLE / ch)) AS s FROM sized),
  fitted AS (SELECT *,
    CAST(least(greatest(round_even(ch * s, 0), 1), h) AS INTEGER) AS crop_h,
    CAST(least(greatest(round_even(cw * s, 0), 1), w) AS INTEGER) AS crop_w FROM shrunk)
"""


@query(
    "b09_center_crop_window",
    with_views(
        f"""WITH shaped AS (SELECT id, w, h, 1::DOUBLE AS area,
            greatest(0.75::DOUBLE, least(4 / 3::DOUBLE, w / h)) AS aspect FROM items WHERE w > 0 AND h > 0),
        {_WINDOW_SQL}
        SELECT id, crop_h, crop_w, (h - crop_h) // 2 AS top, (w - crop_w) // 2 AS "left" FROM fitted""",
        "items",
    ),
)
def _(spark, sf_dir):
    windows = quality.center_crop_window(document_items(spark, sf_dir))
    return windows.select("id", "crop_h", "crop_w", "top", "left")


def _uniform(purpose: str) -> str:
    key = draw(42, "id", "epoch", f"'{purpose}'")
    return f"(CAST(('0x' || substr({key}, 1, 8)) AS BIGINT) / 4294967296::DOUBLE)"


@query(
    "b10_random_crop_plan",
    with_views(
        f"""WITH shaped AS (SELECT id, epoch, w, h, 0.7::DOUBLE + {_uniform('area')} * (1.0::DOUBLE - 0.7::DOUBLE) AS area,
            exp(ln(0.75::DOUBLE) + {_uniform('aspect')} * (ln(4 / 3::DOUBLE) - ln(0.75::DOUBLE))) AS aspect
          FROM items, (SELECT CAST(e AS INTEGER) AS epoch FROM range(1, 4) r(e)) WHERE w > 0 AND h > 0),
        {_WINDOW_SQL}
        SELECT id, epoch, crop_h, crop_w,
          CAST(least(floor({_uniform('top')} * (h - crop_h + 1)), h - crop_h) AS INTEGER) AS top,
          CAST(least(floor({_uniform('left')} * (w - crop_w + 1)), w - crop_w) AS INTEGER) AS "left"
        FROM fitted""",
        "items",
    ),
)
def _(spark, sf_dir):
    plan = quality.random_crop_plan(document_items(spark, sf_dir), epochs=3)
    return plan.select("id", "epoch", "crop_h", "crop_w", "top", "left")
