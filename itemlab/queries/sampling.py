"""Section D: samples, splits and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.operators import quality, sampling
from itemlab.operators.manifest import manifest_is_complete, split_manifest
from itemlab.queries import Registry
from itemlab.queries.views import differing, draw, with_views
from itemlab.sources.files import assign_output_names
from itemlab.sources.tables import document_items, document_preds, hashed_items, table

registry = Registry()
query = registry.query

THRESHOLD = 0.75


def _ranked(source: str, by: str = "cls", seed: int = 42) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {draw(seed, 'id')}, id) AS rn,
        count(*) OVER (PARTITION BY {by}) AS n FROM {source}"""


@query(
    "a07_assign_output_names",
    with_views(
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY split, cls, name ORDER BY path, md5) AS rn FROM items)
        SELECT id, split, cls, name, CASE WHEN rn = 1 THEN name
          ELSE regexp_replace(name, '\\.txt$', '') || '_' || substr(md5, 1, 8) || '.txt' END AS file FROM r""",
        "items",
    ),
)
def _(spark, sf_dir):
    return assign_output_names(document_items(spark, sf_dir)).select("id", "split", "cls", "name", "file")


@query(
    "d01_balanced_sample",
    with_views(
        f"""WITH r AS ({_ranked('items')})
        SELECT id, cls FROM r WHERE rn <= (SELECT min(n) FROM r)""",
        "items",
    ),
)
def _(spark, sf_dir):
    return sampling.balanced_sample(document_items(spark, sf_dir)).select("id", "cls")


@query(
    "d02_subsample_class",
    with_views(
        f"""WITH r AS ({_ranked('items')})
        SELECT id, cls, CASE WHEN cls = 'en' AND rn > 200 THEN 'not_sampled' ELSE 'kept' END AS status FROM r""",
        "items",
    ),
)
def _(spark, sf_dir):
    cut = sampling.subsample_class(document_items(spark, sf_dir), "en", limit=200)
    return cut.select("id", "cls", "status")


SPLIT_CASE = """CASE WHEN rn <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
  WHEN rn <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END"""


@query(
    "d03_stratified_split",
    with_views(
        f"WITH r AS ({_ranked('items')}) SELECT id, cls, {SPLIT_CASE} AS split FROM r", "items"
    ),
)
def _(spark, sf_dir):
    return sampling.stratified_split(document_items(spark, sf_dir)).select("id", "cls", "split")


@query(
    "d03_stratified_split_lines",
    f"""WITH keyed AS (SELECT l_returnflag AS cls, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-'
          || l_linenumber || '-' || l_extendedprice::DECIMAL(18, 2) AS id FROM lineitem),
      r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {draw(42, 'id')}, id) AS rn,
        count(*) OVER (PARTITION BY cls) AS n FROM keyed)
    SELECT cls, {SPLIT_CASE} AS split, count(*) AS rows, min(id) AS first_id, max(id) AS last_id
    FROM r GROUP BY ALL""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", price)
    keyed = lines.select(F.col("l_returnflag").alias("cls"), key.alias("id"))
    return sampling.stratified_split(keyed).groupBy("cls", "split").agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query(
    "d04_capped_stratified_sample",
    with_views(
        f"""WITH r AS ({_ranked('items')}), t AS (SELECT count(*) AS total FROM items)
        SELECT id, cls FROM r, t WHERE total <= 150 OR rn <= round_even(150::DOUBLE * n / total, 0)""",
        "items",
    ),
)
def _(spark, sf_dir):
    picked = sampling.capped_stratified_sample(document_items(spark, sf_dir), cap=150)
    return picked.select("id", "cls")


@query(
    "d05_stratified_folds",
    with_views(
        f"WITH r AS ({_ranked('items')}) SELECT id, cls, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM r",
        "items",
    ),
)
def _(spark, sf_dir):
    return sampling.stratified_folds(document_items(spark, sf_dir)).select("id", "cls", "fold")


@query(
    "d06_systematic_sample",
    with_views(
        """WITH r AS (SELECT id, path, row_number() OVER (ORDER BY path) - 1 AS pos, count(*) OVER () AS n FROM items),
        k AS (SELECT CASE WHEN i = 31 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 31::DOUBLE)) AS BIGINT) END AS pos
          FROM range(32) g(i), (SELECT count(*) AS n FROM items))
        SELECT id, path FROM r WHERE pos IN (SELECT pos FROM k)""",
        "items",
    ),
)
def _(spark, sf_dir):
    items = document_items(spark, sf_dir).select("id", "path")
    return sampling.systematic_sample(items, 32, order=["path"])


@query(
    "d07_pick_examples",
    with_views(
        f"""WITH j AS (SELECT *, (CASE WHEN p >= {THRESHOLD}::DOUBLE THEN 1 ELSE 0 END) = y AS ok FROM preds),
        r AS ({_ranked('(SELECT * FROM j WHERE ok)', 'y')})
        SELECT id, y, p, 'correct' AS kind FROM r WHERE rn <= 2
        UNION ALL (SELECT id, y, p, 'wrong' FROM j WHERE NOT ok
          ORDER BY abs(p - {THRESHOLD}::DOUBLE) DESC, id LIMIT 4)""",
        "preds",
    ),
)
def _(spark, sf_dir):
    preds = document_preds(spark, sf_dir).select("id", "y", "p")
    return sampling.pick_examples(preds, THRESHOLD)


@query(
    "d08_class_weights",
    with_views(
        """WITH c AS (SELECT cls, count(*) AS n FROM items WHERE split = 'train' GROUP BY cls)
        SELECT cls, n, (sum(n) OVER () / ((count(*) OVER ()) * n))::DOUBLE AS weight FROM c""",
        "items",
    ),
)
def _(spark, sf_dir):
    return sampling.class_weights(document_items(spark, sf_dir).where("split = 'train'"))


def manifest_sql(limit: int) -> str:
    """The whole split in SQL: every step over the rows the step before has kept."""
    return f"""
  reasoned AS (SELECT h.*, CASE WHEN mode = 'CORRUPT' THEN 'too short' END AS reason FROM hashed h),
  e AS (SELECT md5, count(*) AS n, min(cls) <> max(cls) AS mixed, arg_min(id, path) AS first_id,
      min(path) AS first_path FROM reasoned WHERE reason IS NULL GROUP BY md5),
  ex AS (SELECT r.*, n = 1 OR (NOT mixed AND id = first_id) AS ok,
      CASE WHEN mixed THEN 'same content in several classes' ELSE 'exact copy of ' || first_path END AS note
    FROM reasoned r JOIN e USING (md5) WHERE reason IS NULL),
  nodes AS (SELECT min(id) AS node, u0, u1, u2, u3 FROM ex WHERE ok AND u0 IS NOT NULL GROUP BY u0, u1, u2, u3),
  pairs AS (SELECT a.node AS id_a, b.node AS id_b FROM nodes a JOIN nodes b ON a.node < b.node
    WHERE {differing('a', 'b')} <= 25),
  reach AS (SELECT node AS root, node FROM nodes UNION
    SELECT r.root, CASE WHEN p.id_a = r.node THEN p.id_b ELSE p.id_a END
    FROM reach r JOIN pairs p ON r.node = p.id_a OR r.node = p.id_b),
  grp AS (SELECT x.*, g.component FROM ex x LEFT JOIN nodes n USING (u0, u1, u2, u3)
    LEFT JOIN (SELECT node, min(root) AS component FROM reach GROUP BY node) g ON g.node = n.node WHERE ok),
  best AS (SELECT component, count(*) AS n, min(cls) <> max(cls) AS mixed,
      arg_min(struct_pack(id := id, path := path, u0 := u0, u1 := u1, u2 := u2, u3 := u3),
        struct_pack(s := -size, path := path)) AS b
    FROM grp WHERE component IS NOT NULL GROUP BY component),
  nd AS (SELECT g.* EXCLUDE (ok, note), n IS NULL OR n = 1 OR (NOT mixed AND id = b.id) AS ok,
      CASE WHEN mixed THEN 'near copies in several classes'
        ELSE 'near copy of ' || b.path || ' (' || CAST({differing('g', 'b')} AS VARCHAR) || '/256 bits differ)' END AS note
    FROM grp g LEFT JOIN best USING (component)),
  sub AS (SELECT *, cls = 'en' AND row_number() OVER (PARTITION BY cls ORDER BY {draw(42, 'id')}, id) > {limit} AS cut
    FROM nd WHERE ok),
  fin AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {draw(42, 'id')}, id) AS rn,
      count(*) OVER (PARTITION BY cls) AS n FROM sub WHERE NOT cut),
  placed AS (SELECT * EXCLUDE (split), {SPLIT_CASE} AS split FROM fin),
  named AS (SELECT *, row_number() OVER (PARTITION BY split, cls, name ORDER BY path, md5) AS k FROM placed)
  SELECT split, cls AS class, split || '/' || cls || '/' || CASE WHEN k = 1 THEN name
      ELSE regexp_replace(name, '\\.txt$', '') || '_' || substr(md5, 1, 8) || '.txt' END AS file,
    path AS source, md5, '' AS note FROM named
  UNION ALL SELECT 'skipped', cls, '', path, md5, reason FROM reasoned WHERE reason IS NOT NULL
  UNION ALL SELECT 'removed', cls, '', path, md5, note FROM ex WHERE NOT ok
  UNION ALL SELECT 'removed', cls, '', path, md5, note FROM nd WHERE NOT ok
  UNION ALL SELECT 'not_sampled', cls, '', path, md5, 'left out by the limit of {limit}' FROM sub WHERE cut
"""


def _recursive(body: str, *views: str) -> str:
    text = with_views("WITH " + body, *views)
    return "WITH RECURSIVE" + text[len("WITH"):]


@query("d09_split_manifest", _recursive(manifest_sql(300), "hashed"))
def _(spark, sf_dir):
    return _manifest_of(hashed_items(spark, sf_dir))


def _manifest_of(items):
    unreadable = [(F.col("mode") == "CORRUPT", "too short")]
    return split_manifest(quality.with_reason(items, unreadable), majority="en", limit=300)


@query(
    "d09_manifest_is_complete",
    with_views('SELECT count(*) AS items, count(*) AS "rows", 0::BIGINT AS not_once FROM items', "items"),
)
def _(spark, sf_dir):
    items = hashed_items(spark, sf_dir)
    return manifest_is_complete(_manifest_of(items), items)


@query(
    "d10_epoch_shuffle",
    with_views(
        f"""WITH e AS (SELECT 3 AS epoch, * FROM items)
        SELECT id, row_number() OVER (ORDER BY {draw(42, 'epoch', 'id')}, id) - 1 AS position,
          CAST((row_number() OVER (ORDER BY {draw(42, 'epoch', 'id')}, id) - 1) // 32 AS INTEGER) AS batch FROM e""",
        "items",
    ),
)
def _(spark, sf_dir):
    ordered = sampling.epoch_shuffle(document_items(spark, sf_dir), epoch=3, batch=32)
    return ordered.select("id", "position", "batch")


@query(
    "e14_value_profile",
    with_views(
        f"""WITH e AS (SELECT 1 AS epoch, * FROM items),
        r AS (SELECT *, row_number() OVER (ORDER BY {draw(42, 'epoch', 'id')}, id) AS rn FROM e)
        SELECT min(size) AS low, max(size) AS high, count(*) FILTER (cls = 'en') AS n_en,
          count(*) FILTER (cls = 'fr') AS n_fr FROM r WHERE rn <= 32""",
        "items",
    ),
)
def _(spark, sf_dir):
    first = sampling.epoch_shuffle(document_items(spark, sf_dir), epoch=1, batch=32).where("batch = 0")
    return sampling.value_profile(first, F.col("size"), ("en", "fr"))
