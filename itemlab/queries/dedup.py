"""Section C: exact and near copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.functions.hashing import WORDS, difference_words, tokens, word_histogram
from itemlab.functions.images import image_hash, text_as_image
from itemlab.operators import dedup
from itemlab.operators.connected import components
from itemlab.operators.neighbours import near_pairs
from itemlab.queries import Registry
from itemlab.queries.views import differing, with_views
from itemlab.sources.tables import document_items, hashed_items, table
from itemlab.plans.staging import spread, stage

registry = Registry()
query = registry.query


@query(
    "c01_exact_dedup",
    with_views(
        """WITH g AS (SELECT md5, count(*) AS n, min(cls) <> max(cls) AS mixed,
            arg_min(id, path) AS first_id, min(path) AS first_path FROM items GROUP BY md5)
        SELECT id, cls, path, md5,
          CASE WHEN n = 1 OR (NOT mixed AND id = first_id) THEN 'kept' ELSE 'removed' END AS status,
          CASE WHEN n = 1 OR (NOT mixed AND id = first_id) THEN NULL
            WHEN mixed THEN 'same content in several classes'
            ELSE 'exact copy of ' || first_path END AS note
        FROM items JOIN g USING (md5)""",
        "items",
    ),
)
def _(spark, sf_dir):
    marked = dedup.exact_dedup(document_items(spark, sf_dir))
    return marked.select("id", "cls", "path", "md5", "status", "note")


@query("c02_image_hash")
def _(spark, sf_dir):
    return image_hash(text_as_image(spread(table(spark, sf_dir, "documents")), "doc_id", "text"))


def _signed(word: str) -> str:
    return (
        f"CAST(CASE WHEN {word} > 9223372036854775807 THEN CAST({word} AS HUGEINT) - 18446744073709551616 "
        f"ELSE {word} END AS BIGINT)"
    )


@query(
    "c03_difference_hash",
    with_views(
        f"""SELECT doc_id AS id, {', '.join(f'{_signed(f"u{i}")} AS h{i}' for i in range(4))}
        FROM hash_words""",
        "hash_words",
    ),
)
def _(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = docs.select(F.col("doc_id").alias("id"), tokens(F.col("text")).alias("words"))
    counted = words.where(F.size("words") > 0).select(
        "id", word_histogram(F.col("words")).alias("histogram")
    )
    return counted.select("id", *difference_words(F.col("histogram")))


@query(
    "c03_difference_hash_embeddings",
    """WITH b AS (
      SELECT vec_id, unnest(range(1, 64)) AS i, embedding FROM embeddings)
    SELECT vec_id AS id,
      CAST(sum(CASE WHEN embedding[i + 1] > embedding[i] THEN (1::BIGINT << (i - 1)) ELSE 0 END) AS BIGINT) AS h0
    FROM b GROUP BY vec_id""",
)
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("id"), difference_words(F.col("embedding"))[0])


@query("c04_near_pairs", with_views("SELECT * FROM pairs", "pairs"))
def _(spark, sf_dir):
    return near_pairs(hashed_items(spark, sf_dir))


@query(
    "c05_components",
    with_views(
        """SELECT node, min(root) AS component FROM reach
        GROUP BY node HAVING count(*) > 1""",
        "reach",
    ),
)
def _(spark, sf_dir):
    return components(near_pairs(hashed_items(spark, sf_dir)), "id_a", "id_b")


NEAR_DEDUP_SQL = f"""
  WITH best AS (
    SELECT component, count(*) AS n, min(cls) <> max(cls) AS mixed,
      arg_min(struct_pack(id := id, path := path, u0 := u0, u1 := u1, u2 := u2, u3 := u3),
        struct_pack(s := -size, path := path)) AS b
    FROM grouped WHERE component IS NOT NULL GROUP BY component)
  SELECT id, cls, path,
    CASE WHEN n IS NULL OR n = 1 OR (NOT mixed AND id = b.id) THEN 'kept' ELSE 'removed' END AS status,
    CASE WHEN n IS NULL OR n = 1 OR (NOT mixed AND id = b.id) THEN NULL
      WHEN mixed THEN 'near copies in several classes'
      ELSE 'near copy of ' || b.path || ' (' || CAST({differing('g', 'b')} AS VARCHAR) || '/256 bits differ)'
    END AS note
  FROM grouped g LEFT JOIN best USING (component)
"""


@query("c06_near_dedup", with_views(NEAR_DEDUP_SQL, "grouped"))
def _(spark, sf_dir):
    marked = dedup.near_dedup(hashed_items(spark, sf_dir))
    return marked.select("id", "cls", "path", "status", "note")


@query(
    "c07_duplicate_audit",
    with_views(
        f"""WITH g AS (SELECT count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT cls) AS c
            FROM hashed GROUP BY md5 HAVING count(*) > 1),
        near AS (SELECT a.split <> b.split AS s, a.cls <> b.cls AS c
            FROM hashed a JOIN hashed b ON a.id < b.id AND a.md5 <> b.md5
            WHERE {differing('a', 'b')} <= 25)
        SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM g) AS exact_extra_copies,
          (SELECT count(*) FROM near) AS near_pairs,
          (SELECT count(*) FROM g WHERE s > 1) + (SELECT count(*) FROM near WHERE s) AS across_splits,
          (SELECT count(*) FROM g WHERE c > 1) + (SELECT count(*) FROM near WHERE c) AS across_classes""",
        "hashed",
    ),
)
def _(spark, sf_dir):
    return dedup.duplicate_audit(hashed_items(spark, sf_dir))


FINGERPRINT_SQL = """
  lines AS (SELECT sha256(path || chr(9) || md5 || chr(10)) AS line, count(*) AS n FROM {source} GROUP BY 1),
  leaf AS (SELECT sha256(line || ':' || n) AS d FROM lines),
  l9 AS (SELECT substr(d, 1, 9) AS p, sha256(array_to_string(list_sort(list(d)), '')) AS d FROM leaf GROUP BY 1),
  l6 AS (SELECT substr(p, 1, 6) AS p, sha256(array_to_string(list_sort(list(d)), '')) AS d FROM l9 GROUP BY 1),
  l3 AS (SELECT substr(p, 1, 3) AS p, sha256(array_to_string(list_sort(list(d)), '')) AS d FROM l6 GROUP BY 1),
  l0 AS (SELECT sha256(array_to_string(list_sort(list(d)), '')) AS fingerprint FROM l3)
"""


@query(
    "c08_fingerprint",
    with_views(
        f"WITH {FINGERPRINT_SQL.format(source='items')} SELECT fingerprint FROM l0", "items"
    ),
)
def _(spark, sf_dir):
    return dedup.fingerprint(document_items(spark, sf_dir))


@query(
    "c09_audit_status",
    with_views(
        f"""WITH part AS (SELECT * FROM items WHERE split = 'train'),
        now AS (WITH {FINGERPRINT_SQL.format(source='items')} SELECT fingerprint FROM l0),
        saved AS (
          SELECT 'unchanged' AS reported, fingerprint AS f FROM now
          UNION ALL SELECT 'one split only', (WITH {FINGERPRINT_SQL.format(source='part')} SELECT fingerprint FROM l0)
          UNION ALL SELECT 'nothing', NULL)
        SELECT reported, CASE WHEN f IS NULL THEN 'missing' WHEN f = (SELECT fingerprint FROM now) THEN 'current'
          ELSE 'out of date' END AS status FROM saved""",
        "items",
    ),
)
def _(spark, sf_dir):
    items = stage(document_items(spark, sf_dir).select("path", "md5", "split"), "items")
    reports = {
        "unchanged": dedup.fingerprint(items),
        "one split only": dedup.fingerprint(items.where("split = 'train'")),
        "nothing": dedup.fingerprint(items).where("false"),
    }
    parts = [
        dedup.audit_status(items, report).select(F.lit(name).alias("reported"), "status")
        for name, report in reports.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CONTRACT_CLASSES = ("de", "en", "es", "fr", "it")


@query(
    "c12_split_contract",
    with_views(
        f"""WITH declared AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN lang ELSE 'en' END AS cls
            FROM documents JOIN labels USING (doc_id)),
        wanted AS (SELECT * FROM (SELECT unnest(['train', 'val', 'test']) AS split),
            (SELECT unnest({list(CONTRACT_CLASSES)}) AS cls))
        SELECT 'no items' AS violation, split, cls, 0::BIGINT AS n FROM wanted
          WHERE (split, cls) NOT IN (SELECT (split, cls) FROM items)
        UNION ALL SELECT 'unreadable', split, cls, count(*) FROM items WHERE mode = 'CORRUPT' GROUP BY ALL
        UNION ALL SELECT 'wrong label', i.split, i.cls, count(*) FROM items i JOIN declared d USING (id)
          WHERE i.cls <> d.cls GROUP BY ALL
        UNION ALL SELECT 'not declared', split, cls, count(*) FROM items
          WHERE id NOT IN (SELECT id FROM declared) GROUP BY ALL""",
        "items",
    ),
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    declared = table(spark, sf_dir, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.col("lang")).otherwise("en").alias("cls")
    )
    return dedup.split_contract(
        document_items(spark, sf_dir), declared, ("train", "val", "test"), CONTRACT_CLASSES
    )


@query(
    "c13_copies_across_splits",
    with_views(
        f"""WITH near AS (
          SELECT a.id AS x, b.id AS y FROM hashed a JOIN hashed b ON a.id < b.id AND a.split <> b.split
          WHERE {differing('a', 'b')} <= 25)
        SELECT id, split, cls, exact, near FROM (
          SELECT id, split, cls,
            id IN (SELECT a.id FROM hashed a JOIN hashed b ON a.md5 = b.md5 AND a.split <> b.split) AS exact,
            (id IN (SELECT x FROM near) OR id IN (SELECT y FROM near)) AS near
          FROM hashed)
        WHERE exact OR near""",
        "hashed",
    ),
)
def _(spark, sf_dir):
    return dedup.copies_across_splits(hashed_items(spark, sf_dir))
