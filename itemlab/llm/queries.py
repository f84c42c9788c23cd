"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemlab.llm import (
    compression,
    html_text,
    langid,
    middle,
    mixing,
    packing,
    quality,
    secrets,
    simhash,
    spelling,
    topk,
    url_filters,
    warc,
)
from itemlab.llm.common import table
from itemlab.queries import Registry

registry = Registry()
query = registry.query

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op1_url_filters",
    f"""WITH parts AS (
      SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    rules(h, p, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
    fits AS (
      SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
      FROM (SELECT DISTINCT host, path FROM parts) d JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
    FROM parts LEFT JOIN fits USING (host, path)""",
)
def _(spark, sf_dir):
    rules = url_filters.rules_from(spark, URL_RULES)
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op2_simhash")
def _(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        simhash.hex_fingerprint().alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op3_packing")
def _(spark, sf_dir):
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op4_mixing")
def _(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_quality")
def _(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"))


@query("op6_secrets")
def _(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query(
    "op7_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS f FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (1 + 5 * (k // 4))::INT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
      CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> f THEN f END AS refers_to FROM d""",
)
def _(spark, sf_dir):
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query(
    "op8_top_k",
    """WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    WHERE rank <= 20""",
)
def _(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_html_text")
def _(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_language")
def _(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query(
    "op11_fill_in_middle",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
    u AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') END AS units,
      ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
      ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
    c AS (SELECT doc_id, t, len(units) AS n, units, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
      greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
      CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT doc_id, t, n, form, array_to_string(list_slice(units, 1, a), '') AS x,
      CASE WHEN b > a THEN array_to_string(list_slice(units, a + 1, b), '') ELSE '' END AS y,
      CASE WHEN n > b THEN array_to_string(list_slice(units, b + 1, n), '') ELSE '' END AS z FROM c)
    SELECT doc_id, n::BIGINT AS n, form,
      CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
        WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE t END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM p""",
)
def _(spark, sf_dir):
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = middle.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


@query("op12_spelling_variants")
def _(spark, sf_dir):
    found = spelling.group_spellings(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_quality_classifier")
def _(spark, sf_dir):
    return compression.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
