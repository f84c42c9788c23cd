"""The SQL text of the derived inputs, as common table expressions for the oracle queries."""

from __future__ import annotations


def with_views(body: str, *views: str) -> str:
    """A query with the named views in front; a view brings the views it needs."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in views:
        add(name)
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    text = body.strip()
    start = "WITH RECURSIVE" if "reach" in needed else "WITH"
    if text.upper().startswith("WITH"):
        return f"{start} {head},\n{text[len('WITH'):]}"
    return f"{start} {head}\n{text}"


def rates(prefix: str = "") -> str:
    """The six rates over tp, fp, tn, fn; every 0/0 is 0."""
    tp, fp, tn, fn = (f"{prefix}{c}" for c in ("tp", "fp", "tn", "fn"))
    precision = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)"
    recall = f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    specificity = f"coalesce({tn} / nullif({tn} + {fp}, 0), 0)"
    return f"""{precision} AS precision, {recall} AS recall,
        coalesce(2 * ({precision}) * ({recall}) / nullif(({precision}) + ({recall}), 0), 0) AS f1,
        {specificity} AS specificity,
        ({tp} + {tn}) / ({tp} + {fp} + {tn} + {fn}) AS accuracy,
        (({recall}) + ({specificity})) / 2 AS balanced_accuracy"""


def counts(threshold: str, p: str = "p") -> str:
    return f"""count(*) FILTER (y = 1 AND {p} >= {threshold}) AS tp,
        count(*) FILTER (y <> 1 AND {p} >= {threshold}) AS fp,
        count(*) FILTER (y <> 1 AND NOT {p} >= {threshold}) AS tn,
        count(*) FILTER (y = 1 AND NOT {p} >= {threshold}) AS fn"""


def split_of(identity: str) -> str:
    digit = f"substr(md5(CAST({identity} AS VARCHAR)), 1, 1)"
    return f"CASE WHEN {digit} < 'b' THEN 'train' WHEN {digit} < 'd' THEN 'val' ELSE 'test' END"


def draw(seed: int | str, *parts: str) -> str:
    seed = f"'{seed}'" if isinstance(seed, int) else f"CAST({seed} AS VARCHAR)"
    joined = "".join(f" || '|' || CAST({p} AS VARCHAR)" for p in parts)
    return f"md5({seed}{joined})"


_ITEM_COLUMNS = """
  SELECT {id} AS id, {split} AS split, CAST({cls} AS VARCHAR) AS cls,
    {folder} || '/' || lpad(CAST({id} AS VARCHAR), 12, '0') || '/' || {folder} || '_'
      || CAST(len(string_split(text, chr(10))) AS VARCHAR) || '.txt' AS path,
    {folder} || '_' || CAST(len(string_split(text, chr(10))) AS VARCHAR) || '.txt' AS name,
    md5(text) AS md5, CAST(length(text) AS BIGINT) AS size,
    CAST(CASE WHEN length(text) >= 20
      THEN list_max(list_transform(string_split(text, chr(10)), lambda s: length(s))) ELSE 0 END AS INTEGER) AS w,
    CAST(CASE WHEN length(text) >= 20 THEN len(string_split(text, chr(10))) ELSE 0 END AS INTEGER) AS h,
    CASE WHEN length(text) < 20 THEN 'CORRUPT'
      WHEN length(text) <> strlen(text) THEN 'WIDE' ELSE 'ASCII' END AS mode,
    true AS loadable, {folder} AS grp
  FROM {source}
"""

_WORDS = "list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '')"

VIEWS = {
    "items": _ITEM_COLUMNS.format(
        id="doc_id", split=split_of("doc_id"), cls="lang", folder="source", source="documents"
    ),
    "labelled": _ITEM_COLUMNS.format(
        id="doc_id",
        split=split_of("doc_id"),
        cls="CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END",
        folder="source",
        source="documents JOIN labels USING (doc_id)",
    ),
    "preds": f"""
  SELECT doc_id AS id,
    CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN 'val' ELSE 'test' END AS split,
    quality AS y,
    floor(length(regexp_replace(text, '[^a-z ]', '', 'g')) / length(text) * 1e6) / 1e6 AS p,
    floor(len(list_distinct({_WORDS})) / len({_WORDS}) * 1e6) / 1e6 AS p2
  FROM documents JOIN labels USING (doc_id)
""",
    "line_preds": """
  SELECT CASE WHEN l_linestatus = 'O' THEN 'val' ELSE 'test' END AS split,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    floor(least((l_discount * 4 + l_tax * 3 + (l_extendedprice % 1000) / 2000) / 1.2::DOUBLE, 1.0::DOUBLE) * 1e6) / 1e6 AS p
  FROM lineitem
""",
    "cuts": """
  SELECT 5e-2::DOUBLE + i * 5e-2::DOUBLE AS t FROM range(19) r(i)
""",
    # One row per document with a word: the 256 bits as a list of 0/1, and as four words.
    "bucket_counts": f"""
  SELECT doc_id, b, count(*) AS n
  FROM (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 257 AS b
        FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents))
  GROUP BY ALL
""",
    "set_bits": """
  SELECT r.doc_id, r.b - 1 AS bit
  FROM bucket_counts r LEFT JOIN bucket_counts l ON l.doc_id = r.doc_id AND l.b = r.b - 1
  WHERE r.b >= 1 AND r.n > coalesce(l.n, 0)
""",
    "hash_words": """
  SELECT doc_id,
    coalesce(bit_or((1::UBIGINT) << (bit % 64)) FILTER (bit // 64 = 0), 0::UBIGINT) AS u0,
    coalesce(bit_or((1::UBIGINT) << (bit % 64)) FILTER (bit // 64 = 1), 0::UBIGINT) AS u1,
    coalesce(bit_or((1::UBIGINT) << (bit % 64)) FILTER (bit // 64 = 2), 0::UBIGINT) AS u2,
    coalesce(bit_or((1::UBIGINT) << (bit % 64)) FILTER (bit // 64 = 3), 0::UBIGINT) AS u3
  FROM set_bits GROUP BY doc_id
""",
    "hashed": """
  SELECT i.*, h.u0, h.u1, h.u2, h.u3 FROM items i LEFT JOIN hash_words h ON h.doc_id = i.id
""",
    "nodes": """
  SELECT min(id) AS node, count(*) AS copies, u0, u1, u2, u3
  FROM hashed WHERE u0 IS NOT NULL GROUP BY u0, u1, u2, u3
""",
}



def differing(a: str, b: str) -> str:
    """Hamming distance between the hash words of two aliased tables."""
    return "(" + " + ".join(f"CAST(bit_count(xor({a}.u{i}, {b}.u{i})) AS INTEGER)" for i in range(4)) + ")"


VIEWS["pairs"] = f"""
  SELECT a.node AS id_a, b.node AS id_b, CAST({differing('a', 'b')} AS INTEGER) AS bits,
    a.copies AS copies_a, b.copies AS copies_b
  FROM nodes a JOIN nodes b ON a.node < b.node WHERE {differing('a', 'b')} <= 25
"""
# The groups of near copies, from all node pairs; closed only together with WITH RECURSIVE.
VIEWS["reach"] = """
  SELECT node AS root, node FROM nodes
  UNION
  SELECT r.root, CASE WHEN p.id_a = r.node THEN p.id_b ELSE p.id_a END
  FROM reach r JOIN pairs p ON r.node = p.id_a OR r.node = p.id_b
"""
VIEWS["grouped"] = """
  SELECT h.*, g.component, count(*) OVER (PARTITION BY g.component) AS members
  FROM hashed h
  LEFT JOIN nodes n USING (u0, u1, u2, u3)
  LEFT JOIN (SELECT node, min(root) AS component FROM reach GROUP BY node) g ON g.node = n.node
"""

NEEDS = {
    "set_bits": ("bucket_counts",),
    "hash_words": ("set_bits",),
    "hashed": ("items", "hash_words"),
    "nodes": ("hashed",),
    "pairs": ("nodes",),
    "reach": ("pairs",),
    "grouped": ("reach",),
}
