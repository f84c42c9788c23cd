"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside; a table may have them as columns of its own.
CLASHES = "fp host path rule verdict size target taken piece start length quality kept spans base rank score block run at _row _id _text".split()


def documents(spark, rows):
    """(doc_id, text, lang, source) rows as `documents`, with clashing columns beside them."""
    full = [(i, t, l, s, len(t) if t is not None else None, *["x"] * len(CLASHES)) for i, t, l, s in rows]
    shape = "doc_id long, text string, lang string, source string, n_chars long, "
    return spark.createDataFrame(full, shape + ", ".join(f"`{c}` string" for c in CLASHES))


def pages(spark, rows):
    full = [(*r, *["x"] * len(CLASHES)) for r in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHES))


LONG = " ".join(f"word{i % 977} and so on," for i in range(20_000))
AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b\x0c\r ", None, None),
    (4, "one", "en", "b"),
    (4, "one", "en", "b"),
    (5, LONG, "en", None),
    (None, "no id here at all", "en", "b"),
    (6, "Two words\nTwo words\nand Über été ñ 漢字", "de", ""),
    (7, "a b c a b c a b c", None, "a"),
]


def rows(df):
    return [tuple(r) for r in df.collect()]
