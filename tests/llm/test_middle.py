"""Fill-in-the-middle against a plain loop over tokens."""

import hashlib
import re

from helpers import AWKWARD, documents
from itemlab.llm import middle
from itemlab.llm.queries import registry
from oracle import compare, connect
from pyspark.sql import functions as F

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(id, text):
    """(n, form, prefix_chars, middle_chars, output) by counting tokens one after the other."""
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text or "")
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def check(spark, table):
    docs = documents(spark, table)
    found = middle.fill_in_middle(docs).withColumn("back", middle.restore(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(((i, *plain(i, t), t or "") for i, t, *_ in table), key=str)
    return got


def test_awkward_rows(spark):
    check(spark, AWKWARD)


def test_many_ids_over_texts_with_odd_characters(spark):
    texts = ["aB1 é\U0001f600x\n\r\tzz", "<P", "P>x<S<M", "a<P>b", "<S>", "$1 \\1 \\Q {2}+", "x", "\x00 \u0085y", "<", "aa bb cc dd"]
    got = check(spark, [(i, texts[i % len(texts)], "en", "a") for i in range(600)])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_marks_that_only_arise_at_the_seams(spark):
    """A part may end in a piece of a mark without being taken for one."""
    check(spark, [(i, "<P S><M <S P> <" * 3, "en", "a") for i in range(200)])


def test_a_very_long_text(spark):
    """Possessive groups neither go back nor nest, so a long text does not exhaust the stack."""
    check(spark, [(i, "word, " * 150_000 + "\U0001f600é" * 50_000, "en", "a") for i in (1, 2, 3)])


def test_empty_table(spark):
    assert middle.fill_in_middle(documents(spark, [])).count() == 0


def test_names_with_dots(spark):
    docs = documents(spark, AWKWARD).withColumnsRenamed({"doc_id": "a.id", "text": "a.text"}).withColumn("x.y", F.lit(1))
    found = middle.fill_in_middle(docs, "a.id", "a.text")
    assert found.columns[0] == "a.id" and found.count() == len(AWKWARD)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op11_fill_in_middle"
    assert compare(registry.functions[name](spark, sf), connect(sf), registry.sql[name]) == ""
