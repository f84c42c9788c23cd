import base64
import hashlib

from helpers import pages, rows

from itemlab.llm import warc
from itemlab.plans.staging import scratch_path


def record(kind, name, payload, digest="X"):
    body = payload.encode()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}:{digest}>\r\nContent-Length: {len(body)}\r\n\r\n"
    return head + payload + "\r\n\r\n"


NESTED = "before " + record("response", 77, "inner " + record("response", 78, "innermost")) + " after WARC/1.1\r\n"
HTML = [
    (1, "http://a/1", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, "http://a/3\r\nWARC-Type: x", "é漢\U0001f642\r\n\r\n"),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", NESTED),
    (7, "u", "WARC/1.1\r\n" * 50),
    (8, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"),
    (9, "u", "x" * 3_000_000),
    (None, "u", "<p>one</p>"),
    (None, "u", "nobody"),
    (10, "u", NESTED),
]


def want(table):
    groups = {}
    for i, (page, _, html) in enumerate(table):
        groups.setdefault(html or "", []).append((page is None, page or 0, i))
    out = []
    for i, (page, _, html) in enumerate(table):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        none, first, own = min(groups[html or ""])
        rest = ("response", None) if own == i else ("revisit", None if none else first)
        out.append(repr((page, len(body), digest, *rest)))
    return sorted(out)


def test_round_trip(spark):
    table = pages(spark, HTML).repartition(1)
    assert sorted(map(repr, rows(warc.archive_pages(table)))) == want(HTML)


def test_round_trip_in_many_files_and_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        table = [(i, "u", HTML[i % len(HTML)][2] if i % 3 else f"page {i} " + "y" * (i * 7 % 900)) for i in range(300) if i % len(HTML) != 9]
        found = rows(warc.archive_pages(pages(spark, table).repartition(3)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(repr, found)) == want(table)


def test_least_size_and_empty_table(spark):
    found = {(r.page_id, r.record_type) for r in warc.archive_pages(pages(spark, HTML[:3] + [(5, "u", "long enough"), (6, "u", "long enough")]), min_bytes=11).collect()}
    assert found == {(1, "response"), (2, "response"), (5, "response"), (6, "revisit")}
    assert rows(warc.archive_pages(pages(spark, HTML[:1]).limit(0))) == []


def test_only_what_the_chain_reaches_is_a_record(spark):
    folder = scratch_path(spark, "warc-test")
    archive = "".join(record("response", i, NESTED if i % 4 == 0 else f"page {i}") for i in range(40))
    spark.createDataFrame([(archive.removesuffix("\r\n\r\n"),)], "value string").write.option("lineSep", "\r\n\r\n").text(folder)
    found = warc.candidates(spark, folder)
    records = warc.reachable(found)
    assert found.count() > 60
    names = sorted(int(r.record.split(":")[2]) for r in records.collect())
    assert names == list(range(40))
