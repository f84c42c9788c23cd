from helpers import pages, rows

from itemlab.llm.url_filters import judge_urls, rules_from

RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.net", "/en/a", "block"),
    ("m.example.net", "", "allow"),
    ("Example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
    ("é.org", "/\U0001f600", "block"),
]
URLS = [
    None,
    "",
    "no scheme/net/",
    "http://a.net",
    "http://a.net/",
    "HTTPS://Deep.A.NET/x?q#f",
    "http://example.net/en/",
    "http://www.example.net/en/page?x=1",
    "http://example.net/en/abc",
    "http://m.example.net",
    "http://x.m.example.net/de/",
    "http://notexample.net/en/",
    "http://example.com/de/1",
    "http://example.com/de",
    "http://badexample.com/de/1",
    "http://a.org/fr/ÿ",
    "http://é.org/\U0001f600x",
    "http://é.org/\U0001f601",
    "http://é.org/fr/://y",
    "http://..net/",
    "http:///only/path",
    "http://a.net/line\nbreak#x",
    "http://" + "s." * 60 + "org/fr/" + "p" * 3000,
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [
        (len(h + p), h + p, a)
        for h, p, a in ((h.lower(), p, a) for h, p, a in rules)
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    table = pages(spark, [(i, u, None) for i, u in enumerate(URLS)])
    found = {r[0]: r[1:] for r in rows(judge_urls(table, rules_from(spark, RULES)))}
    assert found == {i: brute(u, RULES) for i, u in enumerate(URLS)}


def test_many_ranges_and_repeated_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        urls = [f"http://h{i % 7}.example.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i % 5 % 3]}/{i % 11}" for i in range(600)]
        table = pages(spark, [(i % 90, u, "") for i, u in enumerate(urls)])
        found = rows(judge_urls(table, rules_from(spark, RULES)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(repr, found)) == sorted(repr((i % 90, *brute(u, RULES))) for i, u in enumerate(urls))


def test_contradicting_rules_block_and_none_allow(spark):
    table = pages(spark, [(1, "http://a.net/", None)])
    twice = rules_from(spark, [("net", "/", "allow"), ("net", "/", "block")])
    assert rows(judge_urls(table, twice)) == [(1, "a.net", "/", "net/", "block")]
    assert rows(judge_urls(table, twice.limit(0))) == [(1, "a.net", "/", None, "allow")]
    assert rows(judge_urls(table.limit(0), twice)) == []
