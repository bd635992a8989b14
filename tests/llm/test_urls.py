"""Url filters against a plain loop over all rules."""

from __future__ import annotations

import random
import re

import pytest

from tessera.llm import url_filter
from tessera.llm.url_filter import LOWER, UPPER

RULES = [
    ("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("a.net", "/p", "block"), ("a.net", "/page1", "allow"),
    ("a.net", "/x/y/z", "block"), ("a.net", "/x/y/z", "allow"), ("org", "/" + "d/" * 40, "block"), ("org", "/" + "q" * 5000, "block"), ("org", "/" + "q" * 5001, "allow"), ("org", "/" + "e" * 300, "block"),
    (".".join("abcdefghijklmnopqrstuv") + ".io", "/", "block"), ("io", "/", "allow"), ("x.com:80", "/", "block"), ("bb.a.com", "/", "block"), ("a.com", "/b/c", "allow"),
    (None, "/", "block"), ("com", None, "block"), ("de", "nonsense", "block"), ("fr", "/", None), ("ß.eu", "/ü/", "block"),
]
URLS = [
    None, "", "://", "http://", "no scheme.com/en/", "http://com", "http://com/", "HTTP://WWW.EXAMPLE.COM/en/1?x#y", "http://www.example.com/EN/1", "http://m.example.com/en/", "http://example.com/en", "http://example.com?/en/",
    "http://b.net/es/1", "http://b.net#/es/", "http://a.net/p", "http://a.net/page1/", "http://c.a.net/page12", "http://a.net/x/y/zz", "http://x.org/" + "d/" * 41, "http://x.org/" + "d/" * 39, "http://x.org/" + "q" * 5000, "http://x.org/" + "q" * 6000,
    "http://x.org/" + "e" * 299, "http://x.org/" + "e" * 301, "http://z." + ".".join("abcdefghijklmnopqrstuv") + ".io/", "http://" + ".".join("bcdefghijklmnopqrstuv") + ".io/", "http://x.com:80/", "http://x.com/", "http://bb.a.com/b/c",
    "http://.com/", "http://com./", "http://Ä.com/", "http://x.ß.eu/ü/ü", "ftp://a://b.net/es/", "http://x.de/nonsense", "http://u@x.fr/", "http://x.com/\n/", "http://" + "l." * 3000 + "com/" + "s/" * 3000,
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = host.translate(str.maketrans(UPPER, LOWER))
    found = []
    for h, p, action in rules:
        if h is None or action is None or (p and not p.startswith("/")):
            continue
        h, p = h.translate(str.maketrans(UPPER, LOWER)), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            found.append((len(h + p), len(h), action == "block", h + p))
    best = max(found, default=None)
    return host, path, best and best[3], "allow" if not best or not best[2] else "block"


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_every_rule_and_url(spark, broadcast_bytes):
    rng = random.Random(5)
    made = [f"http://{'.'.join(rng.choices(['a', 'b', 'example', 'net', 'com'], k=rng.randint(1, 4)))}/{'/'.join(rng.choices(['en', 'p', 'x', 'y'], k=rng.randint(0, 3)))}" for _ in range(150)]
    urls = URLS + made + ["http://b.net/es/1"] * 200
    rows = [(i % 50 or None, u, "r", "v", i) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, verdict string, `a.b` int").repartition(3)
    told = url_filter.rules(spark, RULES)
    got = url_filter.judge(pages, told, broadcast_bytes=broadcast_bytes)
    assert got.columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict"]
    want = {i: (i % 50 or None, u, i, *plain(u, RULES)) for i, u in enumerate(urls)}
    assert {r[2]: tuple(r) for r in got.collect()} == want
    kept = url_filter.allowed(pages, told, broadcast_bytes=broadcast_bytes)
    assert kept.columns == pages.columns
    assert sorted(r[4] for r in kept.collect()) == [i for i, w in want.items() if w[-1] == "allow"]


def test_empty_tables_and_defaults(spark):
    told, none = url_filter.rules(spark, RULES), spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.judge(none, told).count() == 0
    page = spark.createDataFrame([(1, "http://x.zz/"), (None, None)], none.schema)
    got = url_filter.judge(page, told.where("false"), default="block").collect()
    assert sorted((r.host, r.rule, r.verdict) for r in got) == [("", None, "block"), ("x.zz", None, "block")]
    with pytest.raises(ValueError):
        url_filter.judge(page, told, default="maybe")


def test_shapes_are_bounded(spark):
    """Thousands of rules of one host are told apart by their digests, not by one key."""
    told = url_filter.rules(spark, [("a.com", f"/page{i}", "block") for i in range(3000)] + [("a.com", "/p", "allow")])
    shapes = url_filter._prepared(told).select("d", "s", "c").distinct().count()
    assert shapes == 5 and url_filter._prepared(told).groupBy("short").count().agg({"count": "max"}).first()[0] == 1
    pages = spark.createDataFrame([(1, "http://w.a.com/page2999?x"), (2, "http://a.com/pag"), (3, "http://a.com/page30")], "page_id bigint, url string")
    assert sorted((r.page_id, r.rule) for r in url_filter.judge(pages, told).collect()) == [(1, "a.com/page2999"), (2, "a.com/p"), (3, "a.com/page30")]
