import random

import pytest

from parlance.llm import url_filter as uf
from parlance.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string"
RULES = "host string, path string, action string"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [
        r for r in rules
        if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])
    ]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block", r[0] + r[1]))
    return host, path, best[0] + best[1], best[2]


URLS = [
    "http://example.org/en/1", "https://WWW.Example.ORG/es/?q#f", "x://org", "x://org/", "http://a.com/fr/x",
    "http://a.com/frx", "http://badexample.org/es/", None, "", "no scheme", "http://", "http:///es/", "a://b://org/x",
    "http://example.org?x=/es/", "http://example.org#/es/", "http://ÉX.org/é", "http://com/de/", "http://x.com./de/",
    "http://a..org/x", "http://" + "a." * 400 + "org/" + "p/" * 4000, "line\nhttp://b.org/\nx",
]


def run(spark, urls, rules, **kw):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    got = uf.filter_urls(pages, spark.createDataFrame(rules, RULES), **kw).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


@pytest.mark.parametrize("bound", [uf.BROADCAST_RULES, 0])
def test_matches_brute_force(spark, monkeypatch, bound):
    """Broadcast, and joined by shuffle with salts."""
    monkeypatch.setattr(uf, "BROADCAST_RULES", bound)
    assert run(spark, URLS, URL_RULES) == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}
    rng = random.Random(4)
    hosts = ["a", "b.a", "c.b.a", "d.a", "é.a"]
    rules = list({(rng.choice(hosts), "/" + "xy"[: rng.randint(0, 2)], rng.choice(["allow", "block"])) for _ in range(12)})
    urls = [f"h://{rng.choice(['', 'z.', 'b.'])}{rng.choice(hosts)}/{rng.choice(['x', 'xy', 'y', ''])}" for _ in range(80)]
    assert run(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_short_prefixes_are_confirmed_by_the_full_digest(spark):
    """With one hex digit the join meets many wrong rules; none may decide."""
    assert run(spark, URLS, URL_RULES, prefix_hex=1) == {i: brute(u, URL_RULES) for i, u in enumerate(URLS)}


def test_hard_rows(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.org/", None, 1), (1, "http://a.org/", None, 1), (None, None, None, 2)],
        PAGES + ", r_host int",
    )
    rules = spark.createDataFrame(URL_RULES, RULES)
    got = sorted(map(str, uf.filter_urls(pages, rules).collect()))
    assert len(got) == 3 and got[0] == got[1]
    assert uf.filter_urls(pages.limit(0), rules).collect() == []
    none = uf.filter_urls(pages, rules.limit(0), default="block").collect()
    assert {r["verdict"] for r in none} == {"block"} and len(none) == 3


@pytest.mark.parametrize("bound", [uf.BROADCAST_RULES, 0])
def test_joined_on_the_short_prefix_alone(spark, monkeypatch, bound):
    monkeypatch.setattr(uf, "BROADCAST_RULES", bound)
    pages = spark.createDataFrame([(1, "http://a.example.org/es/1")], "page_id bigint, url string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    plan = uf.filter_urls(pages, rules)._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join LeftOuter" in x)
    assert "u_prefix" in join and "digest" not in join
