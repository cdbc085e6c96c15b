"""URL verdicts against a brute-force version, with aliases near and far."""

import random

import pytest

from trendloom.llm import urlfilter
from trendloom.llm.queries import URL_RULES

from .brute import components

SCHEMA = "page_id long, url string, html string, host string, rule string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]


def brute_rule(url):
    host, path = parts(url)
    fits = [(len(r), v == "allow", r, v) for v, r in URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[2:] if fits else (None, None)


def test_rules(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    urls = [pick("http", "HTTPS", "") + pick("://", ":/", "://") + pick("a.", "", "EXAMPLE.") + pick("example.", "xexample.", "") + pick("com", "net", "org", "COM") + pick("/", "?", "#", "") + pick("en/", "de/", "es/", "EN/") + pick("7", "8", "", "7/8?x=://y") for _ in range(300)] + [None, "", "://", "a://b://c/d\ne?f"]
    rows = spark.createDataFrame([(i, u, None, "z", "z") for i, u in enumerate(urls)], SCHEMA)
    for r in urlfilter.judge_urls(rows, URL_RULES).collect():
        url = urls[r["page_id"]]
        rule, verdict = brute_rule(url)
        assert (r["host"], r["path"]) == parts(url) and r["rule"] == rule and r["verdict"] == (verdict or "allow"), url


def test_aliases(spark):
    link = lambda u: f'<head><LINK href="{u}" REL=canonical></head>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; URL={u}'>"
    pages = [
        (1, "http://q.xyz/a", link("http://x.com/en/1")), (2, "http://q.xyz/b", refresh("/a")), (3, "http://q.xyz/c?x=1#f", link("b")), (4, "http://sub.net/de/9", link("http://q.xyz/a")),
        (5, "http://free.xyz/", link("http://other.xyz/")), (6, "http://q.xyz/a", None), (7, "http://q.xyz/z", "<link rel=stylesheet href='http://x.com/en/1'>"), (8, None, link("http://x.com/en/1")), (9, "http://free.xyz/d/e", link("../../n")), (10, "http://free.xyz/n", None),
    ]
    redirects = spark.createDataFrame([("http://free.xyz/n#x", "HTTP://Q.xyz/c?x=1"), (None, "http://x.com/en/1")], "src string, dst string")
    rows = spark.createDataFrame([(*p, "z", "z") for p in pages], SCHEMA)
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(rows, URL_RULES, redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    assert urlfilter.judge_urls(rows.limit(0), URL_RULES).count() == 0


def test_random_alias_graphs(spark):
    rng = random.Random(9)
    urls = [f"http://h{i}.xyz/p" for i in range(80)] + [f"http://x.com/en/{i}" for i in range(4)]
    edges = [(rng.randrange(80), rng.randrange(84)) for _ in range(60)]
    rows = spark.createDataFrame([(i, u, None, "z", "z") for i, u in enumerate(urls)], SCHEMA)
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(rows, URL_RULES, redirects=spark.createDataFrame([(urls[a], urls[b]) for a, b in edges], "src string, dst string")).collect()}
    c = components(range(84), edges)
    blocked = {c[i] for i in range(80, 84)}
    assert got == {i: "block" if c[i] in blocked else "allow" for i in range(84)}


def test_relative_links_resolve_as_the_library_does(spark):
    from urllib.parse import urljoin

    rng = random.Random(2)
    pages = [f"http://h{i}.xyz" + "".join("/" + rng.choice("abc") for _ in range(rng.randrange(0, 7))) + rng.choice(["", "/", "?q=../x", "/p?a/../b"]) for i in range(150)]
    hrefs = ["../" * rng.randrange(0, 11) + rng.choice(["en/8", "x", "./y", "z/..", "z/.", "w/../v/./u?k=/../j", "m/../../n", ".."]) for _ in pages]
    hrefs[:20] = ["/" + h for h in hrefs[:20]]
    rows = spark.createDataFrame([(i, u, f'<link rel="canonical" href="{h}"><!-- <link rel=canonical href="http://x.com/en/1"> -->', "z", "z") for i, (u, h) in enumerate(zip(pages, hrefs))], SCHEMA)
    got = {r["src"]: r["dst"] for r in urlfilter.alias_edges(rows, "url", "html").collect()}
    assert len(got) == len(pages)
    for u, h in zip(pages, hrefs):
        assert got[u] == urljoin(u, h), (u, h)


def test_block_above_the_root(spark):
    pages = [(1, "http://a.net/a/b/c/p", '<link rel=canonical href="../../../en/8">'), (2, "http://a.net/en/8", '<link rel=canonical href="http://x.org/es/1">'), (3, "http://a.net/a/b/c/q", '<!-- <link rel=canonical href="../../../en/8">')]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(spark.createDataFrame([(*p, "z", "z") for p in pages], SCHEMA), URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


@pytest.mark.parametrize("many", [0, 5000])
def test_rule_tables_equal_literal_rules(spark, many):
    """The same rules as a literal, as a table, and among thousands of others; hosts and paths of every shape."""
    rng = random.Random(7)
    names = ["com", "example.com", "a.example.com", "net", "example.net.", "", "x..y", "localhost"]
    paths = ["/", "/en/", "/en/7", "", "/e", "/en/7/8", "//", "/é"]
    rules = [(v, n + p) for v, n, p in ((rng.choice(["allow", "block"]), rng.choice(names), rng.choice(paths)) for _ in range(60)) if "/" in p]
    urls = [f"http://{rng.choice(['', 'b.', 'a.', '.'])}{rng.choice(names)}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}" for _ in range(300)] + [None, "no url", "http://a.com/" + "x" * 3000, "http://" + "a." * 2000 + "com/en/7"]
    rows = spark.createDataFrame([(i, u, None, "z", "z") for i, u in enumerate(urls)], SCHEMA)
    want = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(rows, rules).collect()}
    other = [("block", f"host{i}.org/p{i}") for i in range(many)]
    for given in (rules + other, urlfilter.rule_table(spark, rules + other)):
        assert want == {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(rows, given).collect()}
    hit = spark.createDataFrame([(1, "http://sub.host77.org/p77/x", None, "z", "z")], SCHEMA)
    if many:
        assert urlfilter.judge_urls(hit, rules + other).first()["rule"] == "host77.org/p77"


def test_no_rules(spark):
    rows = spark.createDataFrame([(1, "http://a.com/", None, "z", "z"), (2, None, None, "z", "z")], SCHEMA)
    for rules in ([], urlfilter.rule_table(spark, [("block", "x/")]).limit(0)):
        assert {(r["rule"], r["verdict"]) for r in urlfilter.judge_urls(rows, rules).collect()} == {(None, "allow")}
