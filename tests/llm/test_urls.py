import random

import pytest

from panelscope.llm.queries import URL_RULES
from panelscope.llm.url_filter import url_filter


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, rule in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(rule), len(h), rule)
            best = max(best, (key, rule, verdict)) if best else (key, rule, verdict)
    return host, path, best and best[1], best[2] if best else default


URLS = [
    None, "", "no scheme.net/", "http://", "http://net", "http://net/", "http://NET/x", "https://a.b.net/?q", "ftp://a.net#x",
    "http://example.net/en/1", "http://x.example.net/en", "http://example.com/de/", "http://notexample.com/de/", "http://org/fr/a?b",
    "http://x..org/fr/", "http://org.net/fr/", "x://y://z.net/a", "http://ÄB.net/\nq", "http://a.net:80/", "http://u@a.net/p",
]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, host int, rule string")


def test_verdicts_match_brute_force_with_clashing_columns(spark):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(frame(spark, URLS), URL_RULES).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("n", [1, 300])
def test_many_rules_and_false_positives(spark, n):
    random.seed(n)
    hosts = [f"h{i}.{random.choice(['com', 'net', 'org'])}" for i in range(n)]
    rules = sorted({(random.choice(["allow", "block"]), h + random.choice(["/", "/a", "/a/b/"])) for h in hosts}, key=lambda r: r[1])
    urls = [f"http://{random.choice(['', 'w.', 'w.v.'])}{random.choice(hosts)}{random.choice(['', '/', '/a', '/a/b/c', '/b'])}" for _ in range(500)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(frame(spark, urls), rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_edges(spark):
    assert url_filter(frame(spark, []), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter(frame(spark, URLS), []).collect()} == {"allow"}
    twice = spark.createDataFrame([(None, "http://a.net/"), (None, "http://a.net/")], "page_id long, url string")
    assert [r["rule"] for r in url_filter(twice, URL_RULES).collect()] == ["net/"] * 2
    with pytest.raises(Exception, match="a rule is"):
        url_filter(frame(spark, URLS), [("block", "net")]).collect()


def test_conflicting_rules_and_long_urls(spark):
    for rules in ([("block", "a.net/"), ("allow", "a.net/"), ("allow", "A.net/")], [("allow", "a.net/"), ("block", "a.net/")]):
        assert [r["verdict"] for r in url_filter(frame(spark, ["http://a.net/x"]), rules).collect()] == ["block"]
    urls = [f"http://{'l.' * 20_000}example.net/{'p/' * 50_000}", f"http://{'x' * 100_000}.org/fr/{'y' * 100_000}?q", "http://" + "." * 3000]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(frame(spark, urls), URL_RULES).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(urls)}
