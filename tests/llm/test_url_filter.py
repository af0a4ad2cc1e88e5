import re

from gaugelake.llm import url_filter as op


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in op.RULES:
        own, below = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "http://ORG/", "https://a.org", "https://a.org/x", "https://example.org/es/1", "https://www.Example.org/es/",
    "https://notexample.org/es/1", "https://example.org/en/1", "https://example.org/en/12?x=1", "https://example.org/en/2", "x://a.com/fr/b#c",
    "x://com/de/", "x://.com/de/", "x://a.com/DE/1", "http://a.net/b://c.org/d", "http://a.com?/fr/", "http://a.com#/fr/", "mailto:a@b.org",
    "https://É.com/fr/é\nb", "http://a.com//fr/", "http://b.net/?a=1&b=2", "http://a.com:80/fr/",
]


def test_rules_and_parts(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)] + [(None, URLS[5])] + [(100 + i, f"https://s{i}.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "'q' as host", "1 as text", "2 as part", "3 as features")
    out = op.judged(pages).collect()
    assert len(out) == len(rows)
    urls = dict(rows)
    free = {}
    for r in out:
        host, path, best = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]), urls[r.page_id]
        assert r.verdict in ("allow", "block") and (best is None or r.verdict == best[1])
        assert free.setdefault(urls[r.page_id], r.verdict) == r.verdict


def test_trees_learn_from_rule_labels(spark):
    rows = [(i, f"https://h{i}.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(300)] + [(1000 + i, f"https://h{i}.info/{'fr' if i % 2 else 'de'}/{i}") for i in range(40)]
    out = op.judged(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert sum(r.rule is None and r.verdict == ("allow" if r.page_id % 2 else "block") for r in out) >= 38


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "https://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r.rule, r.verdict) for r in op.judged(pages).collect()} == {(None, "allow")}
    assert op.judged(pages.limit(0)).collect() == []
