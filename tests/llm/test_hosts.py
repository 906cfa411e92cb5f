from tracelake.llm import hosts
from tracelake.llm.queries import RULES

PAGES = "page_id long, url string, html string, host string"
LABELS = "doc_id long, quality int, toxic int"


def judged(spark, urls, labels=()):
    pages = spark.createDataFrame([(k, u, None, "clash") for k, u in enumerate(urls)], PAGES)
    return {r.page_id: r for r in hosts.judge(pages, spark.createDataFrame(list(labels), LABELS), RULES).collect()}


def test_rules_and_parts(spark):
    urls = [
        "http://A.Example.COM/en/1?x=/y#z", "https://www.example.com/en/2", "http://x.www.example.com/en/", "http://b.com/fr/1", "http://b.com",
        "http://b.net/es/3", "http://b.net/fr", "http://notnet/fr/1", "http://b.org/a//b?q", None, "no scheme", "x://", "http://evil.com.org/en/", "a://b://c/d",
    ]
    got = judged(spark, urls)
    assert len(got) == len(urls)
    assert [(got[k].host, got[k].path) for k in (0, 4, 8, 9, 10, 11, 13)] == [("a.example.com", "/en/1"), ("b.com", ""), ("b.org", "/a//b"), ("", ""), ("", ""), ("", ""), ("b:", "//c/d")]
    assert [got[k].rule for k in range(9)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", None, "net/es/", None, None, None]
    assert [got[k].verdict for k in (0, 1, 2, 3, 5)] == ["block", "allow", "allow", "allow", "block"] and got[12].rule is None


def test_reputation_is_shrunk_and_blocks_only_on_evidence(spark):
    urls, labels, doc = [], [], 0
    for host, n, bad in (("bad.evil.org", 60, 55), ("new.evil.org", 1, 1), ("good.fine.org", 80, 4), ("one.fine.org", 1, 1), ("x.co.uk", 3, 0)):
        for k in range(n):
            urls.append(f"http://{host}/{doc}.html")
            labels.append((doc, 0 if k < bad else 1, 0))
            doc += 1
    got = judged(spark, urls, labels)
    by_host = {r.host: r for r in got.values()}
    assert by_host["bad.evil.org"].verdict == "block" and by_host["good.fine.org"].verdict == "allow" and by_host["one.fine.org"].verdict == "allow"
    assert by_host["new.evil.org"].bad_rate > by_host["one.fine.org"].bad_rate
    assert all(r.bad_bound < r.bad_rate < 1 for r in got.values())


def test_levels(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("u@w.x.com:80",), ("local",), ("",)], "host string")
    assert [(r.domain, r.suffix) for r in hosts.with_levels(rows).collect()] == [("b.co.uk", "co.uk"), ("x.com", "com"), ("local", "local"), ("", "")]


def test_edges(spark):
    assert judged(spark, []) == {}
    got = judged(spark, ["http://a.org/1", "http://a.org/2", "http://a.org/2", None], [(1, None, None), (1, 1, None), (1, None, 1), (None, 1, 1)])
    assert len(got) == 4 and {r.verdict for r in got.values()} == {"allow"} and round(got[0].bad_rate, 4) == 0.6667
    assert judged(spark, ["http://a.org/99999999999999999999999"])[0].verdict == "allow"
