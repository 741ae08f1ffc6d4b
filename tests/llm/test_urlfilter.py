from momentrank.llm import urlfilter

from .oracle import same


def test_matches_sql(spark, sf):
    same(spark, urlfilter.op4_urlfilter, urlfilter.OP4_SQL, sf)


def brute(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_nested_rules_and_odd_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("a.example.com", "/en/x", "allow"), ("net", "", "block"),
             ("example.com", "/en/", "allow"), ("le.com", "/", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/", "x://a.example.com/en/x?y=://z", "x://b.a.example.com/en/x#q",
            "x://notexample.com/en/", "x://example.com", "x://net?x/", "x://deep.er.net#/es", "x://ÉA.com/é", "x://le.com/", "x://a..com/",
            "x://example.com./en/", "x://a.example.com/\n/en"] + ["x://hot.example.com/en/1"] * 200
    rows = [(i if i % 9 else None, u, "z") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urlfilter.judged(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = [(i, *brute(u, rules)) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    rules = spark.createDataFrame(list(urlfilter.RULES), "host string, path string, verdict string")
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
