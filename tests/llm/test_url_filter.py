from cropframe.llm import url_filter as U

URLS = ["http://example.com/en/1", "HTTPS://www.Example.COM/en/x?q=/fr/", "ftp://a.net/es/", "http://net/fr/", None, "",
        "no scheme", "http://", "http://com", "http://com/", "http://x.com#/en/", "http://notexample.com/en/1",
        "http://example.com/english", "http://example.com/EN/1", "http://example.com:80/en/", "a://b.net/fr/x\ny",
        "http://www.example.com/en/", "x://y://z.com/p", "http://a.example.com/en/?x"]
RULES = [*U.RULES, ("example.com", "/en", "allow"), ("", "/only", "block"), ("b.net", "", "block")]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def check(spark, rules, urls):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = U.judge(pages, spark.createDataFrame(rules, U.RULE_SCHEMA)).collect()
    want = [(i, *brute(u, rules)) for i, u in enumerate(urls)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_contract_rules(spark):
    check(spark, U.RULES, URLS + URLS[:3])


def test_partial_and_tokenless_rules(spark):
    check(spark, [r for r in RULES if r[0]], URLS)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string")
    assert [r.verdict for r in U.judge(pages, spark.createDataFrame([], U.RULE_SCHEMA)).collect()] == ["allow"]
    assert U.judge(pages.where("page_id > 5"), U.contract_rules(spark)).count() == 0
