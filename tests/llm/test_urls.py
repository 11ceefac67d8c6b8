from keelson.llm import urls as U


def table(spark, *urls):
    return spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string").withColumnRenamed("host", "rule")


def test_parts_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/1?x=/fr/#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://b.www.example.com/en/p#q?": ("b.www.example.com", "/en/p", "www.example.com/en/", "allow"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://d.net/es/": ("d.net", "/es/", "net/es/", "block"),
        "http://d.net/es": ("d.net", "/es", None, None),
        "http://com?q": ("com", "", None, None),
        "http://h.org#f://net/es/": ("h.org", "", None, None),
        "no scheme.com/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    got = U.ruled(U.parts(table(spark, *cases).select("page_id", "url")), U.RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.rule_verdict) for r in got] == list(cases.values())


def test_features(spark):
    r = U.lexical(U.parts(table(spark, "https://www.a-1.org/x/y2.html?a=1&b=2#t").select("page_id", "url"))).first()
    assert (r.depth, r.params, r.hyphens, r.host_digits, r.has_fragment, r.has_extension, r.secure, r.www, r.suffix) == (2, 2, 1, 1, True, True, True, True, "org")
    assert abs(r.digit_ratio - 4 / 39) < 1e-9 and 3 < r.entropy < 5


def test_trees_learn_from_labels(spark):
    good = [f"https://site{k % 7}.com/story/{k}" for k in range(120)]
    bad = [f"http://cheap-pills-{k}x{k * 7919}.net/es/{k}{k * 31}/?a={k}&b={k}&c=1" for k in range(120)]
    unseen = ["https://site9.org/story/77", "http://win-cash-99x8.org/q/123456/?a=1&b=2&c=3"]
    out = U.judge(table(spark, *good, *bad, *unseen), U.RULES)
    assert {(r.page_id, r.verdict) for r in out.filter("rule IS NULL").collect()} == {(240, "allow"), (241, "block")}
    assert out.filter("rule IS NOT NULL").groupBy("verdict").count().collect() and out.count() == 242


def test_without_labels(spark):
    none = U.judge(table(spark, "http://a.org/", None), U.RULES).collect()
    assert [r.verdict for r in none] == ["allow", "allow"]
    one = U.judge(table(spark, "http://a.net/es/", "http://a.org/"), U.RULES).collect()
    assert [r.verdict for r in one] == ["block", "block"]
    assert U.judge(table(spark, "http://a.org/").limit(0), U.RULES).collect() == []
