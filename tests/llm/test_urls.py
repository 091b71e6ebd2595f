from barograph.llm import urls as U


def test_verdicts(spark):
    rows = [
        ("https://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://EXAMPLE.net", "example.net", "", None, "allow"),
        ("http://casino.net/x", "casino.net", "/x", "net/", "block"),
        ("http://example.com/de/x?q#f", "example.com", "/de/x", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://b.org/fr/?x", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://x.com/casino-win", "x.com", "/casino-win", None, "block"),
        ("http://x.com/casinos", "x.com", "/casinos", None, "allow"),
        ("http://free.x.com/free", "free.x.com", "/free", None, "allow"),
        ("http://free.x.com/ads", "free.x.com", "/ads", None, "block"),
        ("no scheme free ads", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://?q", "", "", None, "allow"), ("x://h\n.org/fr/é", "h\n.org", "/fr/é", "org/fr/", "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(rows)], "page_id long, url string, verdict string")
    got = sorted(U.filter_urls(pages).collect(), key=lambda r: r.page_id)
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in got] == rows
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_weights_escapes_and_odd_rows(spark):
    rows = [
        (1, "http://x.com/buy/deal", "allow"), (2, "http://x.com/buy/deal/offer/promo", "block"), (3, "http://x.com/sex/click", "block"), (4, "http://x.com/sexy", "allow"), (5, "http://x.com/p%6Frn", "block"),
        (6, "http://x.com/%ffporn", "allow"), (7, "http://x.com/%C3%A9porn", "allow"), (8, "http://x.com/100%-porn", "block"), (None, "http://x.com/free-ads", "block"), (None, "http://x.com/free-ads", "block"),
        (9, "http://x.com/" + "a" * 1_000_000 + "/porn", "block"), (10, "http://x.com/free/free/free", "allow"),
    ]
    got = U.filter_urls(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")).collect()
    assert sorted((str(r.page_id), r.url, r.verdict) for r in got) == sorted((str(a), b, c) for a, b, c in rows)


def test_sql_agrees(spark):
    import duckdb

    urls = ["http://x.com/buy/deal/offer/promo", "http://x.com/p%6Frn", "http://x.com/%ffporn", "HTTP://FREE.x.com/Ads", "http://a.net/win", None, "", "x://example.net/en/porn", "http://x.org/100%-porn?free"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(U.OP3_SQL).fetchall()
    got = U.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([(" Foo ", 1.5, False), ("bar", None, False), ("baz", 1.0, True), ("foo", 0.5, False), ("", 1.0, True), (None, 1.0, True)], "term string, weight double, strict boolean")
    strict, soft = U.vocabulary(table)
    assert (strict, soft) == (("baz",), {"foo": 1.5, "bar": 1.0})
    pages = spark.createDataFrame([(1, "http://a.com/foo/bar"), (2, "http://a.com/foo"), (3, "http://a.com/baz")], "page_id long, url string")
    assert [r.verdict for r in U.filter_urls(pages, strict=strict, soft=soft).orderBy("page_id").collect()] == ["block", "allow", "block"]
    assert {r.verdict for r in U.filter_urls(pages, strict=(), soft={}).collect()} == {"allow"}
