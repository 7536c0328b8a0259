from callgrid.llm import urlfilter as U


def test_rules_list_and_odd_rows(spark):
    urls = [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12?x=1", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.org/", "x.org", "/", "org/", "allow"), ("http://x.org", "x.org", "", None, "allow"), ("ftp://b.com/fr/#t", "b.com", "/fr/", "com/fr/", "allow"),
        ("http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"), ("http://www.bad.net/p.html?utm_source=a#x", "www.bad.net", "/p.html", None, "block"), ("http://bad.net:80/p/", "bad.net:80", "/p/", None, "block"),
        ("http://bad.net/q", "bad.net", "/q", None, "allow"), ("http://bad.net/p?k=1&ref=z", "bad.net", "/p", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://bad.net/p", "bad.net", "/p", None, "block"),
    ]
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://bad.net/p",), ("http://bad.net/p",), (None,), ("junk",)], "url string")
    got = {r.page_id: r for r in U.judge_urls(df, listed).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == u[1:], u
    assert U.judge_urls(df.limit(0), listed).count() == 0
    assert {r.verdict for r in U.judge_urls(df.where("rule is null") if "rule" in df.columns else df, listed.limit(0)).collect()} == {"allow", "block"}


def test_bloom_and_join_equal_a_set(spark, monkeypatch):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('k', id % 1500) as key")
    keys = spark.range(0, 1500, 3).selectExpr("concat('k', id) as key")
    for small in (4 << 20, 0):  # broadcast blocks, or a shuffled probe
        monkeypatch.setattr(U, "BROADCAST_BYTES", small)
        got = U.listed(pages, keys).collect()
        assert len(got) == 3000 and all(r.listed == (r.page_id % 1500 % 3 == 0) for r in got)


def test_equally_long_rules_repeated_rows_and_long_urls(spark, monkeypatch):
    rules = (("block", "b.com", "/x"), ("allow", "a.b.com", ""), ("allow", "b.com", "/x"), ("block", "com", "/x/y/"))
    long = "http://q.net/" + "z" * 200_000
    rows = [(1, "http://a.b.com/x"), (2, "http://b.com/x/y/"), (3, long), (4, long + "1"), (None, long), (1, "http://a.b.com/x")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for bound in (U.LIST_BYTES, 0):  # a broadcast list, or a shuffled hash join
        monkeypatch.setattr(U, "LIST_BYTES", bound)
        got = sorted((r.page_id or 0, r.rule, r.verdict) for r in U.judge_urls(df, df.where("page_id = 3").select("url"), rules).collect())
        # a.b.com and b.com/x are 7 letters each: the first in order; com/x/y/ is longer
        assert got == [(0, None, "block"), (1, "b.com/x", "block"), (1, "b.com/x", "block"), (2, "com/x/y/", "block"), (3, None, "block"), (4, None, "allow")]
