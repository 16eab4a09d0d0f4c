from lorespark.llm import queries, urls
from tests import oracle


def test_equals_its_sql(spark, sf_dir):
    oracle.same(spark, oracle.connect(sf_dir), queries.op2_url_filter, queries.oracle_sql()["op2_url_filter"], sf_dir)


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/1?x=/y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net#top": ("example.net", "", None, None),
        "https://b.net/x": ("b.net", "/x", "net/", "block"),
        "x://example.com/de/7.html": ("example.com", "/de/7.html", "example.com/de/", "block"),
        "ftp://notexample.com/de/7": ("notexample.com", "/de/7", None, None),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://x.org?/fr/": ("x.org", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
    }
    pages = spark.createDataFrame([(i, u, "h", 5) for i, u in enumerate(cases)], "page_id long, url string, html string, verdict int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urls.judged_pages(pages, labels).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or "allow")


def test_impure_templates_are_blocked_and_variables_generalised(spark):
    pages = [(i, f"http://h.com/spam/{i}") for i in range(40)] + [(100 + i, f"http://h.com/good/{i}.html") for i in range(40)] + [(None, "http://h.com/spam/x"), (5, "http://h.com/spam/5")]
    labels = [(i, 0, 0) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)] + [(None, 0, 1)]
    made = urls.judged_pages(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {(r["template"], r["verdict"]) for r in made.collect()}
    assert ("/spam/*", "block") in rows and ("/good/{n}", "allow") in rows and made.count() == 82


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judged_pages(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_deep_segments_part_templates(spark, awkward, nothing):
    pages = [(i, f"http://h.com/a/b/c/d/{'spam' if i % 2 else 'good'}/{i}x/end") for i in range(80)] + [(900, "http://h.com/a/b/c/d/e/f/g/h/1/j/k/l/m/n"), (901, "http://h.com/a"), (902, "http://h.com/a/b")]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    made = {r["page_id"]: r for r in urls.judged_pages(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert {made[i]["template"] for i in range(80)} == {"/a/b/c/d/spam/*/end", "/a/b/c/d/good/*/end"}
    assert all(made[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(80))
    assert made[900]["template"] == "/a/b/c/d/*/f/g/h/{n}/j/k/l/m/n" and made[901]["template"] == "/a" and made[902]["template"] == "/a/b"
    odd = awkward.selectExpr("doc_id as page_id", "text as url", "1 as template", "'x' as segments", "0 as alone", "text as host", "1 as rule", "2 as bad")
    rows = urls.judged_pages(odd, labels).collect()
    assert len(rows) == awkward.count() and all(r["host"] == "" for r in rows)
    assert urls.judged_pages(nothing.selectExpr("doc_id as page_id", "text as url"), labels).count() == 0
