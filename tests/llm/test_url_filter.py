from vecatlas.llm.url_filter import host_rule, judge, word_rule

RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"), host_rule("example.com/De", "block"), word_rule("adult-x")]
CASES = [
    ("https://a.example.net/en/1", ("a.example.net", "/en/1", "example.net/en/", "allow")),
    ("https://a.EXAMPLE.net/EN/1", ("a.example.net", "/EN/1", "net/", "block")),
    ("http://example.net", ("example.net", "", None, "allow")),
    ("http://example.network/en/", ("example.network", "/en/", None, "allow")),
    ("http://example.com/Desk?x=1#y", ("example.com", "/Desk", "example.com/De", "block")),
    ("http://example.com/desk", ("example.com", "/desk", None, "allow")),
    ("http://my-adult-x.org/", ("my-adult-x.org", "/", None, "block")),
    ("http://my-adult-xx.org/", ("my-adult-xx.org", "/", None, "allow")),
    ("http://o.org/?q=adult-x", ("o.org", "/", None, "block")),
    ("net/x", ("", "", None, "allow")),
    (None, ("", "", None, "allow")),
    ("", ("", "", None, "allow")),
    ("x://" + "a" * 100000 + ".net/", ("a" * 100000 + ".net", "/", "net/", "block")),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, (u, _) in enumerate(CASES)] + [(0, CASES[0][0], "z")], "page_id long, url string, host string")
    rows = judge(pages, RULES).collect()
    assert len(rows) == len(CASES) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == CASES[r["page_id"]][1]


def test_no_rules_and_no_rows(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), []).first()["verdict"] == "allow"
