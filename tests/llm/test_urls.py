import pytest
from pyspark.sql import functions as F

from quern.llm import urls


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.ORG/es/1?x=/", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://myexample.org/es/1", "myexample.org", "/es/1", "org/", "allow"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("no scheme/at all", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://?q", "", "", None, "allow"),
        ("x\ny://H/\nz", "h", "/\nz", None, "allow"),
        ("http://casino-win.example.net/en/5", "casino-win.example.net", "/en/5", None, "allow"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule, verdict):
    row = urls.judged(spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")).first()
    assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
    if rule:
        assert row["verdict"] == verdict


def test_templates_of_one_host_are_good_and_bad(spark):
    """Rules fit a part of a host's pages; those that no rule fits are judged by their template's other pages."""
    rules = (urls.Rule("block", "shop.example.net", "/win/1"), urls.Rule("allow", "shop.example.net", "/doc/1"))
    rows = [(i, f"http://shop.example.net/{name}/{n}") for i, (name, n) in enumerate((name, n) for name in ("win", "doc") for n in range(100, 300))]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    free = [r for r in out if r["rule"] is None]
    assert len(free) == 200 and {(r["path"][:4], r["verdict"]) for r in free} == {("/win", "block"), ("/doc", "allow")}
    assert {r["template"] for r in free} == {"/win/{n}", "/doc/{n}"}


def test_labelling_rules_label_and_judge_nothing(spark):
    rows = [(i, f"http://a.example.net/{name}/{i}") for i, name in enumerate(["x", "y"] * 40)]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), (), (urls.Rule("block", "a.example.net", "/x/"), urls.Rule("allow", "a.example.net", "/y/"))).collect()
    assert {r["rule"] for r in out} == {None} and {(r["path"][1], r["verdict"]) for r in out} == {("x", "block"), ("y", "allow")}


def test_rare_children_become_a_wildcard(spark):
    shapes = [("h", [f"name-{chr(97 + i // 26)}{chr(97 + i % 26)}"], None) for i in range(60)] + [("h", ["about"], None)] * 60
    out = urls.templates(spark.createDataFrame(shapes, "host string, shape array<string>, bad int")).collect()
    assert {r["template"] for r in out} == {"/*", "/about"}


def test_like_branches_are_merged_and_unlike_ones_not(spark):
    shapes = [("h", [a, "{n}"], int(a == "bad")) for a in ("x", "y", "bad") for _ in range(50)] + [("g", [a, "{n}"], 0) for a in ("x", "y") for _ in range(50)]
    out = {(r["host"], r["shape"][0]): (r["template"], r["purity"]) for r in urls.templates(spark.createDataFrame(shapes, "host string, shape array<string>, bad int")).collect()}
    assert out["h", "bad"][1] > urls.REJECTED > out["h", "x"][1] and out["h", "bad"][0] == "/bad/{n}"
    assert out["g", "x"] == out["g", "y"] and out["g", "x"][0] == "/*/{n}"


def test_edge_rows(spark):
    rows = [(1, "http://a.net/x", 0), (1, "http://a.net/x", 0), (None, None, 1), (2, "http://a.net/" + "s/" * 3000, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    assert urls.judged(pages).count() == 4 and urls.judged(pages.limit(0)).count() == 0
    assert urls.judged(pages).where(F.col("verdict").isNull()).count() == 0


def test_templates_without_labels_go_by_their_domain_then_by_all_hosts(spark):
    rules = (urls.Rule("block", "a.one.net", "/win/"), urls.Rule("allow", "a.one.net", "/fr/"), urls.Rule("allow", "a.two.net", "/win/"))
    hosts = ["a.one.net", "b.one.net", "a.two.net", "b.two.net", "c.three.net"]
    rows = [(100 * h + 50 * p + i, f"http://{host}/{name}/{i}") for h, host in enumerate(hosts) for p, name in enumerate(("win", "fr")) for i in range(50)]
    found = {(r["host"], r["path"].split("/")[1]): (r["verdict"], r["purity"]) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert found["b.one.net", "win"][0] == "block" and found["b.two.net", "win"][0] == "allow" and found["c.three.net", "fr"][0] == "allow"
    assert found["b.one.net", "win"][1] > found["c.three.net", "win"][1] > found["b.two.net", "win"][1] > 0


def test_most_pages_without_a_rule_are_judged_by_labels(spark):
    out = urls.judged(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule IS NULL").cache()
    assert out.where("purity IS NULL").count() == 0 and out.where("verdict = 'block'").count() > 0.05 * out.count()
    assert out.where("verdict = 'allow'").count() > 0.2 * out.count()


def test_labels_of_a_table_reject_templates(spark):
    rows = [(i, f"http://a.net/shop/item{i}/buy") for i in range(60)] + [(100 + i, f"http://a.net/news/{i}") for i in range(60)] + [(300, None), (301, "http://b.com/de/x")]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)] + [(0, 0), (999, 1), (None, 1), (300, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("told", F.lit("x"))
    table = spark.createDataFrame(labels, "id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages, labels=table).collect()}
    assert all(got[i][3] == "block" for i in range(60)) and all(got[100 + i][3] == "allow" for i in range(60))
    assert got[300] == ("", "", None, "allow") and got[301] == ("b.com", "/de/x", "com/de/", "block") and got[7] == ("a.net", "/shop/item7/buy", None, "block")
    plain = {r["page_id"]: r["verdict"] for r in urls.judged(pages).collect()}
    assert plain[301] == "block" and len(plain) == 122
