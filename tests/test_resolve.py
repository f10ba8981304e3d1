"""Identity of candidate pages, blocklists, robots rules, websites."""

import pytest
from pyspark.sql import functions as F

from gazetteer.operators import dataset as D
from gazetteer.operators import pages as P
from gazetteer.operators import resolve as R


def verdict(spark, text, host, signals, curated=False, final_url=None, identity=None):
    row = [(identity or text.lower(), text, host, final_url or f"https://{host}/", signals, text, curated)]
    df = spark.createDataFrame(
        row, "identity string, text string, host string, final_url string, signals array<string>, html string, curated boolean")
    v = R.verdict(*[F.col(c) for c in ("identity", "text", "host", "final_url", "signals", "html", "curated")])
    return df.select(v.alias("v")).first()["v"]


LONG_AWAY = (
    "Sunnyside Community Services is an office of a small town in the far west of the country. " * 6)


@pytest.mark.parametrize("text, host, signals, extra, want", [
    ("Camba is a Brooklyn, New York charity for families.", "camba.org", ["camba"], {}, "strong"),
    ("dancers.com is for sale. Buy this domain. New York.", "dancers.com", ["young", "dancers"], {}, None),
    ("Young Dancers New York company", "dancers.com", ["young", "dancers"],
     {"final_url": "https://www.hugedomains.com/x?d=dancers.com"}, None),
    ("Goddard College is a college of liberal arts in Vermont.", "goddard.org", ["goddard", "riverside", "house", "towers"], {}, None),
    ("The Brooklyn Foundation invests in Brooklyn, New York.", "brooklyn.org", ["brooklyn", "defender"], {}, None),
    (LONG_AWAY, "sunnyside-wa.gov", ["sunnyside", "community", "services"], {}, None),
    ("Sunnyside Community Services, far away.", "sunnyside-wa.gov", ["sunnyside", "community", "services"], {}, "strong"),
    ("Phipps Neighborhoods", "phippsny.org", ["phipps", "neighborhoods"], {}, "strong"),
    ("NYJTL runs tennis in the Bronx", "jtl.org", ["junior", "tennis", "league"], {}, "acronym"),
    ("Child Center of NY, Queens", "childcenter.org", ["child"], {}, None),
    ("Child Center of NY, Queens", "childcenterny.org", ["child"], {"curated": True}, "strong"),
    ("Simpson St. Development, Bronx", "sisda.org", ["simpson", "street", "development"],
     {"curated": True, "identity": "home page"}, "strong"),
    ("fiao.org is for sale. Buy this domain. Brooklyn", "fiao.org", ["federation"], {"curated": True}, None),
    ("Anything in New York", "example.org", [], {}, None),
])
def test_verdict(spark, text, host, signals, extra, want):
    got = verdict(spark, text, host, signals, **extra)
    assert (got and got["confidence"]) == want


BLOCKED = [("Bergen", "bergenbasin.com", "realty")]


@pytest.mark.parametrize("provider, url, blocked", [
    ("Bergen", "https://www.bergenbasin.com/", True),
    ("Bergen", "http://listings.bergenbasin.com/a", True),
    ("Bergen", "bergenbasin.org", False),
    ("Bergen", "notbergenbasin.com", False),
    ("Else", "bergenbasin.com", False),
])
def test_blocklist(spark, provider, url, blocked):
    rows = spark.createDataFrame([(provider, url, "strong")], "provider string, website string, confidence string")
    block = spark.createDataFrame(BLOCKED, "provider string, domain string, why string")
    cleaned, cleared = R.apply_blocklist(rows, block)
    assert [tuple(r) for r in cleared.collect()] == ([(provider, url, "realty")] if blocked else [])
    r = cleaned.first()
    assert (r["website"], r["confidence"]) == ((None, "unresolved") if blocked else (url, "strong"))


def test_no_blocklist_blocks_nothing(spark):
    rows = spark.createDataFrame([("a", "https://a.org", "strong")], "provider string, website string, confidence string")
    empty = spark.createDataFrame([], "provider string, domain string, why string")
    assert R.apply_blocklist(rows, empty)[0].first()["website"] == "https://a.org"


def test_robots_file(one):
    text = "User-agent: other\nDisallow: /a\nUser-agent: *  # all\nDisallow: /b # x\nDisallow:\r\nAllow: /c\nuser-agent: MyBot/2\ndisallow: /d"
    assert one(P.robots_rules(F.lit(text), "mybot")) == ["/b", "/d"]
    assert one(P.robots_rules(F.lit(text), "nobody")) == ["/b"]


def test_images_of_a_page(spark):
    html = (
        '<img data-src="/a.jpg" alt=" Kids \n at work "><IMG src="b.png"><img srcset="c.webp 1x, d.webp 2x">'
        '<img src="/logo.png"><img src="x.svg?v=1"><img src="/a.jpg"><meta property="og:image" content="/e.jpg#t">')
    pages = spark.createDataFrame([("https://o.org/p/", html)], "url string, html string")
    got = [(r["link"], r["alt"]) for r in P.extract_images(pages).orderBy("pos").collect()]
    assert got == [
        ("https://o.org/a.jpg", "Kids at work"), ("https://o.org/p/b.png", ""),
        ("https://o.org/p/c.webp", ""), ("https://o.org/e.jpg", "og:image")]


def test_first_accepted_host_wins_and_html_is_needed(spark):
    asked = spark.createDataFrame(
        [("p", "a.org", 0, 0, True, ["tennis"]), ("p", "b.org", 1, 0, False, ["tennis"]), ("p", "c.org", 1, 1, False, ["tennis"])],
        "provider string, host string, source_rank int, pos int, curated boolean, signals array<string>")
    page = "<title>Tennis Bronx</title>"
    pages = spark.createDataFrame(
        [("a.org", "https://a.org/", page, "application/pdf", True, 1), ("a.org", "http://a.org/", page, "text/html", False, 2),
         ("b.org", "https://bad.org/", page, "text/html", True, 3), ("c.org", "https://c.org/", page, "text/html", True, 4)],
        "host string, final_url string, html string, content_type string, https boolean, _ord int")
    block = spark.createDataFrame([("p", "bad.org", "x")], "provider string, domain string, why string")
    r = R.resolve(asked, pages, block).collect()
    assert [(x["website"], x["source"]) for x in r] == [("https://c.org/", "generated")]


def test_targets_of_each_stage(spark):
    rows = [("a", None, False, None, None), ("b", None, True, 0, 0), ("c", "https://c.org", None, 3, None),
            ("d", "https://d.org", False, None, 2), (None, None, None, 1, 1)]
    df = spark.createDataFrame(rows, "provider string, website string, locked boolean, n_pages long, n_images long")
    left = {s: {r.provider for r in R.targets(df, s).collect()} for s in ("resolve", "crawl", "extract", "images")}
    assert left == {"resolve": {"a", None}, "crawl": {"c", "d"}, "extract": {"c", None}, "images": {"d", None}}


def test_prior_merge_keeps_lock_and_route(spark):
    new = spark.createDataFrame([("a", 2, False), ("b", 1, False)], "provider string, site_count int, locked boolean")
    prior = spark.createDataFrame(
        [(1, "a", "https://old.org", "old.org", False), (2, "a", "https://a.org", "a.org", True)],
        "_ord long, provider string, website string, resolved_via string, locked boolean")
    got = D.merge_prior(new, prior, ["website", "resolved_via", "locked"]).orderBy("provider").collect()
    assert [(r.provider, r.website, r.resolved_via, r.locked) for r in got] == [
        ("a", "https://a.org", "a.org", True), ("b", None, None, False)]
