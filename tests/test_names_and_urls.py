"""Organisation names, candidate hosts, URLs and typed values."""

import pytest
from pyspark.sql import functions as F

from gazetteer.functions import text as T
from gazetteer.functions import values as V
from gazetteer.functions import web as W
from gazetteer.functions.regex import java, needed

L = F.lit


def test_full_name_comes_before_a_short_base(one):
    hosts = one(T.domain_candidates(L("New York Edge, Inc.")))
    assert hosts[0] == "newyorkedge.org"
    assert "edge.org" not in hosts


@pytest.mark.parametrize("name", ["The Child Center of NY Inc", "Good Shepherd Services"])
def test_a_lone_generic_word_is_no_host(one, name):
    hosts = one(T.domain_candidates(L(name)))
    assert not {"child.org", "good.org"} & set(hosts)


def test_initials_and_legal_words(one):
    assert "nyjtl.org" in one(T.domain_candidates(L("New York Junior Tennis League Inc")))
    hosts = one(T.domain_candidates(L("Camba, Inc.")))
    assert "camba.org" in hosts and "cambainc.org" not in hosts
    assert one(T.domain_candidates(L("Hudson Guild")))[0].endswith(".org")


@pytest.mark.parametrize("name", ["", "---"])
def test_nothing_from_nothing(one, name):
    assert one(T.domain_candidates(L(name))) == []


def test_signals_leave_out_short_and_common_words(one):
    assert one(T.name_signals(L("The Child Center of NY Inc"))) == ["child"]


def test_provider_key_folds_spelling(one):
    key = lambda s: one(T.provider_key(L(s)))
    assert key("Harbor Charities, Archdiocese of New York") == key("Harbor Charities, Archdiocese of NY")
    assert key("Women's Housing Corporation (WHC") == key("Women's Housing Corporation")
    assert key("Queens Community House Inc") != key("Queens Community Services Inc")


def test_tidy_org(one):
    tidy = lambda s: one(T.tidy_org(L(s)))
    assert tidy("ST. NICKS ALLIANCE CORP.") == "St. Nicks Alliance Corp."
    assert tidy("SCAN-HARBOR INC") == "SCAN-HARBOR"
    assert tidy("YMCA of Greater New York/Corporate") == "YMCA of Greater New York"
    assert tidy("Bergen Development Corporation") == "Bergen Development Corporation"


@pytest.mark.parametrize("href, want", [
    ("/für", "https://www.ex.org/f%C3%BCr"),
    ("../x/./y?z=1#k", "https://www.ex.org/a/x/y?z=1"),
    ("mailto:a@b.org", None),
    ("data:image/png;base64,x", None),
    ("//cdn.ex.org/y", "https://cdn.ex.org/y"),
    ("?q=1", "https://www.ex.org/a/b/c.html?q=1"),
    ("#top", "https://www.ex.org/a/b/c.html?x=1"),
    ("sub/p.html", "https://www.ex.org/a/b/sub/p.html"),
    ("https://Other.org", "https://other.org/"),
])
def test_absolute(one, href, want):
    assert one(W.absolute(L(href), L("https://www.ex.org/a/b/c.html?x=1"))) == want


def test_hosts(one):
    assert one(W.host_of(L("https://www.BergenBasin.com/listings?x=1"))) == "bergenbasin.com"
    assert one(W.host_of(L("bergenbasin.com"))) == "bergenbasin.com"
    assert one(W.host_of(L(""))) is None
    assert one(W.host_of(L(None).cast("string"))) is None
    assert one(W.clean_domain(L(" HTTPS://www.a.org/x "))) == "a.org"
    assert one(W.clean_domain(L("unsure"))) is None


def test_resized_variants_share_a_key(one):
    def key(u):
        return one(W.canonical_image_key(L(u)))

    same = {key(u) for u in (
        "https://www.o.org/up/robots.jpg", "https://o.org/up/robots-800x500.jpg",
        "https://o.org/up/robots-scaled.jpg", "https://o.org/up/robots@2x.jpg?ver=3")}
    assert len(same) == 1
    assert key("https://y.org/f/2026/kids.jpeg") == key("https://y.org/f/styles/hero/public/2026/kids.jpeg.webp?i=1")
    assert key("https://y.org/v1/fill/w_8,h_5/a.png") == key("https://y.org/a.png")
    assert key("https://o.org/up/robots-1.jpg") != key("https://o.org/up/robots-2.jpg")
    assert key("https://o.org/a+b%20c.jpg") == "o.org/a+b c.jpg"
    assert key("no url") == "no url"


def test_numbers_and_ids(one):
    assert [one(V.num(L(x))) for x in (" 1e3 ", "", "NaN", "Infinity", "NULL")] == [1000.0, None, None, None, None]
    none = L(None).cast("string")
    assert one(V.stable_id(L("PS 1 / Annex"), none, L("10001"))) == "ps-1-annex-10001"
    assert one(V.stable_id(none, L("5 Main St"), none)) == "site-5-main-st-"


@pytest.mark.parametrize("ok, status, error, want", [
    (True, 200, None, True), (False, 404, None, True), (False, 403, None, True),
    (False, 0, "robots", True), (False, 0, "bad url", True), (False, 0, "fetch failed", False),
    (False, 500, None, False), (False, 502, None, False), (False, 429, None, False), (False, 408, None, False),
])
def test_final_outcomes(one, ok, status, error, want):
    assert one(V.is_definitive(L(ok), L(status), L(error).cast("string"))) is want


def test_word_edges_are_ascii(one):
    assert one(L("éart").rlike(java(r"\bart"))) is True
    assert one(L("heart").rlike(java(r"\bart"))) is False
    assert one(L("n.y. ok").rlike(java(r"\b(nyc|n\.y\.)\b"))) is False
    assert one(L("n.y.c").rlike(java(r"\b(nyc|n\.y\.)\b"))) is True


def test_needed_letters():
    assert needed(r"\brobot(ic)?s?\b|\bvex\b") == ["robot", "vex"]
    assert needed(r"\b(kids?|child)\b") == ["kid", "child"]
    assert needed(r"\d{5}") is None
    assert needed(r"micro:?bit") == ["micro"]
