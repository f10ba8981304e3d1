"""Quotes, claims, phrase joins and keyword facts."""

import random
import re

from pyspark.sql import functions as F

from gazetteer.functions import text as T
from gazetteer.operators import evidence as E
from gazetteer.operators.phrases import contains_join
from gazetteer.plans.evidence_queries import keyword_search as keyword_search_query, keyword_search_all, quote_around_all
from gazetteer.vocab import SUBJECT_GROUPS, SUBJECT_PATTERNS, SUBJECT_VOCAB

L = F.lit
PAGE = (
    "## Home\nThe program meets from Monday to Friday.\nPupils study  life science with live butterflies in the lab,\n"
    "and practise math in games. There is also a “Coding Club” on Fridays."
)


def check(spark, claims, text=PAGE, labels=SUBJECT_VOCAB):
    rows = spark.createDataFrame(
        [(i, i, "p", s, q) for i, (s, q) in enumerate(claims)],
        "claim_id int, _ord int, provider string, label string, quote string")
    pages = spark.createDataFrame([(1, "p", text)], "page_id int, provider string, text string")
    vocabulary = spark.createDataFrame([(s,) for s in labels], "label string")
    return E.verify_quotes(rows, pages, vocabulary, ["provider"])


def kept(spark, claims, text=PAGE):
    first, dropped = E.first_quote(check(spark, claims, text))
    return {r["label"]: r["quote"] for r in first.collect()}, dropped.first()["dropped"]


def test_verbatim_quotes_hold(spark):
    got, dropped = kept(spark, [
        ("biology", "study life science with live butterflies"),
        ("computer science", 'There is also a "coding club" on fridays')])
    assert set(got) == {"biology", "computer science"} and dropped == 0


def test_changed_short_and_unknown_claims_fall(spark):
    got, dropped = kept(spark, [
        ("mathematics", "practise math in board games"), ("astrology", "live butterflies in the lab"),
        ("mathematics", "math"), ("mathematics", "practise math in games")])
    assert got == {"mathematics": "practise math in games"} and dropped == 3


def test_first_valid_quote_wins(spark):
    got, _ = kept(spark, [("biology", "live butterflies in the lab"), ("biology", "study life science")])
    assert got == {"biology": "live butterflies in the lab"}


def test_entities_are_decoded_on_both_sides(spark, one):
    text = "Kids&#8217; STEM Lab &#8211; robots &#038; gears, grades K&ndash;5 &#x1F600;"
    got, _ = kept(spark, [("engineering", "Kids’ STEM Lab – robots & gears, grades K-5 😀")], text)
    assert "engineering" in got
    assert one(T.squash(L("&amp;lt; &nope; &#99999999999; a b"))) == "&lt; &nope; &#99999999999; a b"


def test_phrase_join_equals_search(spark):
    rng = random.Random(5)
    words = ["a", "an", "robot", "robots", "ro", "bot", "the", "then", "thermal", "it", "éa"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(120)]
    phrases = {t[i:i + n].strip() for t in texts for i, n in [(rng.randint(0, 5), rng.randint(1, 25))]}
    phrases = sorted(p for p in phrases | {"zzz", "bots the"} if p)
    got = contains_join(
        spark.createDataFrame([(p, p) for p in phrases], "phrase_id string, phrase string"),
        spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")).collect()
    want = {(p, i) for p in phrases for i, t in enumerate(texts) if p in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_quote_is_cut_at_blanks_only(one):
    text = "intro Kids&#8217; " + "w " * 42 + "robotics lab is open"
    at = text.index("robotics")
    quote = one(T.quote_around(L(text), L(at), L(8)))
    assert quote in text and not quote.startswith(("8217;", "#"))
    i = text.index(quote)
    assert text[i - 1] == " "


def test_quote_follows_the_plain_rule(one):
    import re

    def plain(text, index, size, reach=90):
        start, end = max(0, index - reach), min(len(text), index + size + reach)
        before = text[start:index]
        stop = max(before.rfind(". "), before.rfind("! "), before.rfind("? "))
        if stop >= 0:
            start += stop + 2
        elif start > 0:
            sp = text.find(" ", start)
            start = sp + 1 if 0 <= sp < index else index
        m = re.search(r"[.!?](\s|\Z)", text[index + size:end])
        if m:
            end = index + size + m.start() + 1
        elif end < len(text):
            sp = text.rfind(" ", 0, end + 1)
            if sp > index + size:
                end = sp
        return text[start:end].strip()

    rng = random.Random(9)
    for _ in range(40):
        text = "".join(rng.choices(["word ", "longerword", " ", "stop. ", "what? ", "x", "end."], k=60))
        at, size = rng.randint(0, len(text) - 5), rng.randint(1, 5)
        assert one(T.quote_around(L(text), L(at), L(size))) == plain(text, at, size)


def test_all_positions(one):
    got = one(T.match_positions(L("robots, a robot and Robots"), "(?i)robots?"))
    assert [(m["pos"], m["len"]) for m in got] == [(0, 6), (10, 5), (20, 6)]


def test_every_match_is_quoted(spark, tmp_path):
    text = "One of them. " + "Plain words here. " * 12 + "Two of those. " + "Plain words here. " * 12 + "Three OF these."
    spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quote_around_all(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["doc_id"], r["name"], r["pos"]) for r in got] == [(1, "of", m.start()) for m in re.finditer("(?i)of", text)]
    assert [r["quote"] for r in got] == ["One of them.", "Two of those.", "Three OF these."]


def test_questions_of_every_language_are_answered(spark, tmp_path):
    rows = [(1, "a robots chess club", "en"), (2, "x chess robots club more", "fr"), (3, "y jardin lumi ere", "de"), (4, None, "en"), (5, "one", "es"), (6, "z don't", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, keyword_search_all(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("chess club robots", 2, 1), ("chess club robots", 2, 2), ("ere jardin lumi", 1, 3), ("dont", 1, None), ("", 2, None)], key=repr)


def test_every_text_asks_whatever_its_language(spark, tmp_path):
    rows = [(1, "a robots chess club", "en"), (2, "x chess robots club more", "fr"), (3, "y jardin lumi ere", "de"), (4, None, "en"), (5, "z robots", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, keyword_search_query(spark, str(tmp_path)).collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (5, 1), (5, 2), (5, 5)]


def facts(spark, *texts):
    pages = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "provider string, _ord int, text string")
    return E.keyword_facts(pages).first()


SITE = (
    "Welcome to our center. Type your zip code to find a site. After-school programming is daily. "
    "The Robotics Club builds with LEGO kits. Pupils also enjoy chess and creative writing. "
    "Free tax help for adults each spring. Write to hello@site.org or call (212) 555-0100."
)


def test_keyword_facts_are_quoted(spark):
    r = facts(spark, SITE)
    assert {"robotics", "chess", "literacy & writing"} <= set(r["subjects"])
    assert all(e["quote"] in SITE for e in r["subject_evidence"])
    assert "coding" not in r["stem_tools"] and "robotics" in r["stem_tools"] and r["evidence"]
    assert (r["cost_tier"], r["method"], r["confidence"]) == ("unknown", "keyword", "low")
    assert r["has_program"] and r["contact_email"] == "hello@site.org" and r["contact_phone"] == "(212) 555-0100"


def test_adult_services_and_menus_are_no_evidence(spark):
    r = facts(
        spark, "Home About Programs Adult Literacy Youth Services Senior Centers Food Pantry Careers Donate Contact. "
        "English literacy classes help adults get citizenship. The nutrition office (SNAP) can help.",
        "In the after-school program, children build literacy skills by reading aloud.")
    quotes = {e["subject"]: e["quote"] for e in r["subject_evidence"]}
    assert quotes["literacy & writing"].startswith("In the after-school program")
    assert "health & nutrition" not in quotes


def test_evidence_past_the_first_pages_is_found(spark):
    bad = ["chess for adults only."] * (E.FIRST_PAGES + 3)
    r = facts(spark, *bad, "Children play chess each day.")
    assert r["subjects"] == ["chess"]


def test_vocabulary_is_closed():
    assert set(SUBJECT_PATTERNS) == set(SUBJECT_VOCAB)
    assert len(SUBJECT_VOCAB) == len(set(SUBJECT_VOCAB)) == sum(map(len, SUBJECT_GROUPS.values()))


def test_tools_without_quotes_are_dropped(spark):
    rows = spark.createDataFrame(
        [(["robotics", "teleport"], [" "], "high"), (["chess"], ["we play chess"], "high"), ([], [], None)],
        "stem_tools array<string>, evidence array<string>, confidence string")
    got = [(r["stem_tools"], r["confidence"], r["dropped_unevidenced"]) for r in E.gate_evidence(rows).collect()]
    assert got == [([], "low", 1), (["chess"], "high", 0), ([], "low", 0)]


def test_corpus_is_cut_to_its_budget(spark):
    pages = spark.createDataFrame(
        [("p", i, "h", f"u{i}", "x" * 30) for i in range(50)], "provider string, _ord long, label string, url string, text string")
    whole = "\n\n".join(f"## h (u{i})\n" + "x" * 30 for i in range(50))
    assert E.corpus(pages, 500).first()["corpus"] == whole[:500]
    assert E.corpus(pages, 10 ** 6).first()["corpus"] == whole
