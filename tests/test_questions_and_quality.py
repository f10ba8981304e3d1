"""Question parsing and answers; stage checks that must not pass for nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gazetteer.functions import asking as A
from gazetteer.operators import quality as Q
from gazetteer.operators import questions as QU
from gazetteer.operators.evidence import keyword_search, keyword_sets
from gazetteer.operators.phrases import _anchored_join
from gazetteer import session
from gazetteer.operators import similar
from gazetteer.operators.similar import near_duplicate_groups, shingles


def parsed(one, text):
    return one(A.parse(A.normalize(F.lit(text))))


@pytest.mark.parametrize("text, field, want", [
    ("Is anything FREE?", "cost", "free"), ("it doesn't cost money", "cost", "free"), ("paid ones", "cost", "paid"),
    ("open after 5:30 pm", "after_min", 1050), ("after 5", "after_min", 1020), ("after 10", "after_min", 600),
    ("starting after 12am", "after_min", 0), ("before 9am", "before_min", 540), ("in the morning", "before_min", 720),
    ("evening chess", "hours_kind", "evenings"), ("in the afternoon", "hours_kind", "after-school"),
    ("on weekdays", "hours_kind", "after-school"), ("on weekends", "days", ["saturday", "sunday"]),
    ("monday or sunday", "days", ["sunday", "monday"]), ("for a 7 year old", "age", 7), ("ages 9", "age", 9),
    ("teens", "age_group", "teen"), ("kids", "age_group", "kid"), ("scratch and 3d printing", "topics", ["coding", "3d printing"]),
    ("in bk or the bronx", "places", ["brooklyn", "bronx"]), ("in 11213", "places", ["11213"]),
    ("near 11213", "near_zip", "11213"), ("near 11213", "places", []), ("hello", "cost", None),
])
def test_stated_filters(one, text, field, want):
    assert parsed(one, text)[field] == want


CATALOG = """SELECT * FROM VALUES
 (1, 'a', 'Robot Hall', 'Org A', 'sum', 'Park Slope, Brooklyn', 'Brooklyn', 'Park Slope', '11215', '', 'after-school', array('monday'), cast(null AS string), cast(null AS string), 0, 5, 11, array('robotics'), 40.67D, -73.98D),
 (2, 'b', 'Chess Hall', 'Org B', 'sum', 'Harlem, Manhattan', 'Manhattan', 'Harlem', '10027', '', 'evenings', array('monday', 'saturday'), '17:00', '20:00', cast(null AS int), 5, 18, array('chess', 'visual arts'), 40.81D, -73.95D),
 (3, 'c', 'Open Hall', 'Org C', 'sum', 'NYC', '', '', '', '', 'unknown', array(), cast(null AS string), cast(null AS string), 0, 4, 18, array('coding'), cast(null AS double), cast(null AS double))
 AS t(_ord, id, name, org, summary, location, area, neighborhood, zip, schoolName, hoursKind, days, start, end, cost, ageMin, ageMax, topics, lat, lng)"""


def answer(spark, *questions):
    catalog = spark.sql(CATALOG)
    centres = spark.createDataFrame([("11215", 40.668, -73.98)], "zip string, lat double, lng double")
    asked = spark.createDataFrame(list(enumerate(questions)), "qid int, question string")
    parts = QU.route_questions(asked, catalog, centres)
    filters = QU.distinct_filters(parts["routes"])
    found = QU.match_filters(filters, catalog, centres)
    rendered = QU.render_answers(filters, found, catalog, F.lit(3)).select("sig", "intro", "ids", "spoken")
    rows = parts["routes"].select("qid", "route", "sig").join(rendered, "sig", "left").orderBy("qid").collect()
    return [(r["route"], r["intro"] if r["route"] == "filters" else None, r["ids"] or []) for r in rows]


def joined(df, kind, key):
    """Whether the plan has a join of this kind on the key."""
    return re.search(rf"{kind} \[[^\]]*\b{key}#", df._jdf.queryExecution().executedPlan().toString()) is not None


def test_questions_and_their_words_are_never_broadcast(spark):
    # Tables whose size Spark believes to be small, as it does of packed files.
    catalog = spark.sql(CATALOG)
    asked = spark.sql("SELECT id AS qid, concat('robotics in harlem, org c ', id % 2) AS question FROM range(3)")
    places = QU.match_places(QU.parse_questions(asked), catalog)
    for key in ("word", "_id"):
        assert joined(places, "SortMergeJoin", key) and not joined(places, "BroadcastHashJoin", key)
    assert [r["places"] for r in places.collect()] == [["harlem"]] * 3
    centres = spark.createDataFrame([("11215", 40.668, -73.98)], "zip string, lat double, lng double")
    routes = QU.route_questions(asked, catalog, centres)["routes"]
    assert re.search(r"SortMergeJoin \[q#\d+\], \[q#\d+\], Inner", routes._jdf.queryExecution().executedPlan().toString())
    assert [r["route"] for r in routes.collect()] == ["filters"] * 3


def test_texts_and_their_pieces_are_never_broadcast(spark):
    phrases = spark.sql("SELECT id AS phrase_id, 'chess club' AS phrase FROM range(2)")
    texts = spark.sql("SELECT id AS text_id, concat('the chess club today ', id) AS text FROM range(3)")
    pairs = _anchored_join(phrases, texts, [])
    for key in ("feature", "text_id"):
        assert joined(pairs, "SortMergeJoin", key) and not joined(pairs, "BroadcastHashJoin", key)
    assert pairs.count() == 6
    asked = spark.sql("SELECT id AS qid, if(id < 2, 'club chess', 'none') AS q FROM range(2)")
    hits = keyword_search(asked, texts)
    assert not re.search("Join", hits._jdf.queryExecution().executedPlan().toString())  # pairs go through none
    assert hits.count() == 6


def test_pairs_of_sets_meet_nothing_after_they_are_made(spark):
    texts = spark.sql("SELECT id AS text_id, concat('the chess club today ', id) AS text FROM range(3)")
    asked = spark.sql("SELECT if(id < 2, 'club chess', if(id = 2, 'zebra', 'a')) AS q FROM range(4)")
    found = keyword_sets(asked, texts)
    pairs, alone = found._jdf.queryExecution().executedPlan().toString().split("\n   :- ")[1].split("\n   +- ")
    assert "Join" not in pairs and "Join" in alone
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == [("", 1, None), ("chess club", 2, 0), ("chess club", 2, 1), ("chess club", 2, 2), ("zebra", 1, None)]


def test_routes_and_answers(spark):
    got = answer(
        spark, "  ", "Hello!", "help?", "Is it safe for my child", "tell me about robot hall please", "free robotics in brooklyn",
        "chess near 11215", "robotics near 11215", "chess near 99999", "art after 6pm", "what programs are there",
        "org c sum", "gibberish words here", "paid", "kids", "where are classes for kids", "in harlem")
    routes = [r[0] for r in got]
    assert routes == [
        "empty", "greeting", "help", "faq", "named", "filters", "filters", "filters", "unknown-zip", "filters", "overview",
        "keyword", "none", "filters", "none", "filters", "filters"]
    assert got[5] == ("filters", "I found 1 free robotics program in Brooklyn:", ["a"])
    assert got[6][2] == [] and got[6][1].startswith("I couldn't find a program that matches chess within 3 miles of 11215.")
    assert got[7][1] == "I found 1 robotics program within 3 miles of 11215:"
    assert got[9] == ("filters", "I found 1 open after 6pm art program:", ["b"])
    assert got[13][2] == ["b"]
    assert got[15] == ("filters", "Here's where to find kids programs:", ["a", "b", "c"])
    assert got[16] == ("filters", "I found 1 program in Harlem:", ["b"])


def test_every_route_has_an_answer(spark):
    catalog = spark.sql(CATALOG).selectExpr("*", "'Ask provider' AS hoursLabel", "CASE WHEN cost = 0 THEN 'Free' END AS costLabel", "'Grades K–5' AS ages")
    centres = spark.createDataFrame([("11215", 40.668, -73.98)], "zip string, lat double, lng double")
    asked = ["  ", None, "Hello!", "help?", "Is it safe for my child", "tell me about robot hall or CHESS HALL", "free robotics in brooklyn",
             "chess near 99999", "what programs are there", "org c sum", "harlem chess", "sum open", "gibberish words here", "Hello!"]
    parts = QU.route_questions(spark.createDataFrame(list(enumerate(asked)), "qid int, question string"), catalog, centres)
    rows = QU.answer_questions(parts, catalog, centres, "the list", 2).collect()
    got = {r["q"]: (r["route"], r["total"], list(r["ids"]), r["intro"], r["spoken"]) for r in rows}
    assert len(rows) == len(got) == 12
    assert got[""][:3] == ("empty", 0, []) and got["hello!"][3].startswith("Hi! I can help you find programs on the list.")
    assert got["is it safe for my child"][0] == "faq" and got["is it safe for my child"][3].startswith("The list does not inspect")
    named = got["tell me about robot hall or chess hall"]
    assert named[:3] == ("named", 2, ["a", "b"])
    assert named[3].startswith("Robot Hall is in Park Slope, Brooklyn, ") and "\n\nChess Hall is in Harlem, Manhattan, " in named[3]
    assert "\n" not in named[4] and named[4].endswith(" The first programs are Robot Hall, Chess Hall.")
    assert got["free robotics in brooklyn"][:4] == ("filters", 1, ["a"], "I found 1 free robotics program in Brooklyn:")
    assert got["chess near 99999"][3].startswith("I don't know ZIP 99999,")
    assert got["what programs are there"][3].startswith("The list lists 3 K–5 programs")
    # Words of one or two letters do not count.
    assert got["org c sum"][:4] == ("keyword", 3, ["a", "b"], "These are the closest matches I have: Showing 2 of 3. Add a borough, ZIP, or topic to narrow it.")
    assert got["harlem chess"][0] == "filters" and got["sum open"][:3] == ("keyword", 3, ["a", "b"])
    assert got["gibberish words here"][:3] == ("none", 0, [])


def levels(df):
    return {r["check"]: r["level"] for r in df.collect()}


PROVIDERS = "provider string, website string, confidence string, resolved_via string, site_count int"


def test_resolve_levels(spark):
    good = spark.createDataFrame([("A", "https://a.org/", "strong", "a.org", 3), ("B", None, "unresolved", None, 1)], PROVIDERS)
    assert set(levels(Q.check_resolve(good)).values()) == {"pass"}
    bad = spark.createDataFrame([("A", "https://a.org/", None, None, 1)], PROVIDERS)
    assert levels(Q.check_resolve(bad)) == {"some-verified": "pass", "confidence-known": "fail", "route-recorded": "warn"}


FACTS = "provider string, method string, stem_tools array<string>, evidence array<string>, subjects array<string>, subject_evidence array<struct<subject:string,quote:string>>"


def test_copies_cannot_hide_a_gap_and_nothing_to_test_warns(spark):
    crawled = spark.createDataFrame([("A",), ("B",)], "provider string")
    twice = spark.createDataFrame([("A", "keyword", ["coding"], [], [], [])] * 2, FACTS)
    got = levels(Q.check_extract(twice, crawled))
    assert got["facts-cover"] == "fail" and got["tools-backed"] == "warn" and got["all-by-model"] == "warn"
    model = spark.createDataFrame([("A", "gemini", ["robotics"], [], [], []), ("B", "gemini", [], [], ["x"], [])], FACTS)
    got = levels(Q.check_extract(model, crawled))
    assert got["tools-backed"] == "fail" and got["facts-cover"] == "pass" and got["subjects-quoted"] == "fail"


def test_image_and_crawl_levels(spark):
    crawled = spark.createDataFrame([("A",)], "provider string")
    photos = "provider string, judged boolean, suitability int"
    ledger = spark.createDataFrame([("A", None)], "provider string, reason string")
    got = levels(Q.check_images(spark.createDataFrame([("A", False, None)], photos), ledger, crawled))
    assert got["scores-present"] == "warn" and got["reasons-recorded"] == "warn"
    got = levels(Q.check_images(spark.createDataFrame([("A", True, None)], photos), ledger, crawled))
    assert got["scores-present"] == "fail"
    pages = spark.createDataFrame([("A", "x" * 500), ("B", "")], "provider string, text string")
    two = spark.createDataFrame([("A", "x"), ("B", "y")], "provider string, website string")
    assert levels(Q.check_crawl(pages, two)) == {"all-crawled": "pass", "text-found": "warn"}


def test_a_stale_build_names_its_inputs(spark):
    def at(t):
        return spark.createDataFrame([(t,)], "updated_at long")

    got = {r["input"]: r["stale"] for r in Q.stale_inputs(at(10), {"facts": at(12), "photos": at(9)}).collect()}
    assert got == {"facts": True, "photos": False}


def assert_groups(df, threshold=0.7):
    got = {r["doc_id"]: r["label"] for r in near_duplicate_groups(df, threshold).collect()}
    sets = {r["doc_id"]: (r["source"], frozenset(r["s"]), r["text"]) for r in df.select("doc_id", "source", "text", shingles(F.col("text")).alias("s")).collect()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (g, a, t) in sets.items():
        for j, (h, b, u) in sets.items():
            if i < j and g == h and (t == u or (a and b and len(a & b) / len(a | b) >= threshold)):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert got == {i: find(i) for i in sets}


def test_near_copies_equal_brute_force(spark):
    base = ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".replace("o", c) for c in "oxyz"]
    texts = []
    for b in base:
        words = b.split()
        texts += [b, b, " ".join([*words, "plus"]), " ".join([*words, "plus", "more"])]
    texts += ["short", "something else altogether that nobody wrote before today in this place", ""]
    rows = [(i, "s", t) for i, t in enumerate(texts)] + [(99, "other", texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert_groups(df)


def test_near_copies_in_chains(spark):
    """Neighbours are near, others are not; keys are shuffled, so that leaders sit inside the chains."""
    rows = []
    for chain in range(3):
        words = [f"w{chain}x{i * i % 997}" for i in range(90)]
        rows += [(chain, " ".join(words[i * 4: i * 4 + 48])) for i in range(9)]
    order = random.Random(3).sample(range(len(rows)), len(rows))
    df = spark.createDataFrame([(k, "s", t) for k, (_, t) in zip(order, rows, strict=True)], "doc_id long, source string, text string")
    assert_groups(df)


def test_near_copies_of_many_unlike_texts(spark, monkeypatch):
    """Texts that share half of their shingles meet in large buckets without links; that takes few rounds."""
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, "s", common + "".join(f" w{i}x{j}" for j in range(30))) for i in range(48)]
    rows += [(100 + i, "s", t + f" w{i}end") for i, _, t in rows[::3]]
    cuts = []
    monkeypatch.setattr(similar, "cut_lineage", lambda df: cuts.append(1) or session.cut_lineage(df))
    assert_groups(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert len(cuts) < 60


def test_hosts_are_checked_against_the_schools(spark):
    schools = spark.createDataFrame(
        [("A", "A", 40.7, -73.9, False, 1), ("B", "B", 40.7005, -73.9, True, 2), ("F", "F", 41.7, -73.9, True, 3), ("N", "N", 40.9, -73.9, False, 4)],
        "dbn string, name string, lat double, lng double, serves_k5 boolean, _ord long")
    host = "struct<dbn:string,servesK5:boolean>"
    programs = spark.createDataFrame(
        [("right", 40.7, -73.9, ("B", True)), ("passed over", 40.7, -73.9, ("A", False)), ("far", 40.7, -73.9, ("F", True)), ("unknown", 40.7, -73.9, ("X", True)),
         ("none", 45.0, -73.9, None), ("bare", 40.9, -73.9, ("N", False)), ("nameless", 40.9, -73.9, (None, False))],
        f"id string, lat double, lng double, inSchoolBuilding {host}")
    got = {r["check"]: (r["level"], r["failing"]) for r in Q.check_hosts(programs, schools).collect()}
    assert got == {"host-is-co-located": ("fail", 3), "host-serves-when-possible": ("fail", 1)}
