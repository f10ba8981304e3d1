"""Questions answered from the catalog, many at once.

Questions are reduced to their distinct texts, and those to distinct filters,
before the catalog is touched.  The catalog folds into cells: programs alike in
cost, hours, days, ages and topics become one row with their number and the
first few of them.  Cells are folded again for each place or ZIP asked about;
filters meet the cells of their place, never the programs.

Spark estimates the size of questions and of their words from the file they come
from, which may be far too small; such rows are never the broadcast side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions import asking as A
from gazetteer.operators.evidence import keyword_search
from gazetteer.operators.order import top_per
from gazetteer.operators.phrases import contains_join
from gazetteer.operators.spatial import METRES_PER_MILE, within
from gazetteer.session import cut_lineage

FILTERS = [
    "cost", "after_min", "before_min", "hours_kind", "days", "age", "age_group", "topics",
    "places", "near_zip",
]
PLACE_LETTERS = 5  # shorter names and words name no place


def parse_texts(texts: DataFrame) -> DataFrame:
    """The filters each normalised text ``q`` states, beside its other columns."""
    return texts.withColumn("_p", A.parse(F.col("q"))).select(
        *texts.columns, *[F.col(f"_p.{f}").alias(f) for f in FILTERS])


def parse_questions(questions: DataFrame) -> DataFrame:
    """``q`` and the stated filters of each question (qid, question)."""
    return parse_texts(questions.withColumn("q", A.normalize(F.col("question"))))


def place_phrases(catalog: DataFrame) -> DataFrame:
    """Neighbourhood and location names long enough to look for, in catalog order."""
    names = catalog.select("_ord", F.posexplode(F.array("neighborhood", "location")).alias("_at", "_name"))
    phrase = F.trim(F.regexp_replace(F.lower("_name"), ",.*$", ""))
    return names.select(phrase.alias("phrase"), F.struct("_ord", "_at").alias("place_ord")).where(
        F.length("phrase") >= PLACE_LETTERS).groupBy("phrase").agg(F.min("place_ord").alias("place_ord"))


def place_words(catalog: DataFrame) -> DataFrame:
    names = catalog.select("_ord", F.explode(F.array("neighborhood", "location", "area")).alias("_name"))
    words = F.split(F.lower("_name"), "[^a-z0-9]+")
    return (
        names.select("_ord", F.posexplode(words).alias("_at", "word"))
        .where((F.length("word") >= PLACE_LETTERS) & ~F.col("word").isin(vocab.PLACE_SKIP))
        .groupBy("word").agg(F.min(F.struct("_ord", "_at")).alias("place_ord"))
    )


def match_places(parsed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the catalog's own place names to ``places``.

    Names found as phrases join the stated places; single words of names count
    only where nothing else named a place.
    """
    texts = parsed.select("q").distinct()
    phrases = place_phrases(catalog)
    hits = contains_join(
        phrases.select(F.col("phrase").alias("phrase_id"), "phrase"),
        texts.select(F.col("q").alias("text_id"), F.col("q").alias("text")),
    ).join(phrases, F.col("phrase_id") == F.col("phrase")).select(
        F.col("text_id").alias("q"), "phrase", "place_ord")
    # Per question at most the names of the place dictionary it spells out.
    found = hits.groupBy("q").agg(F.transform(
        F.array_sort(F.collect_set(F.struct("place_ord", "phrase"))), lambda x: x["phrase"]).alias("_found"))
    spelled = F.filter(F.array_distinct(F.split("q", "[^a-z0-9_]+")), lambda w: F.length(w) >= PLACE_LETTERS)
    tokens = texts.select("q", F.explode(spelled).alias("word"))
    words = tokens.hint("merge").join(place_words(catalog), "word").groupBy("q").agg(F.transform(
        F.array_sort(F.collect_set(F.struct("place_ord", "word"))), lambda x: x["word"]).alias("_words"))
    none = F.array().cast("array<string>")
    more = F.coalesce("_found", F.when(F.size("places") == 0, F.col("_words")), none)
    return parsed.join(found, "q", "left").join(words, "q", "left").withColumn(
        "places", F.array_distinct(F.concat("places", more))).drop("_found", "_words")


def place_blob(catalog: DataFrame) -> Column:
    parts = F.filter(
        F.array("location", "area", "neighborhood", "zip", "org", "schoolName"),
        lambda x: x.isNotNull() & (x != ""))
    return F.lower(F.array_join(parts, " "))


def _clock(c: str) -> Column:
    return F.split(c, ":")[0].cast("int") * 60 + F.split(c, ":")[1].cast("int")


def _facts_match() -> Column:
    """Cost, hours, days and age of a row against a filter (columns f_*)."""
    free = F.col("is_free")
    cost = F.col("f_cost")
    cost_ok = cost.isNull() | F.when(cost == "free", free).otherwise(~free)
    after, before, kind = F.col("f_after_min"), F.col("f_before_min"), F.col("f_hours_kind")
    start, end = F.col("start_min"), F.col("end_min")
    after_ok = (
        F.when(after.isNull(), True).when(end.isNotNull(), end > after)
        .when(after >= 17 * 60, F.col("hoursKind") == "evenings")
        .otherwise(F.col("hoursKind") != "unknown")
    )
    before_ok = before.isNull() | F.coalesce(start < before, F.lit(False))
    kind_ok = (
        F.when(kind.isNull(), True).when(kind == "evenings", F.col("hoursKind") == "evenings")
        .otherwise(F.col("hoursKind").isin("after-school", "evenings"))
    )
    days_ok = F.col("f_days").isNull() | F.arrays_overlap("f_days", "days")
    age_ok = F.col("f_age").isNull() | F.col("f_age").between(F.col("ageMin"), F.col("ageMax"))
    low, high = F.col("ageMin"), F.col("ageMax")
    group_ok = (
        F.when(F.col("f_age_group") == "teen", (high >= 13) & (low <= 18))
        .when(F.col("f_age_group") == "kid", (high >= 5) & (low <= 12)).otherwise(True)
    )
    return cost_ok & after_ok & before_ok & kind_ok & days_ok & age_ok & group_ok


PROFILE = ["is_free", "hoursKind", "start_min", "end_min", "days", "ageMin", "ageMax"]


def searchable(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "_ord", "id", "lat", "lng", place_blob(catalog).alias("blob"),
        F.coalesce(F.col("cost") == 0, F.lit(False)).alias("is_free"), "hoursKind",
        _clock("start").alias("start_min"), _clock("end").alias("end_min"), "days", "ageMin", "ageMax",
        A.topic_hits(F.col("topics")).alias("topic_hits"),
    )


def near_zip(
    zips: DataFrame, catalog: DataFrame, centroids: DataFrame, miles: float = vocab.NEAR_RADIUS_MILES
) -> DataFrame:
    """Programs within a radius of each asked ZIP (column ``near_zip``) that is known."""
    known = zips.select("near_zip").distinct().join(
        centroids.select(F.col("zip").alias("near_zip"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng")),
        "near_zip")
    return within(
        catalog.select("id", "lat", "lng"), known, miles * METRES_PER_MILE, vocab.EARTH_MILES, "miles"
    ).select("near_zip", "id", "miles")


def _folded(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Merge folded rows: one per ``keys`` with its ``size`` and its ``first`` n programs.

    A folded row stands for many programs: their number and the first few of
    them as sorted structs.  Folding folded rows gives the same as folding the
    programs, so the same step serves at every level.
    """
    lead = top_per(rows.select(*keys, F.explode("first").alias("_lead")), keys, [F.col("_lead")], n).drop("_rn")
    sizes = rows.select(*keys, "size", F.lit(None).cast(lead.schema["_lead"].dataType).alias("_lead"))
    both = sizes.unionByName(lead.withColumn("size", F.lit(0).cast("bigint")))
    return both.groupBy(*keys).agg(F.sum("size").alias("size"), F.array_sort(F.collect_list("_lead")).alias("first"))


def _single(miles: Column) -> list[Column]:
    """A program as a folded row of its own, placed by distance and catalog order."""
    at = F.struct(miles.cast("double").alias("miles"), F.col("_ord").alias("_ord"), F.col("id").alias("id"))
    return [F.lit(1).cast("bigint").alias("size"), F.array(at).alias("first")]


def region_cube(regions: DataFrame, catalog: DataFrame, centroids: DataFrame, n: int = vocab.RESULT_LIMIT) -> DataFrame:
    """Programs of each region by what else a filter may ask: (region, cell, size, first).

    ``regions``: region, f_near_zip, f_places; region ``''`` is the whole
    catalog.  Programs fold by place text and cell before any region is met, so
    a region meets place texts or ZIPs, never programs one by one.  A program
    has one place text, so no program is counted twice where a region names
    several places.
    """
    rows = searchable(catalog).withColumn("cell", F.struct(*PROFILE, "topic_hits"))
    by_blob = cut_lineage(_folded(rows.select("blob", "cell", *_single(F.lit(None))), ["blob", "cell"], n))
    whole = _folded(by_blob.drop("blob"), ["cell"], n).withColumn("region", F.lit(""))

    placed = regions.where("region <> '' AND f_near_zip IS NULL")
    spoken = placed.select("region", F.explode("f_places").alias("place"))
    in_blob = contains_join(
        spoken.select(F.col("place").alias("phrase_id"), F.col("place").alias("phrase")).distinct(),
        by_blob.select(F.col("blob").alias("text_id"), F.col("blob").alias("text")).distinct())
    in_region = spoken.join(in_blob, F.col("place") == F.col("phrase_id")).select(
        "region", F.col("text_id").alias("blob")).distinct()
    by_place = _folded(in_region.join(by_blob, "blob").drop("blob"), ["region", "cell"], n)

    near = regions.where("f_near_zip IS NOT NULL")
    pool = near_zip(near.select(F.col("f_near_zip").alias("near_zip")), rows, centroids)
    pool = pool.join(rows.select("id", "_ord", "blob", "cell"), "id")
    by_zip = _folded(pool.select("near_zip", "blob", "cell", *_single(F.col("miles"))), ["near_zip", "blob", "cell"], n)
    told = (F.size("f_places") == 0) | F.exists("f_places", lambda p: F.contains(F.col("blob"), p))
    by_near = _folded(
        near.join(by_zip, F.col("f_near_zip") == F.col("near_zip")).where(told).select("region", "cell", "size", "first"),
        ["region", "cell"], n)
    return whole.unionByName(by_place).unionByName(by_near)


def match_filters(filters: DataFrame, catalog: DataFrame, centroids: DataFrame, n: int = vocab.RESULT_LIMIT) -> DataFrame:
    """First ``n`` programs of each distinct filter (``sig``), with the full count.

    A filter meets the cells of its region: what is asked beside the place has
    few values, and a cell carries its number of programs and its first ``n``.
    """
    asked = filters.select("sig", *[F.col(f).alias(f"f_{f}") for f in FILTERS])
    anywhere = F.col("f_near_zip").isNull() & (F.size("f_places") == 0)
    asked = asked.withColumn("region", F.when(anywhere, "").otherwise(F.to_json(F.struct("f_near_zip", "f_places"))))
    regions = asked.select("region", "f_near_zip", "f_places").dropDuplicates(["region"])
    cube = cut_lineage(region_cube(regions, catalog, centroids, n))
    topics_ok = (F.size("f_topics") == 0) | F.arrays_overlap("f_topics", "topic_hits")
    fits = asked.join(cube, "region").select(*asked.columns, "cell.*", "size", "first").where(_facts_match() & topics_ok)
    found = _folded(fits.select("sig", "size", "first"), ["sig"], n)
    return found.select("sig", F.col("size").alias("total"), F.posexplode("first").alias("_at", "_lead")).select(
        "sig", F.col("_lead.id").alias("id"), (F.col("_at") + 1).alias("place"), "total")


def has_filters() -> Column:
    any_set = [F.col(c).isNotNull() for c in (
        "cost", "after_min", "before_min", "days", "age", "age_group", "hours_kind", "near_zip")]
    return reduce(lambda a, b: a | b, any_set) | (F.size("topics") > 0) | (F.size("places") > 0)


def named_programs(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Programs whose name a question spells out: (q, id, _ord)."""
    names = catalog.select(F.lower("name").alias("phrase")).where("phrase <> ''").distinct()
    hits = contains_join(
        names.select(F.col("phrase").alias("phrase_id"), "phrase"),
        texts.select(F.col("q").alias("text_id"), F.col("q").alias("text")))
    return hits.join(catalog.select(F.lower("name").alias("phrase_id"), "id", "_ord"), "phrase_id").select(
        F.col("text_id").alias("q"), "id", "_ord")


def catalog_text(catalog: DataFrame) -> DataFrame:
    """Everything a keyword may hit in a program."""
    parts = F.concat_ws(
        " ", "name", F.coalesce("summary", F.lit("")), F.array_join("topics", " "), place_blob(catalog))
    return catalog.select(F.col("id").alias("text_id"), F.lower(parts).alias("text"))


def route_questions(questions: DataFrame, catalog: DataFrame, centroids: DataFrame) -> dict[str, DataFrame]:
    """Send each question down the first way that fits.

    ``routes``: every question with its filters, ``sig`` and ``route`` (empty,
    greeting, help, faq, named, unknown-zip, filters, overview, keyword, none).
    ``named`` and ``keyword``: programs found by those ways.
    """
    q = F.col("q")
    asked = questions.withColumn("q", A.normalize(F.col("question")))
    # Each distinct text is worked on once; several ways read it, so it is kept.
    texts = cut_lineage(asked.select("q").distinct())
    parsed = cut_lineage(match_places(parse_texts(texts), catalog))
    named = cut_lineage(named_programs(texts, catalog))
    named_counts = named.groupBy("q").agg(F.count(F.lit(1)).alias("_named"))
    known = centroids.select(F.col("zip").alias("near_zip")).withColumn("_known", F.lit(True))

    others = ["cost", "age", "days", "hours_kind", "after_min", "before_min", "near_zip"]
    only_group = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in others]) & (
        F.size("topics") == 0) & (F.size("places") == 0)
    listing = A.asks_where(q) | A.asks_for_list(q)
    settled = (
        parsed.withColumn("age_group", F.when(~(only_group & ~listing), F.col("age_group")))
        .join(named_counts, "q", "left").join(known, "near_zip", "left")
    )
    settled_route = (
        F.when(q == "", "empty")
        .when(A.says(q, A.GREETING), "greeting")
        .when(A.says(q, A.HELP), "help")
        .when(A.faq_topic(q).isNotNull(), "faq")
        .when(F.col("_named").between(1, vocab.NAMED_LIMIT), "named")
        .when(F.col("near_zip").isNotNull() & F.col("_known").isNull(), "unknown-zip")
        .when(has_filters(), "filters")
        .when(listing, "overview")
    )
    first = cut_lineage(
        settled.withColumn("route", settled_route).withColumn("where_asked", A.asks_where(q))
        .withColumn("sig", F.sha2(F.to_json(F.struct(*FILTERS, "where_asked")), 256))
        .drop("_named", "_known"))
    # Only what no other way took is looked up word by word.
    open_texts = first.where("route IS NULL").select(F.col("q").alias("qid"), "q")
    hits = cut_lineage(keyword_search(open_texts, catalog_text(catalog)))
    keyword = hits.join(catalog.select(F.col("id").alias("text_id"), "_ord"), "text_id").select(
        F.col("qid").alias("q"), F.col("text_id").alias("id"), "_ord")
    any_hit = hits.select(F.col("qid").alias("q")).distinct().withColumn("_hit", F.lit(True))
    routes = first.join(any_hit, "q", "left").withColumn("route", F.coalesce(
        "route", F.when(F.col("_hit"), "keyword"), F.lit("none"))).drop("_hit")
    routed = asked.hint("merge").join(routes, "q")
    return {"routes": routed, "named": named, "keyword": keyword}


def distinct_filters(routes: DataFrame) -> DataFrame:
    kept = routes.where("route = 'filters'").select("sig", "where_asked", *FILTERS)
    return cut_lineage(kept.dropDuplicates(["sig"]))


def filter_label() -> Column:
    late = F.coalesce(F.col("after_min") >= 17 * 60, F.lit(False))
    after = F.concat(F.lit("open after "), A.minutes_to_text(F.col("after_min")))
    bits = F.array(
        F.when(F.col("cost") == "unknown", "ask-provider").otherwise(F.col("cost")),
        F.when(F.coalesce(F.col("hours_kind") == "evenings", F.lit(False)) | late, F.coalesce(after, F.lit("evening")))
        .otherwise(after),
        F.concat(F.lit("starting before "), A.minutes_to_text(F.col("before_min"))),
        F.when(F.col("hours_kind") == "after-school", "after school"),
        F.when(F.coalesce(F.col("hours_kind"), F.lit("")) != "after-school", F.array_join("days", " or ")),
        F.concat(F.lit("age "), F.col("age").cast("string")),
        F.when(F.col("age_group") == "teen", "teens").when(F.col("age_group") == "kid", "kids"),
        F.when(F.size("topics") > 0, F.array_join("topics", " or ")),
    )
    return F.array_join(F.array_compact(bits), " ")


def place_phrase() -> Column:
    places = F.array_join(F.transform("places", A.title_case), " or ")
    inside = F.when(F.size("places") > 0, F.concat(F.lit("in "), places)).otherwise("")
    near = F.concat(
        F.lit(f"within {vocab.NEAR_RADIUS_MILES:g} miles of "), F.col("near_zip"),
        F.when(F.size("places") > 0, F.concat(F.lit(" in "), places)).otherwise(""))
    return F.when(F.col("near_zip").isNotNull(), near).otherwise(inside)


def render_answers(
    filters: DataFrame, matches: DataFrame, catalog: DataFrame, catalog_size: Column, site: str = "this directory",
    n: int = vocab.RESULT_LIMIT,
) -> DataFrame:
    """Answer text of each distinct filter: intro, spoken line, programs shown."""
    names = matches.join(catalog.select("id", "name"), "id")
    # At most n programs per filter meet here.
    listed = names.groupBy("sig").agg(
        F.max("total").alias("total"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "name"))), lambda x: x["id"]).alias("ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
    out = filters.join(listed, "sig", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
    label, place = filter_label(), place_phrase()
    looked_for = F.array_join(F.filter(F.array(label, place), lambda x: x != ""), " ")
    noun = F.when(F.col("total") == 1, "program").otherwise("programs")
    described = F.concat(F.when(label != "", F.concat(label, F.lit(" "))).otherwise(""), noun)
    there = F.concat(described, F.when(place != "", F.concat(F.lit(" "), place)).otherwise(""), F.lit(":"))
    more = _more(F.col("total"), n)
    nothing = F.concat(
        F.lit("I couldn't find a program that matches "), looked_for, F.lit(". I only know the "),
        catalog_size.cast("string"),
        F.lit(f" NYC programs listed for {site}. Try a borough, ZIP, or a topic like robotics."))
    intro = (
        F.when(F.col("total") == 0, nothing)
        .when(F.col("where_asked"), F.concat(F.lit("Here's where to find "), there, more))
        .otherwise(F.concat(F.lit("I found "), F.col("total").cast("string"), F.lit(" "), there, more))
    )
    first = F.array_join(F.slice("names", 1, 3), ", ")
    spoken = F.when(F.col("total") == 0, F.col("intro")).otherwise(F.concat(
        F.col("intro"), F.lit(" The first programs are "), first,
        F.when(F.size("names") > 3, F.concat(
            F.lit(", and "), (F.size("names") - 3).cast("string"), F.lit(" more"))).otherwise(""),
        F.lit(".")))
    return out.withColumn("intro", intro).withColumn("spoken", spoken)


def _more(total: Column, n: int) -> Column:
    return F.when(total > n, F.concat(
        F.lit(f" Showing {n} of "), total.cast("string"), F.lit(". Add a borough, ZIP, or topic to narrow it."))).otherwise("")


def _detail() -> Column:
    """What is known of one program, in a sentence or two."""
    near, area = F.col("neighborhood"), F.col("area")
    apart = (near != "") & (area != "") & ~F.contains(F.lower(near), F.lower(area))
    place = F.when(apart, F.concat(near, F.lit(", "), area)).when(near != "", near).when(area != "", area).when(
        F.col("location") != "", F.col("location")).otherwise("NYC")
    hours = F.coalesce(F.nullif("hoursLabel", F.lit("")), F.lit("Hours not published"))
    cost = F.coalesce(F.nullif("costLabel", F.lit("")), F.when(F.col("cost") == 0, "Free").otherwise("Ask provider"))
    org = F.when(F.col("org") != "", F.concat(F.lit(" Run by "), "org", F.lit("."))).otherwise("")
    summary = F.when(F.col("summary") != "", F.concat(F.lit(" "), "summary")).otherwise("")
    return F.concat("name", F.lit(" is in "), place, F.lit(", "), hours, F.lit(". "), cost, F.lit(", "), "ages", F.lit("."), org, summary)


def answer_questions(
    routed: dict[str, DataFrame], catalog: DataFrame, centroids: DataFrame, site: str = "this directory",
    n: int = vocab.RESULT_LIMIT,
) -> DataFrame:
    """The answer to each distinct question, by whichever way it went: q, route, intro, ids, total, spoken.

    ``routed`` is what ``route_questions`` returned.  At most ``n`` programs of
    an answer meet in one place; totals are counted beside them.
    """
    size = catalog.agg(F.count(F.lit(1)).alias("n")).scalar()
    asked = routed["routes"].dropDuplicates(["q"])
    told = catalog.select("id", "_ord", "name", _detail().alias("line"))

    def listed(hits: DataFrame) -> DataFrame:
        """Number and first programs of each question, in catalog order."""
        totals = hits.groupBy("q").agg(F.count(F.lit(1)).alias("total"))
        first = top_per(hits.select("q", "id", "_ord"), ["q"], [F.col("_ord")], n).drop("_ord")
        rows = F.array_sort(F.collect_list(F.struct("_rn", "id", "name", "line")))
        return first.join(told, "id").groupBy("q").agg(rows.alias("rows")).join(totals, "q")

    named = listed(routed["named"].join(asked.where("route = 'named'").select("q"), "q", "left_semi"))
    named = named.withColumns({"total": F.size("rows").cast("bigint"), "intro": F.array_join("rows.line", "\n\n")})
    keyword = listed(routed["keyword"].join(asked.where("route = 'keyword'").select("q"), "q", "left_semi"))
    keyword = keyword.withColumn("intro", F.concat(F.lit(vocab.ANSWERS["keyword"]), _more(F.col("total"), n)))
    by_hand = named.unionByName(keyword).select("q", "total", "intro", F.col("rows.id").alias("ids"), F.col("rows.name").alias("names"))

    filters = distinct_filters(routed["routes"])
    rendered = render_answers(filters, match_filters(filters, catalog, centroids, n), catalog, size, site, n)
    rendered = asked.where("route = 'filters'").select("q", "sig").join(
        rendered.select("sig", "total", "intro", "ids", "names"), "sig").drop("sig")

    words = {"{site}": F.lit(site), "{Site}": F.lit(site[:1].upper() + site[1:]), "{total}": size.cast("string"), "{zip}": F.col("near_zip")}

    def text(fixed: str) -> Column:
        out = F.lit(fixed)
        for mark, value in words.items():
            out = F.replace(out, F.lit(mark), value) if mark in fixed else out
        return out

    topic = A.faq_topic(F.col("q"))
    fixed = F.coalesce(
        *[F.when(F.col("route") == r, text(t)) for r, t in vocab.ANSWERS.items() if r != "keyword"],
        *[F.when((F.col("route") == "faq") & (topic == k), text(t)) for k, t in vocab.FAQ_ANSWERS.items()])
    none = F.array().cast("array<string>")
    plain = asked.where(~F.col("route").isin("named", "keyword", "filters")).select(
        "q", F.lit(0).cast("bigint").alias("total"), fixed.alias("intro"), none.alias("ids"), none.alias("names"))
    answers = by_hand.unionByName(rendered).unionByName(plain)
    names = F.coalesce("names", none)
    aloud = F.trim(F.regexp_replace("intro", r"\s+", " "))
    spoken = F.when(F.size(names) == 0, aloud).otherwise(F.concat(
        aloud, F.lit(" The first programs are "), F.array_join(F.slice(names, 1, 3), ", "),
        F.when(F.size(names) > 3, F.concat(F.lit(", and "), (F.size(names) - 3).cast("string"), F.lit(" more"))).otherwise(""), F.lit(".")))
    return asked.select("q", "route").join(answers, "q").select(
        "q", "route", "intro", F.coalesce("ids", none).alias("ids"), "total", spoken.alias("spoken"))
