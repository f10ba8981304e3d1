"""Cards and directory search: ZIP, radius, box, facets, features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.geo import distance_text, miles
from gazetteer.functions.regex import SPACE
from gazetteer.functions.text import label, tidy_org
from gazetteer.functions.values import intersect_vocab, literal_array, union_ordered
from gazetteer.operators.order import first_per
from gazetteer.operators.spatial import METRES_PER_MILE, nearest, within
from gazetteer.session import cut_lineage


def card_subjects(subjects: Column, tools: Column) -> Column:
    """Subjects, then tools that are themselves subjects; display labels."""
    return F.transform(
        union_ordered(subjects, intersect_vocab(tools, vocab.TOOLS_THAT_ARE_SUBJECTS)), label
    )


def to_cards(programs: DataFrame) -> DataFrame:
    """Trimmed search row of each program; every fallback says so."""
    area, kind = F.col("programArea"), F.col("programType")
    stated = F.coalesce(
        (F.col("cost.source") == "provider-website")
        & (F.col("enrichment.method") == vocab.MODEL_METHOD), F.lit(False))
    tier = F.col("cost.tier")
    cost = (
        F.when(area == vocab.FREE_AREA, "Free")
        .when(stated & (tier == "free"), "Free")
        .when(stated & (tier == "sliding-scale"), "Sliding scale")
        .when(stated & (tier == "paid"), "Paid")
        .otherwise("Ask provider")
    )
    detail = (
        F.when(area == vocab.FREE_AREA, "Free · DYCD COMPASS")
        .when(stated & (tier == "free"), "Free · per provider")
        .when(stated & (tier == "sliding-scale"), "Sliding scale · per provider")
        .when(stated & (tier == "paid"), "Paid · ask provider for fees")
        .otherwise("DYCD-funded · fees not published")
    )
    days = F.coalesce(
        F.col("enrichment.hoursText"),
        F.when(kind.isin("COMPASS Elementary", "COMPASS SONYC Pilot"), "Mon–Fri · 3 hrs a day")
        .when(area == "Beacon", "Afternoons, evenings & weekends")
        .when(area == "Cornerstone", "Year-round · NYCHA center")
        .otherwise("Ask provider"),
    )
    seats = F.when(
        F.coalesce(F.col("seats"), F.lit(0.0)) != 0,
        F.concat(
            F.when(F.col("seats") == F.floor("seats"), F.col("seats").cast("bigint").cast("string"))
            .otherwise(F.col("seats").cast("string")),
            F.lit(" funded seats"),
        ),
    ).otherwise("Ask provider")
    place = F.array_join(
        F.filter(F.array("address.neighborhood", "address.borough"),
                 lambda x: x.isNotNull() & (x != "")), ", ")
    return programs.select(
        "_ord", "id", F.col("provider").alias("provider"),
        F.coalesce("name", F.lit("After-school program")).alias("name"),
        tidy_org(F.col("provider")).alias("org"),
        place.alias("neighborhood"),
        F.coalesce("address.borough", F.lit("")).alias("borough"),
        F.coalesce("address.zip", F.lit("")).alias("zip"),
        F.regexp_replace(F.coalesce("ageRange", F.lit("Ask provider")), f"{SPACE}*-{SPACE}*", "–").alias("ages"),
        cost.alias("cost"), detail.alias("costDetail"),
        card_subjects(F.col("enrichment.subjects"), F.col("enrichment.stemTools")).alias("subjects"),
        F.transform("enrichment.stemTools", label).alias("tools"),
        days.alias("days"), seats.alias("seats"),
        F.when(F.col("inSchoolBuilding.servesK5"), "In school").alias("tag"),
        F.coalesce("enrichment.website", F.lit(vocab.SIGNUP_PORTAL)).alias("signupUrl"),
        "lat", "lng",
    )


def to_catalog(cards: DataFrame) -> DataFrame:
    """Question-answering row of each card."""
    ages = F.lower("ages")

    def says(*forms: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(ages, F.lit(f)) for f in forms])

    low = F.when(says("4+"), 4).otherwise(5)
    low = F.when(says("k–12", "k-12", "k–5", "k-5"), 5).otherwise(low)
    high = (
        F.when(says("k–12", "k-12"), 18).when(says("k–5", "k-5"), 11)
        .when(says("4+"), 18).when(says("5–20", "5-20"), 20).otherwise(11)
    )
    school_week = F.col("days").rlike("(?i)mon–fri|mon-fri")
    evening = F.col("days").rlike("(?i)evening")
    kind = F.when(school_week, "after-school").when(evening, "evenings").otherwise("unknown")
    open_days = (
        F.when(school_week, literal_array(vocab.WEEKDAYS))
        .when(evening, literal_array([*vocab.WEEKDAYS, "saturday", "sunday"]))
        .otherwise(F.array().cast("array<string>"))
    )
    return cards.select(
        "_ord", "id", "name", "org",
        F.array_join(F.filter(F.array("org", "tag"), lambda x: x.isNotNull() & (x != "")), " · ").alias("summary"),
        F.when(F.col("neighborhood") != "", F.col("neighborhood"))
        .when(F.col("borough") != "", F.col("borough")).otherwise("NYC").alias("location"),
        F.col("borough").alias("area"),
        F.trim(F.regexp_replace("neighborhood", ",.*$", "")).alias("neighborhood"),
        "zip", F.lit("").alias("schoolName"),
        F.col("days").alias("hoursLabel"), kind.alias("hoursKind"), open_days.alias("days"),
        F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"),
        F.when(F.col("cost") == "Free", 0).alias("cost"),
        F.when(F.col("costDetail") != "", F.col("costDetail")).otherwise(F.col("cost")).alias("costLabel"),
        "ages", low.alias("ageMin"), high.alias("ageMax"),
        F.transform(F.array_distinct(F.transform(F.concat("subjects", "tools"), F.lower)), lambda t: t).alias("topics"),
        "signupUrl", "lat", "lng",
    )


# --- place searches -----------------------------------------------------------

def _located(df: DataFrame) -> DataFrame:
    return df.where("lat IS NOT NULL AND lng IS NOT NULL")


def _targets(programs: DataFrame) -> DataFrame:
    return _located(programs).select(
        F.col("id").alias("target"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"),
        F.col("_ord").alias("r_ord"))


def _centres(centroids: DataFrame) -> DataFrame:
    return centroids.select("zip", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))


def deserts(zips: DataFrame, programs: DataFrame) -> DataFrame:
    """ZIPs without a current program, with the miles to the nearest one."""
    empty = zips.where("k5ProgramsNow = 0").select(F.col("zip").alias("point_id"), "lat", "lng")
    return nearest(empty, _targets(programs)).select(
        F.col("point_id").alias("zip"), F.col("target").alias("nearest"), F.col("distance").alias("miles"))


def nearest_zip(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Closest ZIP centre of each point; ties keep the lowest ZIP."""
    targets = centroids.select(
        F.col("zip").alias("target"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"),
        F.col("zip").alias("r_ord"))
    return nearest(points, targets).select(
        "point_id", F.col("target").alias("zip"), F.col("distance").alias("miles"))


def asked_zips(requests: DataFrame) -> DataFrame:
    """Each distinct ZIP asked for, trimmed, with its number of ``requests``."""
    return requests.groupBy(F.trim("zip").alias("zip")).agg(F.count(F.lit(1)).alias("requests"))


def search_zip(
    cards: DataFrame, requests: DataFrame, centroids: DataFrame,
    spill_miles: float = vocab.SPILLOVER_MILES,
) -> DataFrame:
    """Programs in the asked ZIP, nearest first; else those around it.

    One answer per distinct ZIP, which a request reads by its ZIP: rows grow
    with the ZIPs, not with requests times programs.  ``none`` (not a ZIP) and
    ``unknown`` (no centre) return one row without a program: the caller keeps
    its list.
    """
    asked = asked_zips(requests)
    known = asked.select("zip").join(_centres(centroids), "zip")
    own = cards.where("zip <> ''").select("id", "_ord", "zip", "lat", "lng")
    in_zip = (
        known.join(_located(own), "zip")
        .withColumn("miles", miles(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng")))
        .select("zip", "id", "_ord", "miles", F.lit("in-zip").alias("kind"))
    )
    served = _located(own).select("zip").distinct()
    bare = known.join(served, "zip", "left_anti")
    spill = within(
        _located(cards).select("id", "_ord", "lat", "lng"),
        bare.select("zip", F.col("c_lat").alias("r_lat"), F.col("c_lng").alias("r_lng")),
        spill_miles * METRES_PER_MILE, vocab.EARTH_MILES, "miles",
    ).select("zip", "id", "_ord", "miles", F.lit("nearby").alias("kind"))
    answers = in_zip.unionByName(spill)
    status = (
        F.when(~F.col("zip").rlike(r"^\d{5}$"), "none")
        .when(F.col("c_lat").isNull(), "unknown")
        .when(F.col("has_own"), "in-zip").otherwise("nearby")
    )
    return (
        asked.join(_centres(centroids), "zip", "left")
        .join(served.withColumn("has_own", F.lit(True)), "zip", "left")
        .select("zip", "requests", status.alias("kind"))
        .join(answers.drop("kind"), "zip", "left")
        .withColumn("distance", distance_text(F.col("miles")))
    )


def search_radius(
    cards: DataFrame, requests: DataFrame, centroids: DataFrame, radius: float = vocab.RADIUS_MILES
) -> DataFrame:
    """Programs within a radius of each asked ZIP's centre, and how far the nearest is.

    One answer per distinct ZIP, as in ``search_zip``.  Only ZIPs with nothing
    in the radius search further for the nearest program.
    """
    asked = asked_zips(requests)
    known = asked.select("zip").join(_centres(centroids), "zip")
    around = cut_lineage(within(
        _located(cards).select("id", "_ord", "lat", "lng"),
        known.select("zip", F.col("c_lat").alias("r_lat"), F.col("c_lng").alias("r_lng")),
        radius * METRES_PER_MILE, vocab.EARTH_MILES, "miles",
    ).select("zip", "id", "_ord", "miles"))
    closest = around.groupBy("zip").agg(F.min("miles").alias("nearest_miles"))
    bare = known.join(closest, "zip", "left_anti")
    closest = closest.unionByName(nearest(
        bare.select(F.col("zip").alias("point_id"), F.col("c_lat").alias("lat"), F.col("c_lng").alias("lng")),
        _targets(cards),
    ).select(F.col("point_id").alias("zip"), F.col("distance").alias("nearest_miles")))
    measured = _centres(centroids).select("zip", F.lit(True).alias("measured"))
    return (
        asked.join(measured, "zip", "left").join(closest, "zip", "left").join(around, "zip", "left")
        .withColumn("measured", F.coalesce("measured", F.lit(False)))
        .withColumn("distance", distance_text(F.col("miles")))
    )


def in_bounds(df: DataFrame, box: tuple[float, float, float, float], pad: float = 0.0) -> DataFrame:
    """Rows inside (south, north, west, east), the box grown by ``pad`` a side."""
    south, north, west, east = box
    dlat, dlng = (north - south) * pad, (east - west) * pad
    return df.where(
        F.col("lat").between(south - dlat, north + dlat)
        & F.col("lng").between(west - dlng, east + dlng)
    )


COST_FACET = {"Free": lambda: F.col("cost") == "Free", "Ask provider": lambda: F.col("cost") != "Free"}
GRADE_FACET = {
    "Elementary only (K–5)": lambda: F.col("ages") == "Grades K–5",
    "All ages (4 and up)": lambda: F.col("ages") == "Ages 4+",
    "Kids & teens (K–12)": lambda: F.col("ages").isin("Grades K–12", "Ages 5–20"),
}


def facet_filter(
    cards: DataFrame, cost: list[str] = (), grades: list[str] = (), subjects: list[str] = (),
    free_only: bool = False, in_school_only: bool = False,
) -> DataFrame:
    """OR inside a facet, AND across facets; an empty facet passes all."""
    out = cards
    for picked, rules in ((cost, COST_FACET), (grades, GRADE_FACET)):
        if picked:
            out = out.where(reduce(lambda a, b: a | b, [rules[p]() for p in picked]))
    if subjects:
        out = out.where(F.arrays_overlap("subjects", literal_array(subjects)))
    if free_only:
        out = out.where(F.col("cost") == "Free")
    if in_school_only:
        out = out.where(F.col("tag") == "In school")
    return out


def facet_counts(cards: DataFrame, selected: list[str] = ()) -> DataFrame:
    """Options under their headings with counts; empty ones go unless selected."""
    spark = cards.sparkSession
    rows = [
        (heading, g, o, subject)
        for g, (heading, subjects) in enumerate(vocab.SUBJECT_GROUPS.items())
        for o, subject in enumerate(subjects)
    ]
    options = spark.createDataFrame(
        rows, "heading string, group_no int, option_no int, subject string"
    ).select("heading", "group_no", "option_no", label(F.col("subject")).alias("option"))
    counts = cards.select(F.explode("subjects").alias("option")).groupBy("option").agg(
        F.count(F.lit(1)).alias("n"))
    # The option list is a fixed vocabulary, so it may be broadcast.
    return (
        F.broadcast(options).join(counts, "option", "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
        .where((F.col("n") > 0) | F.col("option").isin(list(selected)))
    )


def featured(cards: DataFrame, n: int = 8) -> DataFrame:
    """Best program of each organisation, own photo first; the top ``n`` of those.

    Wants ``own_photo``, ``evidence`` and ``seat_count`` beside the card.
    """
    best = [
        F.desc("own_photo"), F.desc("evidence"), F.desc(F.coalesce("seat_count", F.lit(0.0))),
        F.collate("name", "UNICODE"), F.col("_ord"),
    ]
    return first_per(cards, ["provider"], *best).orderBy(*best).limit(n)


def order_by_name(cards: DataFrame) -> DataFrame:
    return cards.orderBy(F.collate("name", "UNICODE"), "_ord")


