"""From public records to the published dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.text import domain_candidates, name_signals
from gazetteer.functions.values import (
    blank_to_null, empty_strings, null_if, num, serves_k5, stable_id,
)
from gazetteer.operators.order import first_per, top_per
from gazetteer.operators.spatial import preferred_schools, with_schools


def filter_cohort(
    sites: DataFrame, year: str = vocab.PROGRAM_YEAR, bands: list[str] | None = None
) -> DataFrame:
    return sites.where(
        (F.col("date") == year) & F.col("age_range").isin(bands or vocab.K5_AGE_RANGES)
    )


def project_schools(raw: DataFrame) -> DataFrame:
    grades = F.coalesce("grades_final_text", "grades_text")
    return raw.select(
        "_ord",
        F.col("system_code").alias("dbn"),
        F.col("location_name").alias("name"),
        grades.alias("grades"),
        F.col("location_category_description").alias("category"),
        F.col("primary_address_line_1").alias("address"),
        F.col("geographical_district_code").alias("district"),
        F.col("principal_name").alias("principal"),
        F.col("principal_phone_number").alias("phone"),
        num(F.col("latitude")).alias("lat"),
        num(F.col("longitude")).alias("lng"),
        serves_k5(grades).alias("serves_k5"),
    ).where("lat IS NOT NULL AND lng IS NOT NULL")


def published_schools(schools: DataFrame) -> DataFrame:
    return schools.select(
        "dbn", "name", "grades", "category", "address", "district", "principal",
        "phone", "lat", "lng", F.col("serves_k5").alias("servesK5"),
    )


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, out: str) -> DataFrame:
    """Code to name; a code used twice takes the name of its last row by ``_ord``, or the greatest without one."""
    last = "_ord" if "_ord" in dim.columns else value
    names = dim.groupBy(F.col(dim_key).alias(key)).agg(F.max_by(value, last).alias(out))
    return df.join(names, key, "left")


def fold_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def roster(sites: DataFrame) -> DataFrame:
    """Distinct organisations with their site counts and sorted boroughs."""
    named = sites.withColumn("provider", fold_ends(F.col("provider"))).where("provider <> ''")
    return (
        named.groupBy("provider")
        .agg(
            F.count(F.lit(1)).alias("site_count"),
            F.array_sort(F.collect_set("borough")).alias("boroughs"),
        )
        .withColumn("candidates", domain_candidates(F.col("provider")))
        .withColumn("signals", name_signals(F.col("provider")))
    )


def in_roster_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("site_count"), F.collate("provider", "UNICODE"), "provider")


def merge_prior(new: DataFrame, prior: DataFrame, keep: list[str], key: str = "provider") -> DataFrame:
    """A rebuilt roster keeps what earlier runs, or people, established."""
    known = first_per(prior, [key], F.desc("_ord")).select(
        key, *[F.col(c).alias(f"_prior_{c}") for c in keep]
    )
    joined = new.join(known, key, "left")
    for c in keep:
        old = F.col(f"_prior_{c}")
        joined = joined.withColumn(c, F.coalesce(old, F.col(c)) if c in new.columns else old)
    return joined.drop(*[f"_prior_{c}" for c in keep])


def last_per_provider(df: DataFrame) -> DataFrame:
    """Dimension with one row per organisation; a later row replaces an earlier one."""
    return first_per(
        df.withColumn("provider", fold_ends(F.col("provider"))), ["provider"], F.desc("_ord")
    )


def photo_rank() -> list[Column]:
    """Photos before flyers, carousel-ready, suitability, size; all ascending."""
    return [
        F.coalesce(F.col("kind") == "flyer", F.lit(False)).cast("int"),
        -F.coalesce(F.col("carousel_ready"), F.lit(False)).cast("int"),
        -F.coalesce(F.col("suitability"), F.lit(0)),
        -(F.col("width") * F.col("height")),
        F.col("_ord"),
    ]


def nested_photos(photos: DataFrame, limit: int = vocab.IMAGES_PER_PROVIDER) -> DataFrame:
    """Per organisation its best photos as one ordered array.

    An organisation never has more than ``limit`` judged photos, so the array
    is bounded; the rest stays in the flat ledger.
    """
    best = top_per(
        photos.withColumn("provider", fold_ends(F.col("provider"))),
        ["provider"], photo_rank(), limit,
    )
    record = F.struct(
        F.col("_rn"),
        F.col("url"), F.col("page").alias("sourcePage"),
        (F.coalesce(F.col("caption"), F.col("alt")) if "caption" in photos.columns
         else F.col("alt")).alias("caption"),
        F.col("width"), F.col("height"),
        F.round(F.col("width") / F.greatest(F.col("height"), F.lit(1)), 3).alias("aspect"),
        orientation(F.col("width") / F.greatest(F.col("height"), F.lit(1))).alias("orientation"),
        F.coalesce(F.col("carousel_ready"), F.lit(False)).alias("carouselReady"),
        F.when(F.col("judged"), F.col("kind")).alias("kind"),
        empty_strings().alias("visibleTools"),
        F.coalesce(F.col("judged"), F.lit(False)).alias("judged"),
        F.col("suitability").alias("suitability"),
    )
    return (
        best.groupBy("provider")
        .agg(F.array_sort(F.collect_list(record)).alias("photos"))
        .withColumn("photos", F.transform("photos", lambda p: p.dropFields("_rn")))
    )


def orientation(aspect: Column) -> Column:
    return F.when(aspect >= 1.2, "landscape").when(aspect <= 0.83, "portrait").otherwise("square")


def derive_cost(contract: Column, area: Column, tier: Column, method: Column) -> Column:
    """Price tier with its source; a keyword match never sets a price."""
    funded = F.coalesce((contract != "") & (contract != "NULL"), F.lit(False))
    stated = F.when(
        ~F.coalesce(method == vocab.KEYWORD_METHOD, F.lit(False)) & (tier != "unknown") & (tier != ""),
        tier,
    )

    def record(tier: Column, source: str, note: Column) -> Column:
        return F.struct(
            tier.alias("tier"), F.lit(source).alias("source"),
            funded.alias("publiclyFunded"), note.alias("note"),
        )

    stated_note = F.concat(
        F.lit("Stated on the provider's own site ("),
        F.coalesce(method, F.lit("extracted")), F.lit(")."),
    )
    unknown_note = F.when(
        funded,
        F.concat(
            F.lit("DYCD-contracted "), F.coalesce(area, F.lit("program")),
            F.lit("; the City does not publish a family fee, so cost is unconfirmed."),
        ),
    ).otherwise(F.lit("No cost information published."))
    return (
        F.when(
            F.coalesce(area == vocab.FREE_AREA, F.lit(False)),
            record(F.lit("free"), vocab.COST_SOURCES[0], F.lit(vocab.COST_RULE_NOTE)),
        )
        .when(stated.isNotNull(), record(stated, vocab.COST_SOURCES[1], stated_note))
        .otherwise(record(F.lit("unknown"), vocab.COST_SOURCES[2], unknown_note))
    )


def core_programs(sites: DataFrame) -> DataFrame:
    """Cohort sites, typed, with a stable id; the first row of an id wins."""
    typed = filter_cohort(sites).select(
        "_ord",
        stable_id(F.col("program_site_name"), F.col("street_address"), F.col("zipcode")).alias("id"),
        F.col("program_site_name").alias("name"),
        fold_ends(F.col("provider")).alias("provider"),
        F.col("program_area").alias("area"),
        F.col("program_type").alias("type"),
        F.col("age_range"),
        F.col("street_address").alias("street"), F.col("city"), F.col("borough"),
        F.col("zipcode").alias("zip"),
        F.col("nta"),
        num(F.col("latitude")).alias("lat"), num(F.col("longitude")).alias("lng"),
        num(F.col("totalslots")).alias("seats"),
        num(F.col("totalparticipants")).alias("participants"),
        F.col("contract"),
    )
    return first_per(typed, ["id"], F.col("_ord"))


def fan_out(
    programs: DataFrame, providers: DataFrame, facts: DataFrame, photos: DataFrame
) -> DataFrame:
    """Work done once per organisation, joined to each of its sites.

    Each dimension holds one row per organisation, so a join never multiplies
    rows; AQE broadcasts a small dimension and splits a hot organisation.
    """
    return (
        programs.join(providers, "provider", "left")
        .join(facts, "provider", "left")
        .join(photos, "provider", "left")
    )


def build_programs(
    sites: DataFrame, schools: DataFrame, nta_names: DataFrame,
    providers: DataFrame, facts: DataFrame, photos: DataFrame,
) -> DataFrame:
    """The published program table: one nested record per site.

    ``_shared`` tells whether two schools or more are in radius, for those who do not read their list.
    """
    core = core_programs(sites)
    school = F.struct(
        F.col("dbn"), F.col("school_name").alias("name"),
        F.col("distance_m").alias("distanceM"), F.col("serves_k5").alias("servesK5"),
    )
    host = preferred_schools(core, schools).select("id", school.alias("host"), "shared")
    named = lookup(core, nta_names, "nta", "nta_code", "nta_name", "neighborhood")
    provider_dim = last_per_provider(providers).select(
        "provider", F.col("website").alias("p_website"),
        F.col("confidence").alias("p_confidence"), F.col("source").alias("p_source"),
    )
    fact_dim = last_per_provider(facts).select(
        "provider", "summary", "stem_tools", "subjects", "subject_evidence", "activities",
        "hours_text", "contact_email", "contact_phone", "evidence", "cost_tier", "method",
        "fact_confidence",
    )
    full = fan_out(named, provider_dim, fact_dim, nested_photos(photos)).join(host, "id", "left")
    full = with_schools(full, schools, "co")  # last, so that no join moves the lists
    photo_list = F.coalesce(F.col("photos"), F.array().cast(_type_of(full, "photos")))
    co_list = F.coalesce(F.col("co"), F.array().cast(_type_of(full, "co")))

    def strings(name: str) -> Column:
        return F.coalesce(F.col(name), empty_strings())

    quotes = F.array().cast("array<struct<subject:string,quote:string>>")
    return full.select(
        "_ord", F.coalesce("shared", F.lit(False)).alias("_shared"), "id", "name", "provider",
        F.col("area").alias("programArea"), F.col("type").alias("programType"),
        F.col("age_range").alias("ageRange"),
        F.struct(
            "street", "city", "borough", "zip", null_if(F.col("nta")).alias("nta"), "neighborhood"
        ).alias("address"),
        "lat", "lng", "seats", "participants",
        derive_cost(F.col("contract"), F.col("area"), F.col("cost_tier"), F.col("method")).alias("cost"),
        F.col("host").alias("inSchoolBuilding"),
        co_list.alias("coLocatedSchools"),
        F.struct(
            F.col("p_website").alias("website"),
            F.coalesce(F.col("p_confidence"), F.lit("unresolved")).alias("websiteConfidence"),
            F.col("p_source").alias("websiteSource"),
            blank_to_null(F.col("summary")).alias("summary"),
            strings("stem_tools").alias("stemTools"),
            strings("subjects").alias("subjects"),
            F.coalesce(F.col("subject_evidence"), quotes).alias("subjectEvidence"),
            strings("activities").alias("activities"),
            blank_to_null(F.col("hours_text")).alias("hoursText"),
            blank_to_null(F.col("contact_email")).alias("contactEmail"),
            blank_to_null(F.col("contact_phone")).alias("contactPhone"),
            strings("evidence").alias("evidence"),
            F.col("method"), F.col("fact_confidence").alias("confidence"),
        ).alias("enrichment"),
        photo_list.alias("photos"),
        with_provenance(F.col("host"), F.col("method"), photo_list).alias("provenance"),
    )


def _type_of(df: DataFrame, name: str):
    return df.schema[name].dataType


def with_provenance(host: Column, method: Column, photos: Column) -> Column:
    """Which source each part of a record comes from."""
    return F.struct(
        F.lit(vocab.CORE_SOURCE).alias("core"),
        F.when(host.isNotNull(), F.lit(vocab.SCHOOL_SOURCE)).alias("schoolMatch"),
        F.coalesce(method, F.lit("none")).alias("enrichment"),
        F.when(F.exists(photos, lambda p: p["judged"]), f"{vocab.MODEL_METHOD}-vision")
        .when(F.size(photos) > 0, "crawl-unjudged").otherwise("none").alias("photos"),
    )


def zip_centres(all_sites: DataFrame) -> DataFrame:
    """Centre of the sites of all years per ZIP, and their number."""
    located = all_sites.select(
        F.col("zipcode").alias("zip"), num(F.col("latitude")).alias("lat"),
        num(F.col("longitude")).alias("lng"),
    ).where("zip <> '' AND lat IS NOT NULL AND lng IS NOT NULL")
    return located.groupBy("zip").agg(
        F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"),
        F.count(F.lit(1)).alias("dycdSitesAllYears"),
    )


def zip_stats(all_sites: DataFrame, programs: DataFrame) -> DataFrame:
    """ZIP centres with the number of programs now; ``programs`` has a ``zip``."""
    now = programs.groupBy("zip").agg(F.count(F.lit(1)).alias("_now"))
    return zip_centres(all_sites).join(now, "zip", "left").withColumn(
        "k5ProgramsNow", F.coalesce("_now", F.lit(0).cast("bigint"))
    ).drop("_now")


def _as_rows(one_row: DataFrame) -> DataFrame:
    """One row of counters as (counter, n) rows."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in one_row.columns)
    return one_row.select(F.expr(f"stack({len(one_row.columns)}, {pairs}) AS (counter, n)"))


def dataset_counts(programs: DataFrame, schools: DataFrame, zips: DataFrame) -> DataFrame:
    p = F.col
    counted = programs.agg(
        F.count(F.lit(1)).alias("programs"),
        F.count_if(F.coalesce(p("enrichment.website"), F.lit("")) != "").alias("withWebsite"),
        F.count_if(F.size("enrichment.stemTools") > 0).alias("withTools"),
        F.count_if(F.size("enrichment.subjects") > 0).alias("withSubjects"),
        F.count_if(F.size("photos") > 0).alias("withPhotos"),
        F.count_if(F.exists("photos", lambda x: x["carouselReady"])).alias("withCarouselPhoto"),
        F.count_if(p("inSchoolBuilding").isNotNull()).alias("inSchoolBuilding"),
        F.count_if(p("inSchoolBuilding.servesK5")).alias("inK5SchoolBuilding"),
        F.count_if("_shared").alias("onSharedCampus"),
        F.count_if(p("cost.publiclyFunded")).alias("publiclyFunded"),
        F.count_if(p("cost.tier") != "unknown").alias("costConfirmed"),
    )
    return (
        _as_rows(counted)
        .unionByName(_as_rows(schools.agg(F.count(F.lit(1)).alias("schools"))))
        .unionByName(_as_rows(zips.agg(F.count(F.lit(1)).alias("zips"))))
    )


def dataset_meta(counts: DataFrame, programs: DataFrame) -> DataFrame:
    """One row that describes the published dataset."""
    groups = F.map_from_arrays(
        F.array(*[F.lit(k) for k in vocab.SUBJECT_GROUPS]),
        F.array(*[F.array(*[F.lit(s) for s in v]) for v in vocab.SUBJECT_GROUPS.values()]),
    )
    modelled = programs.agg(
        F.coalesce(F.bool_or(F.col("enrichment.method") == vocab.MODEL_METHOD), F.lit(False)).alias("modelled")
    ).scalar()
    how = F.when(modelled, "extracted with a model").otherwise("keyword matching")
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("counter", "n"))).alias("counts")).select(
        F.lit(vocab.SCHEMA_VERSION).alias("schemaVersion"),
        F.current_timestamp().alias("generatedAt"),
        F.lit(vocab.PROGRAM_YEAR).alias("programYear"),
        "counts",
        F.create_map(F.lit("enrichment"), F.concat(F.lit("provider websites, "), how)).alias("sources"),
        groups.alias("subjectGroups"),
    )


def weighted_coverage(providers: DataFrame) -> DataFrame:
    resolved = F.coalesce(F.col("website"), F.lit("")) != ""
    return providers.agg(
        F.count(F.lit(1)).alias("providers"),
        F.count_if(resolved).alias("resolved"),
        F.coalesce(F.sum("site_count"), F.lit(0)).alias("sites"),
        F.coalesce(F.sum(F.when(resolved, F.col("site_count"))), F.lit(0)).alias("covered"),
    ).withColumn(
        "percent", F.when(F.col("sites") > 0, F.floor(100 * F.col("covered") / F.col("sites") + 0.5))
    )


def summary(programs: DataFrame) -> DataFrame:
    borough = F.nullif(F.col("address.borough"), F.lit(""))
    return programs.agg(
        F.count(F.lit(1)).alias("programs"),
        F.count_if(F.col("cost.tier") == "free").alias("free"),
        F.count_distinct(borough).alias("boroughs"),
    )


def stage_summary(df: DataFrame, array: str) -> DataFrame:
    n = F.coalesce(F.size(array), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows_out"),
        F.sum(n).alias("items"), F.count_if(n > 0).alias("rows_with_items"),
    )


def first_by(programs: DataFrame) -> DataFrame:
    """Per organisation the number of sites and the values of its first site."""
    return programs.groupBy("provider").agg(
        F.count(F.lit(1)).alias("sites"),
        F.min_by(F.struct(F.col("id"), F.col("cost.tier").alias("tier")), "_ord").alias("first"),
    ).select("provider", "sites", "first.*")

