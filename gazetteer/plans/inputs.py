"""Stage tables of the queries, built from the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.values import empty_strings
from gazetteer.operators import dataset as D
from gazetteer.plans.views import view


def words(c: str) -> Column:
    return F.when(F.col(c) == "", empty_strings()).otherwise(F.split(c, ","))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "facts_raw").select(
        "*", words("tools_text").alias("stem_tools"), words("subjects_text").alias("subjects"),
        words("activities_text").alias("activities"), words("evidence_text").alias("evidence"),
    ).withColumn(
        "subject_evidence",
        F.transform("subjects", lambda s: F.struct(
            s.alias("subject"), F.concat(F.lit("we teach "), s).alias("quote"))),
    )


def schools(spark: SparkSession, d: str) -> DataFrame:
    return D.project_schools(view(spark, d, "schools_raw"))


def programs(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return D.build_programs(
        view(spark, d, "sites_raw"), schools(spark, d), view(spark, d, "nta_names"),
        f, f, view(spark, d, "photos_raw"),
    )


def roster(spark: SparkSession, d: str) -> DataFrame:
    """Roster of the cohort with what earlier runs found out."""
    new = D.roster(D.filter_cohort(view(spark, d, "sites_raw")))
    prior = facts(spark, d).withColumn("resolved_via", F.regexp_extract("website", "//([^/]+)", 1)).withColumn(
        "locked", F.endswith("provider", F.lit("7 Inc")))
    return D.merge_prior(new.withColumn("locked", F.lit(False)), prior, ["website", "confidence", "source", "resolved_via", "locked"])


def zips(spark: SparkSession, d: str) -> DataFrame:
    sites = view(spark, d, "sites_raw")
    return D.zip_stats(sites, D.core_programs(sites))


def centres(spark: SparkSession, d: str) -> DataFrame:
    return D.zip_centres(view(spark, d, "sites_raw"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """What a search by place needs of each program."""
    return D.core_programs(view(spark, d, "sites_raw")).select("_ord", "id", "zip", "lat", "lng")


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_num(c: str) -> str:
    cast = f"TRY_CAST(trim({c}) AS DOUBLE)"
    return f"CASE WHEN isfinite({cast}) THEN {cast} END"


def sql_slug(c: str) -> str:
    return (
        f"left(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 60)"
    )


def sql_haversine(a: str, b: str, c: str, d: str, r: float) -> str:
    return (
        f"2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) "
        f"* cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
    )


SQL_ID = (
    f"left(regexp_replace({sql_slug('coalesce(program_site_name, ' + chr(39) + 'site' + chr(39) + ')')} || '-' || "
    f"{sql_slug('coalesce(street_address, ' + chr(39) * 2 + ')')} || '-' || coalesce(zipcode, ''), '-+', '-', 'g'), 100)"
)
SQL_COHORT = f"date = '{vocab.PROGRAM_YEAR}' AND age_range IN ({sql_list(vocab.K5_AGE_RANGES)})"
SQL_SERVES = f"regexp_matches(coalesce(grades_final_text, grades_text, ''), '(^|,)({'|'.join(vocab.K5_GRADE_CODES)})(,|$)')"
SQL_PHOTO_RANK = (
    "CASE WHEN kind = 'flyer' THEN 1 ELSE 0 END, CASE WHEN carousel_ready THEN 0 ELSE 1 END, "
    "-coalesce(suitability, 0), -(width * height), _ord"
)

# Oracle tables shared by many checks: the program table, flat.
SQL_SCHOOLS = f"""
schools AS (SELECT * FROM (SELECT _ord, system_code AS dbn, location_name AS name,
  coalesce(grades_final_text, grades_text) AS grades, {sql_num('latitude')} AS lat,
  {sql_num('longitude')} AS lng, {SQL_SERVES} AS serves_k5 FROM schools_raw)
  WHERE lat IS NOT NULL AND lng IS NOT NULL)"""
SQL_CORE = f"""
core AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _ord) AS rn FROM (
  SELECT _ord, {SQL_ID} AS id, program_site_name AS name, trim(provider) AS provider, program_area AS area,
    program_type AS type, age_range, borough, zipcode AS zip, nta, {sql_num('latitude')} AS lat,
    {sql_num('longitude')} AS lng, {sql_num('totalslots')} AS seats, {sql_num('totalparticipants')} AS participants,
    contract FROM sites_raw WHERE {SQL_COHORT})) WHERE rn = 1)"""
SQL_PAIRS = f"""
pairs AS (SELECT c.id, s.dbn, s.name AS school_name, s.serves_k5, s._ord AS school_ord,
  CAST(floor({sql_haversine('c.lat', 'c.lng', 's.lat', 's.lng', vocab.EARTH_M)} + 0.5) AS BIGINT) AS distance_m
  FROM core c JOIN schools s ON {sql_haversine('c.lat', 'c.lng', 's.lat', 's.lng', vocab.EARTH_M)} <= {vocab.SCHOOL_RADIUS_M})"""
SQL_HOST = """
host AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY serves_k5 DESC, distance_m, school_ord) AS rn
  FROM pairs) WHERE rn = 1)"""
SQL_FACTS = """
facts AS (SELECT *, CASE WHEN tools_text = '' THEN [] ELSE split(tools_text, ',') END AS tools,
    CASE WHEN subjects_text = '' THEN [] ELSE split(subjects_text, ',') END AS subjects,
    CASE WHEN evidence_text = '' THEN [] ELSE split(evidence_text, ',') END AS evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY _ord DESC) AS rn FROM facts_raw) WHERE rn = 1)"""
SQL_PHOTOS = f"""
pics AS (SELECT provider, count(*) AS n_photos, bool_or(judged) AS any_judged, bool_or(carousel_ready) AS any_carousel,
    string_agg(url, ' ' ORDER BY rn) AS photo_urls, list(page ORDER BY rn) AS photo_pages
  FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY {SQL_PHOTO_RANK}) AS rn FROM photos_raw)
  WHERE rn <= {vocab.IMAGES_PER_PROVIDER} GROUP BY provider)"""
SQL_FUNDED = "coalesce(contract <> '' AND contract <> 'NULL', false)"
SQL_PROGRAMS = (
    "," .join([SQL_SCHOOLS, SQL_CORE, SQL_PAIRS, SQL_HOST, SQL_FACTS, SQL_PHOTOS])
    + f""",
programs AS (SELECT c._ord, c.id, c.name, c.provider, c.area, c.type, c.age_range, c.borough, c.zip,
    NULLIF(c.nta, 'NULL') AS nta, n.nta_name AS neighborhood, c.lat, c.lng, c.seats, c.participants,
    {SQL_FUNDED} AS funded,
    CASE WHEN area = 'Compass' THEN 'free'
      WHEN coalesce(method, '') <> 'keyword' AND coalesce(cost_tier, 'unknown') NOT IN ('unknown', '') THEN cost_tier
      ELSE 'unknown' END AS tier,
    CASE WHEN area = 'Compass' THEN 'dycd-program-rules'
      WHEN coalesce(method, '') <> 'keyword' AND coalesce(cost_tier, 'unknown') NOT IN ('unknown', '') THEN 'provider-website'
      ELSE 'not-published' END AS cost_source,
    h.dbn AS host_dbn, h.distance_m AS host_m, h.serves_k5 AS host_k5,
    coalesce(co.n, 0) AS n_co, co.dbns,
    f.website, coalesce(f.confidence, 'unresolved') AS website_confidence, f.source AS website_source,
    NULLIF(f.summary, '') AS summary, coalesce(f.tools, []) AS tools, coalesce(f.subjects, []) AS subjects,
    coalesce(f.evidence, []) AS evidence, NULLIF(f.hours_text, '') AS hours_text,
    NULLIF(f.contact_email, '') AS contact_email, f.method, f.fact_confidence,
    coalesce(p.n_photos, 0) AS n_photos, p.any_judged, p.any_carousel, p.photo_urls, p.photo_pages
  FROM core c LEFT JOIN nta_names n ON n.nta_code = c.nta LEFT JOIN facts f ON f.provider = c.provider
  LEFT JOIN pics p ON p.provider = c.provider LEFT JOIN host h ON h.id = c.id
  LEFT JOIN (SELECT id, count(*) AS n, string_agg(dbn, ' ' ORDER BY distance_m, school_ord) AS dbns FROM pairs GROUP BY id) co
    ON co.id = c.id)"""
)
PROGRAM_VIEWS = ("sites_raw", "schools_raw", "nta_names", "facts_raw", "photos_raw")
SQL_ZIPS = f"""
zips AS (SELECT z.zip, lat, lng, n AS sites_all, coalesce(now, 0) AS now FROM
  (SELECT zipcode AS zip, round(avg({sql_num('latitude')}), 6) AS lat, round(avg({sql_num('longitude')}), 6) AS lng, count(*) AS n
   FROM sites_raw WHERE zipcode <> '' AND {sql_num('latitude')} IS NOT NULL AND {sql_num('longitude')} IS NOT NULL GROUP BY 1) z
  LEFT JOIN (SELECT zip, count(*) AS now FROM programs GROUP BY 1) p ON p.zip = z.zip)"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    from gazetteer.operators.search import to_cards

    return to_cards(programs(spark, d))


def sql_label(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.LABELS.items())
    return f"CASE {x} {whens} ELSE upper(left({x}, 1)) || substr({x}, 2) END"


def sql_distinct(l: str) -> str:
    """List without repeats, first position kept."""
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


SQL_TIDY = (
    "trim(regexp_replace(regexp_replace(coalesce({c}, ''), '/Corporate$', '', 'i'), "
    "',?\\s+(inc|incorporated|llc|ltd)\\.?$', '', 'i'))"
)
SQL_STATED = "(cost_source = 'provider-website' AND coalesce(method, '') = 'gemini')"
_TAKEN = f"list_filter(tools, lambda t: t IN ({sql_list(vocab.TOOLS_THAT_ARE_SUBJECTS)}))"
SQL_CARDS = f"""
cards AS (SELECT _ord, id, provider, coalesce(name, 'After-school program') AS name, {SQL_TIDY.format(c='provider')} AS org,
  array_to_string(list_filter([neighborhood, borough], lambda x: x IS NOT NULL AND x <> ''), ', ') AS neighborhood,
  coalesce(borough, '') AS borough, coalesce(zip, '') AS zip,
  regexp_replace(coalesce(age_range, 'Ask provider'), '\\s*-\\s*', '–', 'g') AS ages,
  CASE WHEN area = 'Compass' OR ({SQL_STATED} AND tier = 'free') THEN 'Free' WHEN {SQL_STATED} AND tier = 'sliding-scale' THEN 'Sliding scale'
    WHEN {SQL_STATED} AND tier = 'paid' THEN 'Paid' ELSE 'Ask provider' END AS cost,
  CASE WHEN area = 'Compass' THEN 'Free · DYCD COMPASS' WHEN {SQL_STATED} AND tier = 'free' THEN 'Free · per provider'
    WHEN {SQL_STATED} AND tier = 'sliding-scale' THEN 'Sliding scale · per provider' WHEN {SQL_STATED} AND tier = 'paid' THEN 'Paid · ask provider for fees'
    ELSE 'DYCD-funded · fees not published' END AS cost_detail,
  list_transform({sql_distinct(f"list_concat(subjects, {_TAKEN})")}, lambda s: {sql_label('s')}) AS subjects,
  list_transform(tools, lambda s: {sql_label('s')}) AS tools,
  CASE WHEN hours_text IS NOT NULL THEN hours_text WHEN type IN ('COMPASS Elementary', 'COMPASS SONYC Pilot') THEN 'Mon–Fri · 3 hrs a day'
    WHEN area = 'Beacon' THEN 'Afternoons, evenings & weekends' WHEN area = 'Cornerstone' THEN 'Year-round · NYCHA center' ELSE 'Ask provider' END AS days,
  CASE WHEN coalesce(seats, 0) <> 0 THEN CAST(CAST(seats AS BIGINT) AS VARCHAR) || ' funded seats' ELSE 'Ask provider' END AS seats,
  CASE WHEN host_k5 THEN 'In school' END AS tag, coalesce(website, '{vocab.SIGNUP_PORTAL}') AS signup, lat, lng,
  len(subjects) + len(tools) AS evidence, seats AS seat_count, n_photos FROM programs)"""
_LA = "lower(ages)"
SQL_CATALOG = f"""
catalog AS (SELECT _ord, id, name, org, array_to_string(list_filter([org, tag], lambda x: x IS NOT NULL AND x <> ''), ' · ') AS summary,
  CASE WHEN neighborhood <> '' THEN neighborhood WHEN borough <> '' THEN borough ELSE 'NYC' END AS location, borough AS area,
  trim(regexp_replace(neighborhood, ',.*$', '')) AS neighborhood, zip, days AS hours_label,
  CASE WHEN regexp_matches(days, '(?i)mon–fri|mon-fri') THEN 'after-school' WHEN regexp_matches(days, '(?i)evening') THEN 'evenings' ELSE 'unknown' END AS hours_kind,
  CASE WHEN regexp_matches(days, '(?i)mon–fri|mon-fri') THEN [{sql_list(vocab.WEEKDAYS)}]
    WHEN regexp_matches(days, '(?i)evening') THEN [{sql_list(vocab.WEEKDAYS)}, 'saturday', 'sunday'] ELSE [] END AS days,
  cost = 'Free' AS is_free, CASE WHEN cost_detail <> '' THEN cost_detail ELSE cost END AS cost_label, ages,
  CASE WHEN contains({_LA}, 'k–12') OR contains({_LA}, 'k–5') THEN 5 WHEN contains({_LA}, '4+') THEN 4 ELSE 5 END AS age_min,
  CASE WHEN contains({_LA}, 'k–12') THEN 18 WHEN contains({_LA}, 'k–5') THEN 11 WHEN contains({_LA}, '4+') THEN 18 WHEN contains({_LA}, '5–20') THEN 20 ELSE 11 END AS age_max,
  {sql_distinct("list_transform(list_concat(subjects, tools), lambda s: lower(s))")} AS topics, signup, lat, lng FROM cards)"""
