"""Queries over the dataset build: cohort, joins to schools, roll-ups, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions import geo
from gazetteer.functions.values import blank_to_null, null_if, num, stable_id
from gazetteer.operators import dataset as D
from gazetteer.operators import spatial as S
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import view

PV = I.PROGRAM_VIEWS


@query("q_cohort_filter", f"SELECT _ord, program_site_name, age_range FROM sites_raw WHERE {I.SQL_COHORT}", ("sites_raw",))
def cohort_filter(spark, d):
    return D.filter_cohort(view(spark, d, "sites_raw")).select("_ord", "program_site_name", "age_range")


@query("q_num_coerce", f"""SELECT _ord, {I.sql_num('latitude')} AS lat, {I.sql_num('totalslots')} AS seats,
  {I.sql_num('totalparticipants')} AS participants FROM sites_raw""", ("sites_raw",))
def num_coerce(spark, d):
    return view(spark, d, "sites_raw").select(
        "_ord", num(F.col("latitude")).alias("lat"), num(F.col("totalslots")).alias("seats"),
        num(F.col("totalparticipants")).alias("participants"),
    )


@query("q_sentinels", """SELECT _ord, NULLIF(contract, 'NULL') AS contract, NULLIF(nta, 'NULL') AS nta,
  CASE WHEN totalslots <> '' THEN totalslots END AS slots FROM sites_raw""", ("sites_raw",))
def sentinels(spark, d):
    return view(spark, d, "sites_raw").select(
        "_ord", null_if(F.col("contract")).alias("contract"), null_if(F.col("nta")).alias("nta"),
        blank_to_null(F.col("totalslots")).alias("slots"),
    )


@query("q_schools", f"WITH {I.SQL_SCHOOLS} SELECT dbn, name, grades, lat, lng, serves_k5 FROM schools", ("schools_raw",))
def schools(spark, d):
    return I.schools(spark, d).select("dbn", "name", "grades", "lat", "lng", "serves_k5")


@query("q_stable_id", f"SELECT _ord, {I.SQL_ID} AS id FROM sites_raw", ("sites_raw",))
def stable_ids(spark, d):
    return view(spark, d, "sites_raw").select(
        "_ord", stable_id(F.col("program_site_name"), F.col("street_address"), F.col("zipcode")).alias("id"))


@query("q_dedupe_first", f"WITH {I.SQL_CORE} SELECT id, _ord, name FROM core", ("sites_raw",))
def dedupe_first(spark, d):
    return D.core_programs(view(spark, d, "sites_raw")).select("id", "_ord", "name")


@query("q_haversine", f"""SELECT _ord, round({I.sql_haversine(I.sql_num('latitude'), I.sql_num('longitude'), '40.7', '-73.9', vocab.EARTH_M)}, 1) AS metres,
  round({I.sql_haversine(I.sql_num('latitude'), I.sql_num('longitude'), '40.7', '-73.9', vocab.EARTH_MILES)}, 4) AS miles
  FROM sites_raw""", ("sites_raw",))
def haversine(spark, d):
    lat, lng = num(F.col("latitude")), num(F.col("longitude"))
    centre = (F.lit(40.7), F.lit(-73.9))
    return view(spark, d, "sites_raw").select(
        "_ord", F.round(geo.metres(lat, lng, *centre), 1).alias("metres"),
        F.round(geo.miles(lat, lng, *centre), 4).alias("miles"))


@query("q_within_radius", f"WITH {I.SQL_SCHOOLS}, {I.SQL_CORE}, {I.SQL_PAIRS} SELECT id, dbn, distance_m, serves_k5 FROM pairs",
       ("sites_raw", "schools_raw"))
def within_radius(spark, d):
    core = D.core_programs(view(spark, d, "sites_raw"))
    return S.schools_within(core, I.schools(spark, d)).select("id", "dbn", "distance_m", "serves_k5")


@query("q_pick_preferred", f"""WITH {I.SQL_SCHOOLS}, {I.SQL_CORE}, {I.SQL_PAIRS}, {I.SQL_HOST}
  SELECT id, dbn, distance_m, serves_k5 FROM host""", ("sites_raw", "schools_raw"))
def pick_preferred(spark, d):
    core = D.core_programs(view(spark, d, "sites_raw"))
    return S.preferred_schools(core, I.schools(spark, d)).select(
        "id", "dbn", "distance_m", "serves_k5")


@query("q_fan_out", f"""WITH {I.SQL_PROGRAMS} SELECT id, provider, website, website_confidence, method, n_photos FROM programs""", PV)
def fan_out(spark, d):
    core = D.core_programs(view(spark, d, "sites_raw"))
    f = I.facts(spark, d)
    providers = D.last_per_provider(f).select("provider", "website", F.col("confidence").alias("wc"))
    facts = D.last_per_provider(f).select("provider", "method")
    photos = D.nested_photos(view(spark, d, "photos_raw"))
    return D.fan_out(core, providers, facts, photos).select(
        "id", "provider", "website", F.coalesce("wc", F.lit("unresolved")).alias("website_confidence"),
        "method", F.coalesce(F.size("photos"), F.lit(0)).cast("bigint").alias("n_photos"))


@query("q_lookup", f"""WITH {I.SQL_CORE} SELECT id, nta_name AS neighborhood FROM core
  LEFT JOIN nta_names ON nta_code = nta""", ("sites_raw", "nta_names"))
def lookup(spark, d):
    core = D.core_programs(view(spark, d, "sites_raw"))
    return D.lookup(core, view(spark, d, "nta_names"), "nta", "nta_code", "nta_name", "neighborhood").select(
        "id", "neighborhood")


FLAT = """id, name, provider, area, type, age_range, borough, zip, nta, neighborhood, lat, lng, seats,
  participants, funded, tier, cost_source, host_dbn, host_m, host_k5, n_co, dbns, website, website_confidence,
  website_source, summary, array_to_string(tools, '|') AS tools, array_to_string(subjects, '|') AS subjects,
  hours_text, contact_email, method, fact_confidence, n_photos, photo_urls"""


@query("q_program_record", f"WITH {I.SQL_PROGRAMS} SELECT {FLAT} FROM programs", PV)
def program_record(spark, d):
    p = I.programs(spark, d)
    return p.select(
        "id", "name", "provider", F.col("programArea").alias("area"), F.col("programType").alias("type"),
        F.col("ageRange").alias("age_range"), "address.borough", "address.zip", "address.nta",
        "address.neighborhood", "lat", "lng", "seats", "participants",
        F.col("cost.publiclyFunded").alias("funded"), "cost.tier",
        F.col("cost.source").alias("cost_source"),
        F.col("inSchoolBuilding.dbn").alias("host_dbn"),
        F.col("inSchoolBuilding.distanceM").alias("host_m"),
        F.col("inSchoolBuilding.servesK5").alias("host_k5"),
        F.size("coLocatedSchools").cast("bigint").alias("n_co"),
        F.when(F.size("coLocatedSchools") > 0,
               F.array_join(F.col("coLocatedSchools.dbn"), " ")).alias("dbns"),
        "enrichment.website", F.col("enrichment.websiteConfidence").alias("website_confidence"),
        F.col("enrichment.websiteSource").alias("website_source"), "enrichment.summary",
        F.array_join("enrichment.stemTools", "|").alias("tools"),
        F.array_join("enrichment.subjects", "|").alias("subjects"),
        F.col("enrichment.hoursText").alias("hours_text"),
        F.col("enrichment.contactEmail").alias("contact_email"), "enrichment.method",
        F.col("enrichment.confidence").alias("fact_confidence"),
        F.size("photos").cast("bigint").alias("n_photos"),
        F.when(F.size("photos") > 0, F.array_join(F.col("photos.url"), " ")).alias("photo_urls"),
    )


@query("q_provenance", f"""WITH {I.SQL_PROGRAMS} SELECT id, '{vocab.CORE_SOURCE}' AS core,
  CASE WHEN host_dbn IS NOT NULL THEN '{vocab.SCHOOL_SOURCE}' END AS school_match, coalesce(method, 'none') AS enrichment,
  CASE WHEN any_judged THEN 'gemini-vision' WHEN n_photos > 0 THEN 'crawl-unjudged' ELSE 'none' END AS photos FROM programs""", PV)
def provenance(spark, d):
    return I.programs(spark, d).select(
        "id", "provenance.core", F.col("provenance.schoolMatch").alias("school_match"),
        "provenance.enrichment", "provenance.photos")


@query("q_derive_cost", f"""WITH {I.SQL_PROGRAMS} SELECT id, tier, cost_source AS source, funded,
  CASE cost_source WHEN 'dycd-program-rules' THEN '{vocab.COST_RULE_NOTE.replace("'", "''")}'
    WHEN 'provider-website' THEN 'Stated on the provider''s own site (' || coalesce(method, 'extracted') || ').'
    ELSE CASE WHEN funded THEN 'DYCD-contracted ' || coalesce(area, 'program') || '; the City does not publish a family fee, so cost is unconfirmed.'
      ELSE 'No cost information published.' END END AS note FROM programs""", PV)
def derive_cost(spark, d):
    core = D.core_programs(view(spark, d, "sites_raw"))
    facts = D.last_per_provider(I.facts(spark, d)).select("provider", "cost_tier", "method")
    cost = D.derive_cost(F.col("contract"), F.col("area"), F.col("cost_tier"), F.col("method"))
    return core.join(facts, "provider", "left").select("id", cost.alias("c")).select(
        "id", "c.tier", "c.source", F.col("c.publiclyFunded").alias("funded"), "c.note")


@query("q_roster", f"""SELECT provider, count(*) AS site_count, array_to_string(list_sort(list(DISTINCT borough) FILTER (borough IS NOT NULL)), '|') AS boroughs
  FROM (SELECT trim(provider) AS provider, borough FROM sites_raw WHERE {I.SQL_COHORT}) WHERE provider <> '' GROUP BY 1""", ("sites_raw",))
def roster(spark, d):
    return D.in_roster_order(D.roster(D.filter_cohort(view(spark, d, "sites_raw")))).select(
        "provider", "site_count", F.array_join("boroughs", "|").alias("boroughs"))


@query("q_merge_prior", f"""WITH {I.SQL_FACTS} SELECT r.provider, f.website, f.confidence, f.source,
  regexp_extract(f.website, '//([^/]+)', 1) AS resolved_via, coalesce(f.provider LIKE '%7 Inc', false) AS locked FROM
  (SELECT DISTINCT trim(provider) AS provider FROM sites_raw WHERE {I.SQL_COHORT} AND trim(provider) <> '') r
  LEFT JOIN facts f ON f.provider = r.provider""", ("sites_raw", "facts_raw"))
def merge_prior(spark, d):
    return I.roster(spark, d).select("provider", "website", "confidence", "source", "resolved_via", "locked")


@query("q_zip_stats", f"WITH {I.SQL_PROGRAMS}, {I.SQL_ZIPS} SELECT zip, lat, lng, sites_all, now FROM zips", PV)
def zip_stats(spark, d):
    return I.zips(spark, d).select(
        "zip", "lat", "lng",
        F.col("dycdSitesAllYears").alias("sites_all"), F.col("k5ProgramsNow").alias("now"))


@query("q_dataset_counts", f"""WITH {I.SQL_PROGRAMS}, {I.SQL_ZIPS}
  SELECT 'programs' AS counter, count(*) AS n FROM programs UNION ALL
  SELECT 'schools', count(*) FROM schools UNION ALL SELECT 'zips', count(*) FROM zips UNION ALL
  SELECT 'withWebsite', count(*) FROM programs WHERE coalesce(website, '') <> '' UNION ALL
  SELECT 'withTools', count(*) FROM programs WHERE len(tools) > 0 UNION ALL
  SELECT 'withSubjects', count(*) FROM programs WHERE len(subjects) > 0 UNION ALL
  SELECT 'withPhotos', count(*) FROM programs WHERE n_photos > 0 UNION ALL
  SELECT 'withCarouselPhoto', count(*) FROM programs WHERE any_carousel UNION ALL
  SELECT 'inSchoolBuilding', count(*) FROM programs WHERE host_dbn IS NOT NULL UNION ALL
  SELECT 'inK5SchoolBuilding', count(*) FROM programs WHERE host_k5 UNION ALL
  SELECT 'onSharedCampus', count(*) FROM programs WHERE n_co > 1 UNION ALL
  SELECT 'publiclyFunded', count(*) FROM programs WHERE funded UNION ALL
  SELECT 'costConfirmed', count(*) FROM programs WHERE tier <> 'unknown'""", PV)
def dataset_counts(spark, d):
    return D.dataset_counts(I.programs(spark, d), I.schools(spark, d), I.zips(spark, d))


@query("q_weighted_coverage", f"""WITH {I.SQL_FACTS}, r AS (SELECT r.provider, n, website FROM (SELECT trim(provider) AS provider, count(*) AS n
  FROM sites_raw WHERE {I.SQL_COHORT} AND trim(provider) <> '' GROUP BY 1) r LEFT JOIN facts f ON f.provider = r.provider)
  SELECT count(*) AS providers, count(*) FILTER (website <> '') AS resolved, CAST(sum(n) AS BIGINT) AS sites,
  CAST(sum(n) FILTER (website <> '') AS BIGINT) AS covered,
  CAST(floor(100.0 * sum(n) FILTER (website <> '') / sum(n) + 0.5) AS BIGINT) AS percent FROM r""", ("sites_raw", "facts_raw"))
def weighted_coverage(spark, d):
    return D.weighted_coverage(I.roster(spark, d))


@query("q_summary", f"""WITH {I.SQL_PROGRAMS} SELECT count(*) AS programs, count(*) FILTER (tier = 'free') AS free,
  count(DISTINCT NULLIF(borough, '')) AS boroughs FROM programs""", PV)
def summary(spark, d):
    return D.summary(I.programs(spark, d))


@query("q_stage_summary", f"""WITH {I.SQL_PROGRAMS} SELECT count(*) AS rows_out, CAST(sum(n_photos) AS BIGINT) AS items,
  count(*) FILTER (n_photos > 0) AS rows_with_items FROM programs""", PV)
def stage_summary(spark, d):
    return D.stage_summary(I.programs(spark, d), "photos")


@query("q_first_by", f"""WITH {I.SQL_PROGRAMS} SELECT provider, count(*) AS sites, arg_min(id, _ord) AS id, arg_min(tier, _ord) AS tier
  FROM programs GROUP BY provider""", PV)
def first_by(spark, d):
    return D.first_by(I.programs(spark, d)).orderBy(F.desc("sites"), "provider")


@query("q_exists_flags", f"""WITH {I.SQL_PROGRAMS} SELECT id, coalesce(any_judged, false) AS any_judged, coalesce(any_carousel, false) AS any_carousel,
  list_contains(subjects, 'chess') AS teaches_chess FROM programs""", PV)
def exists_flags(spark, d):
    return I.programs(spark, d).select(
        "id", F.exists("photos", lambda p: p["judged"]).alias("any_judged"),
        F.exists("photos", lambda p: p["carouselReady"]).alias("any_carousel"),
        F.exists("enrichment.subjects", lambda s: s == "chess").alias("teaches_chess"))


@query("q_deserts", f"""WITH {I.SQL_PROGRAMS}, {I.SQL_ZIPS} SELECT z.zip, round(min({I.sql_haversine('z.lat', 'z.lng', 'p.lat', 'p.lng', vocab.EARTH_MILES)}), 3) AS miles
  FROM zips z JOIN programs p ON p.lat IS NOT NULL AND p.lng IS NOT NULL WHERE z.now = 0 GROUP BY 1""", PV)
def deserts(spark, d):
    from gazetteer.operators.search import deserts as find
    return find(I.zips(spark, d), I.places(spark, d)).select("zip", F.round("miles", 3).alias("miles"))


