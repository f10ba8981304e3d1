"""Queries over cards: search by place, facets, order, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.geo import distance_text, in_city, miles
from gazetteer.functions.values import intersect_vocab, num, union_ordered
from gazetteer.operators import order as O
from gazetteer.operators import search as Q
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import view

PV = I.PROGRAM_VIEWS
BOX = (40.61, 40.63, -73.98, -73.96)
BASE = f"WITH {I.SQL_PROGRAMS}, {I.SQL_CARDS}"
ZIPPED = f"WITH {I.SQL_PROGRAMS}, {I.SQL_ZIPS}, {I.SQL_CARDS}, asked AS (SELECT trim(zip) AS zip, count(*) AS requests FROM zip_requests GROUP BY 1)"
M = I.sql_haversine("z.lat", "z.lng", "c.lat", "c.lng", vocab.EARTH_MILES)


@query("q_cards", f"""{BASE} SELECT id, name, org, neighborhood, borough, zip, ages, cost, cost_detail,
  array_to_string(subjects, '|') AS subjects, array_to_string(tools, '|') AS tools, days, seats, tag, signup FROM cards""", PV)
def cards(spark, d):
    return I.cards(spark, d).select(
        "id", "name", "org", "neighborhood", "borough", "zip", "ages", "cost",
        F.col("costDetail").alias("cost_detail"), F.array_join("subjects", "|").alias("subjects"),
        F.array_join("tools", "|").alias("tools"), "days", "seats", "tag",
        F.col("signupUrl").alias("signup"))


@query("q_catalog", f"""{BASE}, {I.SQL_CATALOG} SELECT id, summary, location, area, neighborhood, hours_label, hours_kind,
  array_to_string(days, '|') AS days, is_free, cost_label, age_min, age_max, array_to_string(topics, '|') AS topics FROM catalog""", PV)
def catalog(spark, d):
    return Q.to_catalog(I.cards(spark, d)).select(
        "id", "summary", "location", "area", "neighborhood", F.col("hoursLabel").alias("hours_label"),
        F.col("hoursKind").alias("hours_kind"), F.array_join("days", "|").alias("days"),
        F.coalesce(F.col("cost") == 0, F.lit(False)).alias("is_free"),
        F.col("costLabel").alias("cost_label"), F.col("ageMin").alias("age_min"),
        F.col("ageMax").alias("age_max"), F.array_join("topics", "|").alias("topics"))


@query("q_bbox", f"""{BASE} SELECT id, 'listed' AS view FROM cards WHERE lat BETWEEN 40.61 AND 40.63 AND lng BETWEEN -73.98 AND -73.96
  UNION ALL SELECT id, 'pinned' FROM cards WHERE lat BETWEEN 40.606 AND 40.634 AND lng BETWEEN -73.984 AND -73.956""", PV)
def bbox(spark, d):
    c = I.cards(spark, d)
    return Q.in_bounds(c, BOX).select("id", F.lit("listed").alias("view")).unionByName(
        Q.in_bounds(c, BOX, 0.2).select("id", F.lit("pinned").alias("view")))


@query("q_facet_filter", f"""{BASE} SELECT id, cost, ages FROM cards WHERE cost = 'Free' AND (ages = 'Grades K–5' OR ages = 'Ages 4+')
  AND list_has_any(subjects, ['Chess', 'Music', 'Robotics'])""", PV)
def facet_filter(spark, d):
    return Q.facet_filter(
        I.cards(spark, d), ["Free"], ["Elementary only (K–5)", "All ages (4 and up)"],
        ["Chess", "Music", "Robotics"]).select("id", "cost", "ages")


_OPTIONS = ", ".join(
    f"('{h.replace(chr(39), chr(39) * 2)}', {g}, {o}, '{s}')"
    for g, (h, ss) in enumerate(vocab.SUBJECT_GROUPS.items()) for o, s in enumerate(ss))


@query("q_facet_counts", f"""{BASE}, options AS (SELECT heading, group_no, option_no, {I.sql_label('s')} AS option FROM (VALUES {_OPTIONS}) t(heading, group_no, option_no, s)),
  near AS (SELECT * FROM cards WHERE lat BETWEEN 40.61 AND 40.63 AND lng BETWEEN -73.98 AND -73.96)
  SELECT heading, option, group_no, option_no, coalesce(n, 0) AS n FROM options LEFT JOIN (SELECT s AS o, count(*) AS n FROM (SELECT unnest(subjects) AS s FROM near) GROUP BY 1) k
  ON o = option WHERE coalesce(n, 0) > 0 OR option = 'Physics'""", PV)
def facet_counts(spark, d):
    return Q.facet_counts(Q.in_bounds(I.cards(spark, d), BOX), ["Physics"])


@query("q_featured", f"""{BASE} SELECT id, provider FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY n_photos > 0 DESC, evidence DESC,
  coalesce(seat_count, 0) DESC, name, _ord) AS rn FROM cards) WHERE rn = 1 ORDER BY n_photos > 0 DESC, evidence DESC, coalesce(seat_count, 0) DESC, name, _ord LIMIT 8""", PV)
def featured(spark, d):
    p = I.programs(spark, d)
    extra = p.select(
        "id", (F.size("photos") > 0).alias("own_photo"),
        (F.size("enrichment.subjects") + F.size("enrichment.stemTools")).alias("evidence"),
        F.col("seats").alias("seat_count"))
    return Q.featured(Q.to_cards(p).join(extra, "id")).select("id", "provider")


@query("q_order_by_name", f"{BASE} SELECT id, name FROM cards", PV)
def order_by_name(spark, d):
    return Q.order_by_name(I.cards(spark, d)).select("id", "name")


@query("q_distance_text", f"""SELECT _ord, coalesce(printf('%.1f', {I.sql_haversine(I.sql_num('latitude'), I.sql_num('longitude'), '40.7', '-73.9', vocab.EARTH_MILES)}) || ' mi', borough) AS distance
  FROM sites_raw""", ("sites_raw",))
def distance(spark, d):
    m = miles(num(F.col("latitude")), num(F.col("longitude")), F.lit(40.7), F.lit(-73.9))
    return view(spark, d, "sites_raw").select("_ord", distance_text(m, F.col("borough")).alias("distance"))


@query("q_nearest", f"""WITH {I.SQL_PROGRAMS}, {I.SQL_ZIPS} SELECT c._ord AS point_id, arg_min(z.zip, struct_pack(d := {M}, o := z.zip)) AS zip,
  round(min({M}), 4) AS miles FROM core c JOIN zips z ON c.lat IS NOT NULL AND c.lng IS NOT NULL GROUP BY 1""", PV)
def nearest(spark, d):
    from gazetteer.operators.dataset import core_programs

    points = core_programs(view(spark, d, "sites_raw")).select(F.col("_ord").alias("point_id"), "lat", "lng")
    return Q.nearest_zip(points, I.centres(spark, d)).select("point_id", "zip", F.round("miles", 4).alias("miles"))


@query("q_search_zip", f"""{ZIPPED},
  status AS (SELECT a.zip, a.requests, CASE WHEN NOT regexp_full_match(a.zip, '[0-9]{{5}}') THEN 'none' WHEN z.zip IS NULL THEN 'unknown'
    WHEN EXISTS (SELECT 1 FROM cards c WHERE c.zip = a.zip AND c.lat IS NOT NULL AND c.lng IS NOT NULL) THEN 'in-zip' ELSE 'nearby' END AS kind
    FROM asked a LEFT JOIN zips z ON z.zip = a.zip)
  SELECT s.zip, s.requests, s.kind, c.id, round(c.m, 3) AS miles, printf('%.1f', c.m) || ' mi' AS distance FROM status s LEFT JOIN (
    SELECT z.zip AS z, c.id, c.zip AS cz, {M} AS m FROM zips z JOIN cards c ON c.lat IS NOT NULL AND c.lng IS NOT NULL) c
  ON c.z = s.zip AND ((s.kind = 'in-zip' AND c.cz = s.zip) OR (s.kind = 'nearby' AND c.m <= 2))""", (*PV, "zip_requests"))
def search_zip(spark, d):
    return Q.search_zip(I.places(spark, d), view(spark, d, "zip_requests"), I.centres(spark, d)).select(
        "zip", "requests", "kind", "id", F.round("miles", 3).alias("miles"), "distance")


@query("q_search_radius", f"""{ZIPPED}, m AS (SELECT z.zip, c.id, {M} AS m FROM zips z JOIN cards c ON c.lat IS NOT NULL AND c.lng IS NOT NULL)
  SELECT a.zip, a.requests, z.zip IS NOT NULL AS measured, round(n.nm, 3) AS nearest_miles, m.id, round(m.m, 3) AS miles, printf('%.1f', m.m) || ' mi' AS distance
  FROM asked a LEFT JOIN zips z ON z.zip = a.zip LEFT JOIN (SELECT zip, min(m) AS nm FROM m GROUP BY 1) n ON n.zip = a.zip
  LEFT JOIN m ON m.zip = a.zip AND m.m <= 1""", (*PV, "zip_requests"))
def search_radius(spark, d):
    return Q.search_radius(I.places(spark, d), view(spark, d, "zip_requests"), I.centres(spark, d)).select(
        "zip", "requests", "measured", F.round("nearest_miles", 3).alias("nearest_miles"), "id",
        F.round("miles", 3).alias("miles"), "distance").orderBy("zip", "miles", "id")


@query("q_cap_with_total", f"""{BASE} SELECT borough, id, count(*) OVER (PARTITION BY borough) AS total FROM cards
  QUALIFY row_number() OVER (PARTITION BY borough ORDER BY _ord) <= 8""", PV)
def cap_with_total(spark, d):
    return O.cap_with_total(I.cards(spark, d), ["borough"], [F.col("_ord")], 8).select("borough", "id", "total")


@query("q_array_union", f"""SELECT _ord, array_to_string({I.sql_distinct("list_concat(subjects, tools)")}, '|') AS both
  FROM (SELECT _ord, CASE WHEN subjects_text = '' THEN [] ELSE split(subjects_text, ',') END AS subjects,
  list_filter(CASE WHEN tools_text = '' THEN [] ELSE split(tools_text, ',') END, lambda t: t IN ({I.sql_list(vocab.TOOLS_THAT_ARE_SUBJECTS)})) AS tools FROM facts_raw)""", ("facts_raw",))
def array_union(spark, d):
    return I.facts(spark, d).select("_ord", F.array_join(union_ordered(
        F.col("subjects"), intersect_vocab(F.col("stem_tools"), vocab.TOOLS_THAT_ARE_SUBJECTS)), "|").alias("both"))


@query("q_vocab_intersect", f"""SELECT _ord, array_to_string(list_filter(CASE WHEN subjects_text = '' THEN [] ELSE split(subjects_text, ',') END,
  lambda t: t IN ({I.sql_list(vocab.TOOL_VOCAB)})), '|') AS known FROM facts_raw""", ("facts_raw",))
def vocab_intersect(spark, d):
    return I.facts(spark, d).select(
        "_ord", F.array_join(intersect_vocab(F.col("subjects"), vocab.TOOL_VOCAB), "|").alias("known"))


@query("q_in_city", f"""SELECT _ord, {I.sql_num('latitude')} > 40.4 AND {I.sql_num('latitude')} < 41.0 AND {I.sql_num('longitude')} > -74.3
  AND {I.sql_num('longitude')} < -73.6 AS inside FROM sites_raw""", ("sites_raw",))
def city_box(spark, d):
    return view(spark, d, "sites_raw").select(
        "_ord", in_city(num(F.col("latitude")), num(F.col("longitude"))).alias("inside"))
