"""Queries over questions: filters, places, routes, matches, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions import asking as A
from gazetteer.operators import questions as Q
from gazetteer.operators.search import to_catalog
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import view
from gazetteer.session import cut_lineage

PV = (*I.PROGRAM_VIEWS, "questions")


def _has(p: str) -> str:
    return f"regexp_matches(q, '{p}')"


def _time(p: str) -> str:
    x = f"regexp_extract(q, '{p}', ['h', 'm', 'a'])"
    h = f"TRY_CAST({x}.h AS INTEGER)"
    return (f"CASE WHEN {_has(p)} THEN (CASE WHEN {x}.a = 'pm' AND {h} < 12 THEN {h} + 12 WHEN {x}.a = 'am' AND {h} = 12 THEN 0 "
            f"WHEN {x}.a = '' AND {h} BETWEEN 1 AND 7 THEN {h} + 12 ELSE {h} END) * 60 + coalesce(TRY_CAST({x}.m AS INTEGER), 0) END")


_WEEK = ", ".join(f"CASE WHEN {_has(chr(92) + 'b' + d + chr(92) + 'b')} THEN '{d}' END" for d in vocab.WEEK)
_TOPICS = ", ".join(f"CASE WHEN {_has(p)} THEN '{t}' END" for t, p in vocab.TOPIC_PATTERNS.items())
_BORO = ", ".join(f"CASE WHEN {_has(chr(92) + 'b(' + '|'.join(a) + ')' + chr(92) + 'b')} THEN '{b}' END" for b, a in vocab.BOROUGH_ALIASES.items())
_NN = "lambda x: x IS NOT NULL"
SQL_PARSED = rf"""qs AS (SELECT qid, question, regexp_replace(lower(trim(question)), '[''’]', '', 'g') AS q FROM questions),
  p0 AS (SELECT *, {_time(A.AFTER)} AS after_min, {_time(A.BEFORE)} AS stated,
    CASE WHEN {_has(r'\bfree\b|\bno cost\b|\bzero cost\b|\bdoesnt cost\b|\bdoes not cost\b')} THEN 'free' WHEN {_has(r'\bpaid\b|\bcosts money\b|\bnot free\b|\bwith a fee\b')} THEN 'paid'
      WHEN {_has(r'\bask provider\b|\bunknown cost\b|\bfee not published\b')} THEN 'unknown' END AS cost,
    {_has(r'\bweekends?\b')} AS weekend, {_has(r'\bweekdays?\b|\bafter school\b')} AS schoolweek,
    NULLIF(regexp_extract(q, '\b(\d{{5}})\b', 1), '') AS zip, {_has(r'\b(near|nearby|around|close to|closest to|next to|within)\b')} AS near,
    TRY_CAST(coalesce(NULLIF(regexp_extract(q, '{A.AGES[0]}', 1), ''), NULLIF(regexp_extract(q, '{A.AGES[1]}', 1), ''), NULLIF(regexp_extract(q, '{A.AGES[2]}', 1), '')) AS INTEGER) AS age,
    list_filter([{_WEEK}], {_NN}) AS named_days, list_filter([{_TOPICS}], {_NN}) AS topics, list_filter([{_BORO}], {_NN}) AS boros FROM qs),
  p1 AS (SELECT *, CASE WHEN {_has(r'\bmorning\b')} AND after_min IS NULL AND stated IS NULL THEN 720 ELSE stated END AS before_min FROM p0),
  parsed AS (SELECT qid, q, cost, after_min, before_min,
    CASE WHEN {_has(r'\bafternoon\b')} AND after_min IS NULL AND before_min IS NULL THEN 'after-school'
      WHEN after_min IS NULL AND {_has(r'\bevenings?\b|\bat night\b|\btonight\b')} THEN 'evenings'
      WHEN NOT weekend AND schoolweek AND after_min IS NULL THEN 'after-school' END AS hours_kind,
    CASE WHEN weekend THEN ['saturday', 'sunday'] WHEN schoolweek THEN [{I.sql_list(vocab.WEEKDAYS)}] WHEN len(named_days) > 0 THEN named_days END AS days,
    age, CASE WHEN age IS NULL THEN CASE WHEN {_has(r'\bteens?\b|\bteenagers?\b')} THEN 'teen' WHEN {_has(r'\bkids?\b|\bchildren\b|\bchild\b')} THEN 'kid' END END AS age_group,
    topics, list_concat(boros, CASE WHEN zip IS NOT NULL AND NOT near THEN [zip] ELSE [] END) AS places0, CASE WHEN near THEN zip END AS near_zip FROM p1)"""


def _questions(spark, d):
    return view(spark, d, "questions")


def _catalog(spark, d):
    """The catalog as a stored table, as questions find it."""
    return cut_lineage(to_catalog(I.cards(spark, d)))


def _centres(spark, d):
    return cut_lineage(I.centres(spark, d))


@query("q_spoken_time", rf"""WITH qs AS (SELECT k, 'meet after ' || (k % 24 + 1) || CASE k % 3 WHEN 0 THEN ':' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') ELSE '' END || CASE k % 5 WHEN 0 THEN 'pm' WHEN 1 THEN ' am' ELSE '' END AS q
    FROM (SELECT c_custkey AS k FROM customer)), m AS (SELECT k, {_time(A.AFTER)} AS minutes FROM qs)
  SELECT k, minutes, (CASE WHEN (minutes // 60) % 12 = 0 THEN 12 ELSE (minutes // 60) % 12 END) || CASE WHEN minutes % 60 = 0 THEN '' ELSE ':' || lpad(CAST(minutes % 60 AS VARCHAR), 2, '0') END
    || CASE WHEN minutes // 60 >= 12 THEN 'pm' ELSE 'am' END AS spoken FROM m""")
def spoken_time(spark, d):
    asked = view(spark, d, "customer").selectExpr("c_custkey AS k").selectExpr(
        "k", "'meet after ' || (k % 24 + 1) || CASE k % 3 WHEN 0 THEN ':' || lpad(CAST(k % 60 AS STRING), 2, '0') ELSE '' END"
        " || CASE k % 5 WHEN 0 THEN 'pm' WHEN 1 THEN ' am' ELSE '' END AS q")
    return asked.select("k", A.parse(F.col("q"))["after_min"].alias("minutes")).withColumn(
        "spoken", A.minutes_to_text(F.col("minutes")))


@query("q_parse_questions", f"""WITH {SQL_PARSED} SELECT qid, cost, after_min, before_min, hours_kind, array_to_string(days, '|') AS days, age, age_group,
  array_to_string(topics, '|') AS topics, array_to_string(places0, '|') AS places, near_zip FROM parsed""", ("questions",))
def parse_questions(spark, d):
    return Q.parse_questions(_questions(spark, d)).select(
        "qid", "cost", "after_min", "before_min", "hours_kind", F.array_join("days", "|").alias("days"), "age",
        "age_group", F.array_join("topics", "|").alias("topics"), F.array_join("places", "|").alias("places"), "near_zip")


_SKIP = I.sql_list(vocab.PLACE_SKIP)
SQL_PLACES = f"""dict AS (SELECT phrase, min(o) AS o FROM (SELECT trim(regexp_replace(lower(x), ',.*$', '')) AS phrase, _ord * 2 + i AS o FROM
    (SELECT _ord, unnest([neighborhood, location]) AS x, unnest([0, 1]) AS i FROM catalog)) WHERE length(phrase) >= 5 GROUP BY 1),
  tq AS (SELECT DISTINCT q FROM parsed),
  ph AS (SELECT q, list(phrase ORDER BY o, phrase) AS found FROM tq JOIN dict ON contains(q, phrase) GROUP BY 1),
  wd AS (SELECT word, min(o) AS o FROM (SELECT _ord * 1000 + generate_subscripts(ws, 1) - 1 AS o, unnest(ws) AS word FROM
    (SELECT _ord, regexp_split_to_array(lower(unnest([neighborhood, location, area])), '[^a-z0-9]+') AS ws FROM catalog)) WHERE length(word) >= 5 AND word NOT IN ({_SKIP}) GROUP BY 1),
  ws AS (SELECT q, list(word ORDER BY o, word) AS found FROM (SELECT q, unnest(list_distinct(regexp_split_to_array(q, '[^a-z0-9_]+'))) AS word FROM tq) t JOIN wd USING (word) GROUP BY 1),
  placed AS (SELECT p.* EXCLUDE (places0), {I.sql_distinct("list_concat(places0, coalesce(ph.found, CASE WHEN len(places0) = 0 THEN ws.found END, []))")} AS places
    FROM parsed p LEFT JOIN ph ON ph.q = p.q LEFT JOIN ws ON ws.q = p.q)"""
HEAD = f"WITH {I.SQL_PROGRAMS}, {I.SQL_CARDS}, {I.SQL_CATALOG}, {SQL_PARSED}, {SQL_PLACES}"


@query("q_match_places", f"{HEAD} SELECT qid, array_to_string(places, '|') AS places FROM placed", PV)
def match_places(spark, d):
    return Q.match_places(Q.parse_questions(_questions(spark, d)), _catalog(spark, d)).select(
        "qid", F.array_join("places", "|").alias("places"))


_STOP = I.sql_list(vocab.QUESTION_STOPWORDS)
_FAQ = I.sql_list([p for ps in vocab.FAQ_PHRASES.values() for p in ps])
_BLOB = "lower(array_to_string(list_filter([location, area, neighborhood, zip, org], lambda x: x IS NOT NULL AND x <> ''), ' '))"
_LISTING = f"({_has(A.WHERE)} OR {_has(A.LIST[0])} OR {_has(A.LIST[1])})"
SQL_ROUTES = f"""blobs AS (SELECT *, {_BLOB} AS blob, lower(name || ' ' || summary || ' ' || array_to_string(topics, ' ') || ' ' || {_BLOB}) AS full_text FROM catalog),
  nm AS (SELECT q, count(*) AS n FROM tq JOIN catalog ON contains(q, lower(name)) GROUP BY 1),
  kw AS (SELECT q, list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS w FROM tq),
  kh AS (SELECT DISTINCT q FROM kw JOIN blobs ON len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(full_text, x))) = 0),
  centre AS (SELECT zipcode AS zip, round(avg({I.sql_num('latitude')}), 6) AS lat, round(avg({I.sql_num('longitude')}), 6) AS lng FROM sites_raw
    WHERE zipcode <> '' AND {I.sql_num('latitude')} IS NOT NULL AND {I.sql_num('longitude')} IS NOT NULL GROUP BY 1),
  s0 AS (SELECT * REPLACE (CASE WHEN cost IS NULL AND age IS NULL AND days IS NULL AND hours_kind IS NULL AND after_min IS NULL AND before_min IS NULL AND near_zip IS NULL
      AND len(topics) = 0 AND len(places) = 0 AND NOT {_LISTING} THEN NULL ELSE age_group END AS age_group) FROM placed),
  routes AS (SELECT s.*, {_has(A.WHERE)} AS where_asked, CASE WHEN q = '' THEN 'empty' WHEN {_has(A.GREETING)} THEN 'greeting' WHEN {_has(A.HELP)} THEN 'help'
    WHEN len(list_filter([{_FAQ}], lambda p: contains(q, p))) > 0 AND NOT {_has(A.LISTED)} THEN 'faq'
    WHEN q IN (SELECT q FROM nm WHERE n <= 12) THEN 'named' WHEN near_zip IS NOT NULL AND near_zip NOT IN (SELECT zip FROM centre) THEN 'unknown-zip'
    WHEN cost IS NOT NULL OR after_min IS NOT NULL OR before_min IS NOT NULL OR days IS NOT NULL OR age IS NOT NULL OR age_group IS NOT NULL OR hours_kind IS NOT NULL
      OR near_zip IS NOT NULL OR len(topics) > 0 OR len(places) > 0 THEN 'filters'
    WHEN {_LISTING} THEN 'overview' WHEN q IN (SELECT q FROM kh) THEN 'keyword' ELSE 'none' END AS route FROM s0 s)"""


def _routed(spark, d, catalog=None, centres=None):
    catalog = _catalog(spark, d) if catalog is None else catalog
    return Q.route_questions(_questions(spark, d), catalog, _centres(spark, d) if centres is None else centres)


@query("q_route_questions", f"{HEAD}, {SQL_ROUTES} SELECT qid, route FROM routes", PV)
def route_questions(spark, d):
    return _routed(spark, d)["routes"].select("qid", "route")


_EXTRA = " OR ".join(f"(t = '{t}' AND regexp_matches(array_to_string(c.topics, ' '), '{p}'))" for t, p in vocab.TOPIC_ROW_PATTERNS.items())
_DIST = I.sql_haversine("z.lat", "z.lng", "c.lat", "c.lng", vocab.EARTH_MILES)
SQL_MATCH = f"""asked AS (SELECT DISTINCT cost, after_min, before_min, hours_kind, days, age, age_group, topics, places, near_zip, where_asked FROM routes WHERE route = 'filters'),
  m AS (SELECT f.*, c.id, c.name, c._ord, {_DIST} AS miles FROM asked f JOIN blobs c ON (f.cost IS NULL OR (f.cost = 'free') = c.is_free)
    AND (f.after_min IS NULL OR CASE WHEN f.after_min >= 1020 THEN c.hours_kind = 'evenings' ELSE c.hours_kind <> 'unknown' END) AND f.before_min IS NULL
    AND (f.hours_kind IS NULL OR CASE f.hours_kind WHEN 'evenings' THEN c.hours_kind = 'evenings' ELSE c.hours_kind IN ('after-school', 'evenings') END)
    AND (f.days IS NULL OR list_has_any(f.days, c.days)) AND (f.age IS NULL OR f.age BETWEEN c.age_min AND c.age_max)
    AND (f.age_group IS NULL OR CASE f.age_group WHEN 'teen' THEN c.age_max >= 13 AND c.age_min <= 18 ELSE c.age_max >= 5 AND c.age_min <= 12 END)
    AND (len(f.topics) = 0 OR len(list_filter(f.topics, lambda t: contains(array_to_string(c.topics, ' '), t) OR {_EXTRA})) > 0)
    AND (len(f.places) = 0 OR len(list_filter(f.places, lambda p: contains(c.blob, p))) > 0)
    LEFT JOIN centre z ON z.zip = f.near_zip WHERE f.near_zip IS NULL OR {_DIST} <= 3),
  ranked AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY cost, after_min, before_min, hours_kind, days, age, age_group, topics, places, near_zip, where_asked) AS total FROM m
    WINDOW w AS (PARTITION BY cost, after_min, before_min, hours_kind, days, age, age_group, topics, places, near_zip, where_asked ORDER BY miles NULLS FIRST, _ord))"""
_SAME = " AND ".join(f"r.{c} IS NOT DISTINCT FROM k.{c}" for c in (
    "cost", "after_min", "before_min", "hours_kind", "days", "age", "age_group", "topics", "places", "near_zip", "where_asked"))


@query("q_match_questions", f"{HEAD}, {SQL_ROUTES}, {SQL_MATCH} SELECT r.qid, k.id, k.place, k.total FROM routes r JOIN ranked k ON {_SAME} AND k.place <= 8 WHERE r.route = 'filters'", PV)
def match_questions(spark, d):
    catalog, centres = _catalog(spark, d), _centres(spark, d)
    routes = _routed(spark, d, catalog, centres)["routes"]
    found = Q.match_filters(Q.distinct_filters(routes), catalog, centres)
    return routes.where("route = 'filters'").select("qid", "sig").join(found, "sig").select(
        "qid", "id", F.col("place").cast("bigint").alias("place"), "total")


@query("q_near_zip", f"""{HEAD}, {SQL_ROUTES} SELECT z.zip AS near_zip, c.id, round({_DIST}, 3) AS miles FROM (SELECT DISTINCT near_zip FROM parsed WHERE near_zip IS NOT NULL) r
  JOIN centre z ON z.zip = r.near_zip JOIN catalog c ON {_DIST} <= 3""", PV)
def near_zip(spark, d):
    asked = Q.parse_questions(_questions(spark, d)).where("near_zip IS NOT NULL").select("near_zip")
    return Q.near_zip(asked, I.places(spark, d), I.centres(spark, d)).select(
        "near_zip", "id", F.round("miles", 3).alias("miles"))


_MIN = "(CASE WHEN ({c} // 60) % 12 = 0 THEN 12 ELSE ({c} // 60) % 12 END) || CASE WHEN {c} % 60 = 0 THEN '' ELSE ':' || lpad(CAST({c} % 60 AS VARCHAR), 2, '0') END || CASE WHEN {c} // 60 >= 12 THEN 'pm' ELSE 'am' END"
_LABEL = f"""array_to_string(list_filter([CASE cost WHEN 'unknown' THEN 'ask-provider' ELSE cost END,
  CASE WHEN hours_kind = 'evenings' OR after_min >= 1020 THEN coalesce('open after ' || {_MIN.replace('{c}', 'after_min')}, 'evening') ELSE 'open after ' || {_MIN.replace('{c}', 'after_min')} END,
  'starting before ' || {_MIN.replace('{c}', 'before_min')}, CASE WHEN hours_kind = 'after-school' THEN 'after school' END,
  CASE WHEN coalesce(hours_kind, '') <> 'after-school' THEN array_to_string(days, ' or ') END, 'age ' || age, CASE age_group WHEN 'teen' THEN 'teens' WHEN 'kid' THEN 'kids' END,
  CASE WHEN len(topics) > 0 THEN array_to_string(topics, ' or ') END], lambda x: x IS NOT NULL), ' ')"""
_TITLE = "array_to_string(list_transform(places, lambda p: array_to_string(list_transform(split(p, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')), ' or ')"
_PLACE = f"""CASE WHEN near_zip IS NOT NULL THEN 'within 3 miles of ' || near_zip || CASE WHEN len(places) > 0 THEN ' in ' || {_TITLE} ELSE '' END WHEN len(places) > 0 THEN 'in ' || {_TITLE} ELSE '' END"""


SQL_RENDERED = f"""l AS (SELECT a.*, {_LABEL} AS label, {_PLACE} AS place_text FROM asked a),
  g AS (SELECT cost, after_min, before_min, hours_kind, days, age, age_group, topics, places, near_zip, where_asked, max(total) AS total, list(name ORDER BY place) AS names, array_to_string(list(id ORDER BY place), '|') AS ids FROM ranked WHERE place <= 8 GROUP BY ALL),
  x AS (SELECT r.*, coalesce(total, 0) AS total, coalesce(names, []) AS names, coalesce(ids, '') AS ids, CASE WHEN label <> '' THEN label || ' ' ELSE '' END || CASE WHEN total = 1 THEN 'program' ELSE 'programs' END || CASE WHEN place_text <> '' THEN ' ' || place_text ELSE '' END || ':' AS there FROM l r LEFT JOIN g k ON {_SAME}),
  y AS (SELECT *, CASE WHEN total = 0 THEN 'I couldn''t find a program that matches ' || array_to_string(list_filter([label, place_text], lambda z: z <> ''), ' ') || '. I only know the ' || (SELECT count(*) FROM catalog) || ' NYC programs listed for this directory. Try a borough, ZIP, or a topic like robotics.'
    ELSE CASE WHEN where_asked THEN 'Here''s where to find ' || there ELSE 'I found ' || total || ' ' || there END || CASE WHEN total > 8 THEN ' Showing 8 of ' || total || '. Add a borough, ZIP, or topic to narrow it.' ELSE '' END END AS intro FROM x)"""


@query("q_render_answers", f"""{HEAD}, {SQL_ROUTES}, {SQL_MATCH}, {SQL_RENDERED}
  SELECT intro, total, ids, CASE WHEN total = 0 THEN intro ELSE intro || ' The first programs are ' || array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ', and ' || (len(names) - 3) || ' more' ELSE '' END || '.' END AS spoken FROM y""", PV)
def render_answers(spark, d):
    catalog, centres = _catalog(spark, d), _centres(spark, d)
    filters = Q.distinct_filters(_routed(spark, d, catalog, centres)["routes"])
    found = Q.match_filters(filters, catalog, centres)
    size = catalog.agg(F.count(F.lit(1))).scalar()
    return Q.render_answers(filters, found, catalog, size).select(
        "intro", "total", F.coalesce(F.array_join("ids", "|"), F.lit("")).alias("ids"), "spoken")


def _sql_text(fixed: str) -> str:
    """SQL of a fixed answer text with its marks filled in."""
    out = "'" + fixed.replace("'", "''").replace("{site}", "this directory").replace("{Site}", "This directory") + "'"
    return out.replace("{total}", "' || (SELECT count(*) FROM catalog) || '").replace("{zip}", "' || near_zip || '")


_FAQS = " ".join(
    f"WHEN len(list_filter([{I.sql_list(ps)}], lambda p: contains(q, p))) > 0 THEN {_sql_text(vocab.FAQ_ANSWERS[t])}" for t, ps in vocab.FAQ_PHRASES.items())
_FIXED = " ".join(f"WHEN '{r}' THEN {_sql_text(t)}" for r, t in vocab.ANSWERS.items() if r != "keyword")
_LINE = """c.name || ' is in ' || CASE WHEN c.neighborhood <> '' AND c.area <> '' AND NOT contains(lower(c.neighborhood), lower(c.area)) THEN c.neighborhood || ', ' || c.area
    WHEN c.neighborhood <> '' THEN c.neighborhood WHEN c.area <> '' THEN c.area ELSE c.location END || ', ' || c.hours_label || '. ' || c.cost_label || ', ' || c.ages || '.'
    || CASE WHEN c.org <> '' THEN ' Run by ' || c.org || '.' ELSE '' END || CASE WHEN c.summary <> '' THEN ' ' || c.summary ELSE '' END"""
_GROUPED = "list(name ORDER BY _ord) AS names, string_agg(id, '|' ORDER BY _ord) AS ids"


@query("q_answers", f"""{HEAD}, {SQL_ROUTES}, {SQL_MATCH}, {SQL_RENDERED}, uq AS (SELECT * FROM routes QUALIFY row_number() OVER (PARTITION BY q ORDER BY qid) = 1),
  nl AS (SELECT u.q, c.id, c.name, c._ord, {_LINE} AS line FROM uq u JOIN catalog c ON contains(u.q, lower(c.name)) WHERE u.route = 'named' QUALIFY row_number() OVER (PARTITION BY u.q ORDER BY c._ord) <= 8),
  ng AS (SELECT q, count(*) AS total, string_agg(line, chr(10) || chr(10) ORDER BY _ord) AS intro, {_GROUPED} FROM nl GROUP BY 1),
  kl AS (SELECT k.q, b.id, b.name, b._ord, row_number() OVER (PARTITION BY k.q ORDER BY b._ord) AS rn, count(*) OVER (PARTITION BY k.q) AS total
    FROM kw k JOIN blobs b ON len(list_filter(k.w, lambda x: NOT contains(b.full_text, x))) = 0 WHERE k.q IN (SELECT q FROM uq WHERE route = 'keyword')),
  kg AS (SELECT q, max(total) AS total, {_sql_text(vocab.ANSWERS['keyword'])} || CASE WHEN max(total) > 8 THEN ' Showing 8 of ' || max(total) || '. Add a borough, ZIP, or topic to narrow it.' ELSE '' END AS intro, {_GROUPED} FROM kl WHERE rn <= 8 GROUP BY 1),
  answered AS (SELECT q, total, intro, names, ids FROM ng UNION ALL SELECT q, total, intro, names, ids FROM kg
    UNION ALL SELECT r.q, k.total, k.intro, k.names, k.ids FROM uq r JOIN y k ON {_SAME} WHERE r.route = 'filters'
    UNION ALL SELECT q, 0, CASE route WHEN 'faq' THEN CASE {_FAQS} END {_FIXED} END, [], '' FROM uq WHERE route NOT IN ('named', 'keyword', 'filters'))
  SELECT u.q, u.route, a.intro, a.ids, a.total, trim(regexp_replace(a.intro, '\\s+', ' ', 'g')) || CASE WHEN len(a.names) = 0 THEN '' ELSE ' The first programs are ' || array_to_string(a.names[1:3], ', ')
    || CASE WHEN len(a.names) > 3 THEN ', and ' || (len(a.names) - 3) || ' more' ELSE '' END || '.' END AS spoken FROM uq u JOIN answered a ON a.q = u.q""", PV)
def answers(spark, d):
    """One answer for each distinct question, whichever way it went."""
    catalog, centres = _catalog(spark, d), _centres(spark, d)
    return Q.answer_questions(_routed(spark, d, catalog, centres), catalog, centres).withColumn("ids", F.array_join("ids", "|"))
