"""Queries that check tables, and near-copies of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.operators import dataset as D
from gazetteer.operators import images as M
from gazetteer.operators import quality as Q
from gazetteer.operators.similar import near_duplicate_groups
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import table, view
from gazetteer.session import cut_lineage, stored

PV = I.PROGRAM_VIEWS
_RULES = {
    "id-present": "id <> ''",
    "cost-tier-known": f"tier IN ({I.sql_list(vocab.COST_TIERS)})",
    "cost-source-known": f"cost_source IN ({I.sql_list(vocab.COST_SOURCES)})",
    "price-has-source": "tier = 'unknown' OR CASE WHEN cost_source = 'dycd-program-rules' THEN area = 'Compass' ELSE cost_source = 'provider-website' AND coalesce(method, '') = 'gemini' END",
    "keywords-quoted": "coalesce(method, '') <> 'keyword' OR len(tools) = 0 OR len(evidence) > 0",
    "model-tools-backed": "coalesce(method, '') <> 'gemini' OR len(tools) = 0 OR len(evidence) > 0",
    "arrays-present": "tools IS NOT NULL AND evidence IS NOT NULL",
    "inside-box": "lat IS NULL OR lng IS NULL OR (lat > 40.4 AND lat < 41.0 AND lng > -74.3 AND lng < -73.6)",
    "host-in-radius": "host_m IS NULL OR host_m <= 120",
    "host-serves-when-possible": "host_dbn IS NULL OR host_k5 OR NOT EXISTS (SELECT 1 FROM pairs x WHERE x.id = p.id AND x.serves_k5)",
    "host-is-co-located": "host_dbn IS NULL OR EXISTS (SELECT 1 FROM pairs x WHERE x.id = p.id AND x.dbn = p.host_dbn)",
    "photos-attributed": "photo_pages IS NULL OR len(list_filter(photo_pages, lambda x: x = '')) = 0",
}
_ZERO = "UNION ALL SELECT '{}', 'pass', 0 "
SQL_QUALITY = " UNION ALL ".join(
    f"SELECT '{n}' AS check, CASE WHEN count(*) FILTER (NOT coalesce({r}, false)) = 0 THEN 'pass' ELSE 'fail' END AS level, count(*) FILTER (NOT coalesce({r}, false)) AS failing FROM programs p"
    for n, r in _RULES.items()) + " " + "".join(
    _ZERO.format(n) for n in ("counts-match", "density-matches", "version-declared")) + """UNION ALL SELECT 'ids-unique', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*) FROM
  (SELECT id FROM programs GROUP BY id HAVING count(*) > 1)"""


@query("q_quality", f"WITH {I.SQL_PROGRAMS} {SQL_QUALITY}", PV)
def quality(spark, d):
    programs, schools = stored(I.programs(spark, d).drop("coLocatedSchools")), I.schools(spark, d)  # no rule reads the lists
    zips = I.zips(spark, d)
    counts = cut_lineage(D.dataset_counts(programs, schools, zips))
    meta = D.dataset_meta(counts, programs)
    return Q.check_contract(programs, zips, schools, counts, meta)


SQL_CHECKS = f"""last AS (SELECT * FROM facts), c AS (SELECT lower(split_part(url, '/', 3)) AS provider FROM pages GROUP BY 1),
  r AS (SELECT r.provider, f.website, f.confidence FROM (SELECT DISTINCT trim(provider) AS provider FROM sites_raw WHERE {I.SQL_COHORT} AND trim(provider) <> '') r LEFT JOIN facts f ON f.provider = r.provider),
  kept AS (SELECT * FROM photos_raw WHERE width >= 400)"""


@query("q_stage_checks", f"""WITH {I.SQL_FACTS}, {SQL_CHECKS}
  SELECT 'resolve' AS stage, 'some-verified' AS check, CASE WHEN count(website) > 0 THEN 'pass' ELSE 'fail' END AS level FROM r UNION ALL
  SELECT 'resolve', 'confidence-known', CASE WHEN count(*) FILTER (website <> '' AND coalesce(confidence, '') NOT IN ('strong', 'acronym')) = 0 THEN 'pass' ELSE 'fail' END FROM r UNION ALL
  SELECT 'resolve', 'route-recorded', CASE WHEN count(*) FILTER (website <> '' AND regexp_extract(website, '//([^/]+)', 1) = '') = 0 THEN 'pass' ELSE 'warn' END FROM r UNION ALL
  SELECT 'extract', 'facts-cover', CASE WHEN (SELECT count(*) FROM r WHERE provider NOT IN (SELECT provider FROM facts)) = 0 THEN 'pass' ELSE 'fail' END UNION ALL
  SELECT 'extract', 'all-by-model', CASE WHEN count(*) FILTER (method = 'gemini') = count(*) THEN 'pass' ELSE 'warn' END FROM facts UNION ALL
  SELECT 'extract', 'tools-backed', CASE WHEN count(*) FILTER (method = 'gemini') = 0 THEN 'warn' WHEN count(*) FILTER (method = 'gemini' AND len(tools) > 0 AND len(evidence) = 0) = 0 THEN 'pass' ELSE 'fail' END FROM facts UNION ALL
  SELECT 'extract', 'subjects-quoted', 'pass' UNION ALL
  SELECT 'images', 'photos-cover', CASE WHEN (SELECT count(*) FROM r WHERE provider NOT IN (SELECT provider FROM kept)) = 0 THEN 'pass' ELSE 'warn' END UNION ALL
  SELECT 'images', 'all-judged', CASE WHEN count(*) FILTER (judged) = count(*) THEN 'pass' ELSE 'warn' END FROM kept UNION ALL
  SELECT 'images', 'scores-present', CASE WHEN count(*) FILTER (judged) = 0 THEN 'warn' WHEN count(*) FILTER (judged AND suitability IS NULL) = 0 THEN 'pass' ELSE 'fail' END FROM kept UNION ALL
  SELECT 'images', 'reasons-recorded', 'pass' UNION ALL
  SELECT 'crawl', 'all-crawled', CASE WHEN (SELECT count(*) FROM c) >= (SELECT count(website) FROM r) THEN 'pass' ELSE 'warn' END UNION ALL
  SELECT 'crawl', 'text-found', CASE WHEN (SELECT count(*) FROM (SELECT lower(split_part(url, '/', 3)) AS h, max(length(html)) AS m FROM pages GROUP BY 1) WHERE m <= 200) = 0 THEN 'pass' ELSE 'warn' END""",
       ("sites_raw", "facts_raw", "photos_raw"))
def stage_checks(spark, d):
    providers = cut_lineage(I.roster(spark, d))
    facts = D.last_per_provider(I.facts(spark, d))
    photos = view(spark, d, "photos_raw").withColumn("reason", F.when(F.col("width") < 400, "too-small"))
    kept, ledger = M.split_by_reason(photos)
    pages = view(spark, d, "web_pages").select(F.col("host").alias("provider"), F.col("html").alias("text"))
    return (
        Q.check_resolve(providers)
        .unionByName(Q.check_extract(facts, providers))
        .unionByName(Q.check_images(kept, ledger, providers))
        .unionByName(Q.check_crawl(pages, providers))
    )


@query("q_coverage", f"""WITH w AS (SELECT DISTINCT trim(provider) AS provider FROM sites_raw), h AS (SELECT DISTINCT provider FROM facts_raw)
  SELECT count(*) AS expected, count(*) FILTER (provider NOT IN (SELECT provider FROM h)) AS missing, min(provider) FILTER (provider NOT IN (SELECT provider FROM h)) AS example FROM w""", ("sites_raw", "facts_raw"))
def coverage(spark, d):
    wanted = view(spark, d, "sites_raw").select(D.fold_ends(F.col("provider")).alias("provider"))
    return Q.coverage(view(spark, d, "facts_raw"), wanted)


@query("q_staleness", """SELECT event_type AS input, epoch_us(max(ts)) AS changed_us, max(ts) > (SELECT max(ts) FROM events WHERE event_type = 'view') AS stale FROM events WHERE event_type <> 'view' GROUP BY 1""")
def staleness(spark, d):
    events = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("updated_at"))
    inputs = {t: events.where(F.col("event_type") == t) for t in ("click", "error", "purchase", "signup")}
    return Q.stale_inputs(events.where("event_type = 'view'"), inputs).select(
        "input", F.unix_micros("changed_at").alias("changed_us"), "stale")


@query("q_build_checks", f"""WITH {I.SQL_PROGRAMS}, late AS (SELECT count(*) AS n FROM
    (SELECT max(ts) AS last FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup') GROUP BY event_type)
    WHERE last > (SELECT max(ts) FROM events WHERE event_type = 'view'))
  SELECT 'build' AS stage, 'newer-than-inputs' AS check, CASE WHEN n = 0 THEN 'pass' ELSE 'warn' END AS level FROM late UNION ALL
  SELECT 'build', 'ids-unique', CASE WHEN count(*) = count(DISTINCT id) THEN 'pass' ELSE 'fail' END FROM programs UNION ALL
  SELECT 'build', 'tools-are-arrays', CASE WHEN count(*) FILTER (tools IS NULL) = 0 THEN 'pass' ELSE 'fail' END FROM programs UNION ALL
  SELECT 'build', 'free-not-by-keyword', CASE WHEN count(*) FILTER (tier = 'free' AND method = 'keyword') = 0 THEN 'pass' ELSE 'warn' END FROM programs""", PV)
def build_checks(spark, d):
    """Checks of the built dataset against the inputs it was made from."""
    events = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("updated_at"))
    inputs = {t: events.where(F.col("event_type") == t) for t in ("click", "error", "purchase", "signup")}
    programs = cut_lineage(I.programs(spark, d).select("id", "cost", "enrichment"))
    return Q.check_build(programs, Q.stale_inputs(events.where("event_type = 'view'"), inputs))


@query("q_near_duplicates", """WITH RECURSIVE t AS (
  SELECT source, doc_id, split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
  u AS (SELECT source, doc_id, len(w) AS size, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM t),
  s AS (SELECT DISTINCT source, doc_id, hash(concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o)) AS h
    FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY i = 1 OR i + 4 <= size),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.source = b.source AND a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared / (na.n + nb.n - shared) >= 0.7),
  r AS (SELECT doc_id AS a, doc_id AS label FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.a)
  SELECT a AS doc_id, min(label) AS label FROM r GROUP BY 1""")
def near_duplicates(spark, d):
    """Near-copies among the documents; similarity is checked on the shingles themselves."""
    return near_duplicate_groups(view(spark, d, "documents"))
