"""Queries over sources, sinks, caches, budgets, replies and request streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.replies import recover_json, reply_text
from gazetteer.functions.values import is_definitive
from gazetteer.functions.web import crawl_text
from gazetteer.operators import cache as C
from gazetteer.operators import dataset as D
from gazetteer.operators import evidence as E
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import table, view
from gazetteer.plans.web_queries import SQL_CRAWL
from gazetteer.session import cut_lineage, shared_dir
from gazetteer.sources import files as S
from gazetteer.sources.paged import parquet_pages, read_paged
from gazetteer.streaming import rate as R
from gazetteer.streaming.refresh import current_facts, refresh


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------

@query("q_paged_source", """SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(place) AS BIGINT) AS places
  FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY file_row_number) - 1 AS place FROM (SELECT *, row_number() OVER () AS file_row_number FROM orders)) GROUP BY 1""")
def paged_source(spark, d):
    columns = ["o_orderkey", "o_orderstatus"]
    rows = read_paged(spark, parquet_pages(f"{d.rstrip('/')}/orders.parquet", columns), columns)
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"),
        F.sum("_ord").alias("places"))


@query("q_snapshot_scan", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def snapshot_scan(spark, d):
    path = _folder(spark, "snapshot")
    rows = table(spark, d, "supplier").select(*[F.col(c).cast("string") for c in ("s_suppkey", "s_name", "s_nationkey")])
    rows.write.json(path)
    return S.read_snapshot(spark, path, "s_suppkey string, s_name string, s_nationkey string", "jsonl")


@query("q_optional_source", """SELECT c_custkey, CAST(NULL AS VARCHAR) AS website FROM customer""")
def optional_source(spark, d):
    absent = S.read_or_empty(spark, f"{d.rstrip('/')}/never-written.parquet", "c_custkey bigint, website string")
    return table(spark, d, "customer").select("c_custkey").join(absent, "c_custkey", "left")


@query("q_source_pushdown", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
  ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""")
def source_pushdown(spark, d):
    return S.source_slice(
        table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
        "o_orderstatus = 'F' AND o_totalprice > 100000", [F.desc("o_orderdate"), F.col("o_orderkey")], 500,
    ).drop("o_orderdate")


_CONFIG = """SELECT n_nationkey AS k, '{{"_comment": [], "' || n_name || '": ["' || lower(n_name) || '.org", "x' || CAST(n_regionkey AS STRING) || '.com"]}}' AS domains,
  '{{"_note": {{"domains": [], "why": ""}}, "' || n_name || '": {{"domains": ["bad' || CAST(n_nationkey AS STRING) || '.com"], "why": "hand"}}}}' AS blocked FROM {nation}"""


@query("q_config_dim", """SELECT n_name AS name, lower(n_name) || '.org' AS host, 'known' AS list FROM nation
  UNION ALL SELECT n_name, 'x' || n_regionkey || '.com', 'known' FROM nation UNION ALL SELECT n_name, 'bad' || n_nationkey || '.com', 'hand' FROM nation""")
def config_dim(spark, d):
    texts = spark.sql(_CONFIG, nation=table(spark, d, "nation"))
    known = S.explode_config(texts, "domains", "array<string>").select(
        "name", F.explode("value").alias("host"), F.lit("known").alias("list"))
    blocked = S.explode_config(texts, "blocked", "struct<domains:array<string>,why:string>").select(
        "name", F.explode("value.domains").alias("host"), F.col("value.why").alias("list"))
    return known.unionByName(blocked)


@query("q_dataset_roundtrip", f"""WITH {I.SQL_SCHOOLS}, {I.SQL_CORE} SELECT 'programs' AS part, id AS key, lat, lng FROM core UNION ALL
  SELECT 'schools', dbn, lat, lng FROM schools""", ("sites_raw", "schools_raw"))
def dataset_roundtrip(spark, d):
    path = _folder(spark, "dataset")
    core = D.core_programs(view(spark, d, "sites_raw"))
    schools = D.published_schools(I.schools(spark, d))
    S.write_dataset({"programs": core, "schools": schools}, path, "v1", core.agg(F.count(F.lit(1)).alias("programs")))
    back = S.read_dataset(spark, path, "v1", ["programs", "schools"])
    return back[0].select(F.lit("programs").alias("part"), F.col("id").alias("key"), "lat", "lng").unionByName(
        back[1].select(F.lit("schools").alias("part"), F.col("dbn").alias("key"), "lat", "lng"))


def _joined(*values) -> F.Column:
    return F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("-")) for v in values])


def _sql_joined(*values: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({v} AS VARCHAR), '-')" for v in values) + ")"


@query("q_dataset_publish", f"""WITH {I.SQL_PROGRAMS}, {I.SQL_ZIPS}, counts AS (SELECT unnest(['programs', 'schools', 'zips', 'withTools', 'costConfirmed', 'onSharedCampus']) AS key,
    unnest([(SELECT count(*) FROM programs), (SELECT count(*) FROM schools), (SELECT count(*) FROM zips), (SELECT count(*) FROM programs WHERE len(tools) > 0),
      (SELECT count(*) FROM programs WHERE tier <> 'unknown'), (SELECT count(*) FROM programs WHERE n_co > 1)]) AS n)
  SELECT 'programs' AS part, id AS key, {_sql_joined("name", "provider", "area", "age_range", "zip", "neighborhood", "seats IS NULL", "funded", "tier", "cost_source", "host_dbn", "host_m", "n_co",
    "dbns", "website", "website_confidence", "array_to_string(tools, ',')", "array_to_string(subjects, ',')", "method", "n_photos", "photo_urls")} AS value FROM programs UNION ALL
  SELECT 'schools', dbn, {_sql_joined("name", "grades", "serves_k5")} FROM schools UNION ALL
  SELECT 'zips', zip, {_sql_joined("sites_all", "now")} FROM zips UNION ALL
  SELECT 'counts', key, CAST(n AS VARCHAR) FROM counts UNION ALL
  SELECT 'meta', '{vocab.SCHEMA_VERSION}', '{vocab.PROGRAM_YEAR}|provider websites, ' || CASE WHEN (SELECT bool_or(method = '{vocab.MODEL_METHOD}') FROM programs) THEN 'extracted with a model' ELSE 'keyword matching' END""", I.PROGRAM_VIEWS)
def dataset_publish(spark, d):
    """All four tables written under one version and read back: nested programs, schools, ZIPs and meta."""
    path = _folder(spark, "published")
    tables = {
        "programs": I.programs(spark, d), "schools": D.published_schools(I.schools(spark, d)),
        "zips": lambda t: D.zip_stats(view(spark, d, "sites_raw"), t["programs"].select(F.col("address.zip").alias("zip")))}
    S.write_dataset(tables, path, vocab.SCHEMA_VERSION, lambda t: D.dataset_meta(D.dataset_counts(**t), t["programs"]))
    programs, schools, zips = S.read_dataset(spark, path, vocab.SCHEMA_VERSION, ["programs", "schools", "zips"])
    meta = S.read_meta(spark, path, vocab.SCHEMA_VERSION)
    c, co = F.col, F.col("coLocatedSchools.dbn")
    record = _joined(
        c("name"), c("provider"), c("programArea"), c("ageRange"), c("address.zip"), c("address.neighborhood"), c("seats").isNull(), c("cost.publiclyFunded"),
        c("cost.tier"), c("cost.source"), c("inSchoolBuilding.dbn"), c("inSchoolBuilding.distanceM"), F.size(co),
        F.when(F.size(co) > 0, F.array_join(co, " ")), c("enrichment.website"), c("enrichment.websiteConfidence"), F.array_join("enrichment.stemTools", ","),
        F.array_join("enrichment.subjects", ","), c("enrichment.method"), F.size("photos"), F.when(F.size("photos") > 0, F.array_join("photos.url", " ")))
    counted = meta.select(F.explode("counts").alias("key", "n")).where(
        c("key").isin("programs", "schools", "zips", "withTools", "costConfirmed", "onSharedCampus"))
    parts = [
        programs.select(F.lit("programs").alias("part"), c("id").alias("key"), record.alias("value")),
        schools.select(F.lit("schools").alias("part"), c("dbn").alias("key"), _joined(c("name"), c("grades"), c("servesK5")).alias("value")),
        zips.select(F.lit("zips").alias("part"), c("zip").alias("key"), _joined(c("dycdSitesAllYears"), c("k5ProgramsNow")).alias("value")),
        counted.select(F.lit("counts").alias("part"), "key", c("n").cast("string").alias("value")),
        meta.select(F.lit("meta").alias("part"), c("schemaVersion").alias("key"), _joined(c("programYear"), F.element_at("sources", F.lit("enrichment"))).alias("value")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("q_stage_limit", f"""WITH smoke AS (SELECT * FROM sites_raw ORDER BY _ord LIMIT 500) SELECT trim(provider) AS provider, count(*) AS site_count FROM smoke
  WHERE {I.SQL_COHORT} AND trim(provider) <> '' GROUP BY 1""", ("sites_raw",))
def stage_limit(spark, d):
    """A smoke run of the roster stage: the limit is the feature."""
    return S.run_stage(
        lambda sites: D.roster(D.filter_cohort(sites)).select("provider", "site_count"),
        [view(spark, d, "sites_raw")], _folder(spark, "stage"), limit=500)


# --- replies ----------------------------------------------------------------

_STEPS = "list_filter(CAST(json_extract(reply, '$.steps[*]') AS JSON[]), lambda s: json_extract_string(s, '$.type') = 'model_output')"
SQL_REPLY = f"""texts AS (SELECT event_id, CASE WHEN json_exists(reply, '$.steps') THEN array_to_string(list_transform(list_filter(
    CAST(json_extract({_STEPS}[-1], '$.content[*]') AS JSON[]), lambda c: json_extract_string(c, '$.type') = 'text'), lambda c: json_extract_string(c, '$.text')), '')
  ELSE coalesce(json_extract_string(reply, '$.interaction.output_text'), json_extract_string(reply, '$.output_text'), json_extract_string(reply, '$.candidates[0].content.parts[0].text')) END AS text FROM replies)"""


@query("q_reply_text", f"WITH {SQL_REPLY} SELECT event_id, text FROM texts", ("replies",))
def reply_texts(spark, d):
    return view(spark, d, "replies").select("event_id", reply_text(F.col("reply")).alias("text"))


@query("q_recover_json", f"""WITH {SQL_REPLY} SELECT event_id, text IS NULL AS failed, CAST(coalesce(json_extract_string(body, '$.k'), json_extract_string(body, '$[0].k')) AS BIGINT) AS k
  FROM (SELECT event_id, text, CASE WHEN json_valid(text) THEN text WHEN json_valid(regexp_extract(text, '\\{{[\\s\\S]*\\}}|\\[[\\s\\S]*\\]')) THEN regexp_extract(text, '\\{{[\\s\\S]*\\}}|\\[[\\s\\S]*\\]') END AS body FROM texts)""", ("replies",))
def recovered(spark, d):
    text = view(spark, d, "replies").select("event_id", reply_text(F.col("reply")).alias("text"))
    data = text.withColumn("data", recover_json(F.col("text")))
    return data.select(
        "event_id", F.col("text").isNull().alias("failed"),
        F.coalesce(F.try_variant_get("data", "$.k", "bigint"), F.try_variant_get("data", "$[0].k", "bigint")).alias("k"))


@query("q_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.get_json_object("props", "$.none").alias("none"))


# --- cache, budget, scorer ------------------------------------------------------

_DEFINITIVE = """CASE WHEN ok THEN true WHEN coalesce(error IN ('robots', 'bad url'), false) THEN true WHEN coalesce(status, 0) = 0 THEN false
  ELSE NOT (status IN (408, 425, 429) OR status >= 500) END"""


@query("q_is_definitive", f"SELECT event_id, {_DEFINITIVE} AS final FROM fetches", ("fetches",))
def definitive(spark, d):
    return view(spark, d, "fetches").select(
        "event_id", is_definitive(F.col("ok"), F.col("status"), F.col("error")).alias("final"))


def _keep(df):
    return is_definitive(F.col("ok"), F.col("status"), F.col("error"))


def _cache(spark, d):
    stored = view(spark, d, "fetches").where("user_id % 2 = 0")
    return stored.select(
        C.cache_key(["event_type", "user_id"]).alias("key"), F.col("event_id").alias("stored_at"), "ok", "status", "error")


@query("q_cached_enrich", f"""WITH hit AS (SELECT event_type, user_id, max_by(struct_pack(s := status), event_id).s AS status FROM fetches WHERE user_id % 2 = 0 AND {_DEFINITIVE} GROUP BY 1, 2),
  asked AS (SELECT event_type, user_id, count(*) AS requests FROM fetches GROUP BY 1, 2)
  SELECT a.event_type, a.user_id, a.requests, h.event_type IS NOT NULL AS from_cache, CASE WHEN h.event_type IS NOT NULL THEN h.status ELSE 200 + a.user_id % 300 END AS status
  FROM asked a LEFT JOIN hit h ON h.event_type = a.event_type AND h.user_id = a.user_id""", ("fetches",))
def cached(spark, d):
    def produce(misses):
        return misses.withColumns({
            "status": (200 + F.col("user_id") % 300).cast("int"), "ok": F.lit(False),
            "error": F.lit(None).cast("string")})

    todo = view(spark, d, "fetches").select("event_id", "event_type", "user_id")
    answers, _ = C.cached_enrich(todo, _cache(spark, d), ["event_type", "user_id"], produce, _keep)
    return answers.groupBy("event_type", "user_id", "from_cache", "status").agg(
        F.count(F.lit(1)).alias("requests")).withColumn("status", F.col("status").cast("bigint"))


@query("q_budget", """SELECT event_id, call_no, CASE WHEN call_no <= 2000 THEN CAST(floor((call_no - 1) / 12.0) AS BIGINT) END AS slot
  FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS call_no FROM events)""")
def budget(spark, d):
    todo = table(spark, d, "events").select("event_id")
    return C.apply_budget(todo, "event_id").select("event_id", "call_no", "slot")


@query("q_score", """SELECT event_type, count(*) AS answered, CAST(sum(length(event_type) + user_id % 7) AS BIGINT) AS total FROM (SELECT event_type, user_id, row_number() OVER (ORDER BY o) AS n FROM
  (SELECT event_type, user_id, min(event_id) AS o FROM events GROUP BY 1, 2)) WHERE n <= 600 GROUP BY 1""")
def score(spark, d):
    """A rule stands in for the scorer; 600 calls are allowed, the rest waits."""
    def rule(batches):
        for b in batches:
            yield b[["key"]].assign(points=b["event_type"].str.len() + b["user_id"] % 7)

    todo = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("_ord"))
    nothing = spark.createDataFrame([], "key string, stored_at bigint, points bigint")
    answers, _ = C.score(
        todo, rule, "key string, points bigint", nothing, ["event_type", "user_id"],
        lambda df: F.col("points").isNotNull(), max_calls=600)
    return answers.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("answered"), F.sum("points").alias("total"))


# --- request limits ---------------------------------------------------------------

@query("q_rate_fixed", """SELECT event_id, rn <= 12 AS allowed, CASE WHEN rn > 12 THEN greatest(1, CAST((floor(at_s / 60) + 1) * 60 - at_s AS BIGINT)) END AS retry_after_s FROM
  (SELECT *, row_number() OVER (PARTITION BY client, floor(at_s / 60) ORDER BY at_s, event_id) AS rn FROM requests)""", ("requests",))
def rate_fixed(spark, d):
    return R.rate_fixed(view(spark, d, "requests")).select("event_id", "allowed", "retry_after_s")


SQL_SLIDING = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY at_s, event_id) AS rn FROM requests),
  f AS (SELECT client, 0::BIGINT AS rn, 0::BIGINT AS event_id, true AS allowed, NULL::BIGINT AS wait, []::BIGINT[] AS times FROM (SELECT DISTINCT client FROM o)
    UNION ALL SELECT o.client, o.rn, o.event_id, len(list_filter(times, lambda t: o.at_s - t < 60)) < 12,
      CASE WHEN len(list_filter(times, lambda t: o.at_s - t < 60)) >= 12 THEN greatest(1, 60 - (o.at_s - list_filter(times, lambda t: o.at_s - t < 60)[1])) END,
      CASE WHEN len(list_filter(times, lambda t: o.at_s - t < 60)) < 12 THEN list_append(list_filter(times, lambda t: o.at_s - t < 60), o.at_s) ELSE list_filter(times, lambda t: o.at_s - t < 60) END
    FROM f JOIN o ON o.client = f.client AND o.rn = f.rn + 1) SELECT event_id, allowed, wait AS retry_after_s FROM f WHERE rn > 0"""


@query("q_rate_sliding", SQL_SLIDING, ("requests",))
def rate_sliding(spark, d):
    return R.rate_sliding(view(spark, d, "requests")).select("event_id", "allowed", "retry_after_s")


@query("q_rate_sliding_stream", SQL_SLIDING, ("requests",))
def rate_sliding_stream(spark, d):
    """The same verdicts from the stream, run over everything that is there."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    asked = stream.selectExpr("event_id", "user_id % 10 AS client", "timestamp_seconds(1767225600 + event_id * 7 % 3600) AS at")
    out, store = _folder(spark, "admitted"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, R.ROCKS)
    R.rate_sliding_stream(asked).writeStream.format("parquet").option("path", f"{out}/rows").option(
        "checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(store, before)
    return spark.read.parquet(f"{out}/rows").select("event_id", "allowed", "retry_after_s")


@query("q_over_limit_stream", """SELECT client, CAST(minute AS BIGINT) AS minute, count(*) AS requests FROM (SELECT user_id % 10 AS client, floor(epoch(date_trunc('minute', ts)) / 60) AS minute FROM events)
  GROUP BY 1, 2 HAVING count(*) > 1""")
def over_limit_stream(spark, d):
    """The streaming alert, run over everything that is there."""
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    alerts = R.over_limit(
        stream.select((F.col("user_id") % 10).alias("client"), F.col("ts").cast("timestamp").alias("ts")), limit=1)
    out = _folder(spark, "alerts")
    R.write_alerts(alerts, out).awaitTermination()
    return R.current_alerts(spark, out).select(
        "client", F.floor(F.unix_seconds("minute") / 60).alias("minute"), "requests")


FACTS = "provider string, has_program boolean, contact_email string, contact_phone string"


@query("q_refresh", f"""WITH p AS (SELECT lower(split_part(url, '/', 3)) AS provider, page_id, {SQL_CRAWL} AS text FROM pages WHERE url IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lower(split_part(url, '/', 3)), url ORDER BY page_id DESC) = 1),
  t AS (SELECT *, regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+') AS email, regexp_extract(text, '\\(?\\d{{3}}\\)?[-.\\s]\\d{{3}}[-.\\s]\\d{{4}}') AS phone FROM p)
  SELECT provider, bool_or(regexp_matches(text, '(?i){vocab.HAS_PROGRAM}')) AS has_program,
    coalesce(arg_min(email, page_id) FILTER (email <> ''), '') AS contact_email, coalesce(arg_min(phone, page_id) FILTER (phone <> ''), '') AS contact_phone
  FROM t GROUP BY 1""")
def refreshed(spark, d):
    """Pages arrive twice, every other one empty at first; each organisation ends with the facts of its last pages."""
    pages = table(spark, d, "pages").select(
        F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("provider"), "url",
        crawl_text(F.col("html")).alias("text"), F.col("page_id").alias("_ord"))
    out = _folder(spark, "refresh")
    for arrival in (F.when(F.pmod("_ord", F.lit(2)) == 0, F.col("text")).otherwise(""), F.col("text")):
        pages.withColumn("text", arrival).write.mode("append").parquet(f"{out}/landing")
        stream = spark.readStream.schema(pages.schema).parquet(f"{out}/landing")
        refresh(stream, out, lambda p: E.keyword_facts(p).select(
            "provider", "has_program", "contact_email", "contact_phone"), FACTS).awaitTermination()
    return current_facts(spark, out, FACTS)
