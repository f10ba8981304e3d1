"""Queries over fetched pages: text, links, images, identity, websites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions import text as T
from gazetteer.functions import web as W
from gazetteer.operators import order as O
from gazetteer.operators import pages as P
from gazetteer.operators import resolve as R
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import view

# White space as ECMAScript has it, in RE2 notation.
SP = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sql_strip(c: str, blocks: list[str]) -> str:
    for b in blocks:
        c = f"regexp_replace({c}, '(?i)<{b}[\\s\\S]*?</{b}>', ' ', 'g')"
    return f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"


def sql_fold(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}+', ' ', 'g'))"


SQL_VISIBLE = sql_fold(f"regexp_replace({sql_strip('html', ['script', 'style', 'noscript'])}, '&nbsp;', ' ', 'g')")
SQL_CRAWL = sql_fold(
    f"regexp_replace({sql_strip('html', ['script', 'style', 'noscript', 'svg'])}, '&(nbsp|amp|quot|#39|rsquo|ldquo|rdquo);', ' ', 'g')")
_Q = "[\"'']"
SQL_IDENTITY = (
    "lower(regexp_replace(array_to_string(regexp_extract_all(html, '(?i)<title[^>]*>([\\s\\S]{0,300}?)</title>', 1), ' ') || ' ' || "
    "array_to_string(regexp_extract_all(html, '(?i)<meta[^>]+(?:property|name)=" + _Q + "(?:og:site_name|og:title|description)" + _Q + "[^>]+content=" + _Q + "([^\"'']{0,300})" + _Q + "', 1), ' ') || ' ' || "
    "array_to_string(regexp_extract_all(html, '(?i)<h1[^>]*>([\\s\\S]{0,200}?)</h1>', 1), ' '), '<[^>]+>', ' ', 'g'))"
)
SQL_TOKENS = (
    "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(replace(lower({c}), '&', ' and '), '"
    + vocab.LEGAL_WORDS + "', ' ', 'g'), '[^a-z0-9\\s-]', ' ', 'g'), '[\\s-]+'), lambda w: w <> '' AND w NOT IN ("
    + I.sql_list(vocab.NAME_STOPWORDS) + "))"
)


def sql_tokens(c: str) -> str:
    return SQL_TOKENS.replace("{c}", c)


def sql_signals(c: str) -> str:
    return I.sql_distinct(
        f"list_filter({sql_tokens(c)}, lambda w: length(w) >= 4 AND w NOT IN ({I.sql_list(vocab.TRIMMABLE)}))")


SQL_HOST = "regexp_replace(lower(regexp_extract({c}, '(?i)^(?:https?://)?(?:[^/?#@\\s]*@)?([^/?#:@\\s]+)(?::\\d+)?(?:[/?#].*)?$', 1)), '^www\\.', '')"
SQL_ENCODE = "array_to_string(list_transform(string_split({c}, ''), lambda ch: CASE WHEN ch = ' ' THEN '%20' WHEN unicode(ch) > 127 THEN url_encode(ch) ELSE ch END), '')"
SQL_ORIGIN = "lower(regexp_extract(url, '(?i)^https?://[^/?#]*'))"


@query("q_visible_text", f"SELECT _ord, {SQL_VISIBLE} AS text FROM web_pages", ("web_pages",))
def visible_text(spark, d):
    return view(spark, d, "web_pages").select("_ord", W.visible_text(F.col("html")).alias("text"))


@query("q_crawl_text", f"SELECT _ord, {SQL_CRAWL} AS text FROM web_pages", ("web_pages",))
def crawl_text(spark, d):
    return view(spark, d, "web_pages").select("_ord", W.crawl_text(F.col("html")).alias("text"))


@query("q_page_identity", f"SELECT _ord, {SQL_IDENTITY} AS identity FROM web_pages", ("web_pages",))
def page_identity(spark, d):
    return view(spark, d, "web_pages").select("_ord", W.page_identity(F.col("html")).alias("identity"))


_LINK = "(?i)<a\\b[^>]*href=" + _Q + "([^\"'']+)" + _Q + "[^>]*>([\\s\\S]{0,120}?)</a>"
SQL_LINKS = f"""links AS (SELECT _ord, url, host, pos, href, trim(regexp_replace(raw, '<[^>]+>', ' ', 'g')) AS label,
  {SQL_ORIGIN} || {SQL_ENCODE.format(c='href')} AS link FROM (
  SELECT _ord, url, host, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{_LINK}', 2)) AS raw,
    unnest(range(len(regexp_extract_all(html, '{_LINK}', 1)))) AS pos FROM web_pages))"""


@query("q_extract_links", f"WITH {SQL_LINKS} SELECT _ord, pos, href, label, link FROM links", ("web_pages",))
def extract_links(spark, d):
    return P.extract_links(view(spark, d, "web_pages")).select(
        "_ord", F.col("pos").cast("bigint").alias("pos"), "href", "label", "link")


WANTED, UNWANTED = "(tion|ung|que)", "(and|des)"


@query("q_select_links", f"""WITH {SQL_LINKS} SELECT url, link, label FROM (SELECT *, row_number() OVER (PARTITION BY url, link ORDER BY pos) AS rn
  FROM links WHERE NOT regexp_matches(href, '(?i){UNWANTED}') AND (regexp_matches(href, '(?i){WANTED}') OR regexp_matches(label, '(?i){WANTED}'))) WHERE rn = 1""", ("web_pages",))
def select_links(spark, d):
    links = P.extract_links(view(spark, d, "web_pages"))
    return P.select_links(links, WANTED, UNWANTED).select("url", "link", "label")


@query("q_dedupe_urls", f"""WITH {SQL_LINKS} SELECT host, link, _ord FROM (SELECT *, row_number() OVER (PARTITION BY host, link ORDER BY _ord, pos) AS rn
  FROM links) WHERE rn = 1""", ("web_pages",))
def dedupe_urls(spark, d):
    links = P.extract_links(view(spark, d, "web_pages"))
    return P.dedupe_urls(links, ["host"], [F.col("_ord"), F.col("pos")]).select("host", "link", "_ord")


@query("q_cap_per_group", f"""WITH {SQL_LINKS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY host, link ORDER BY _ord, pos) AS rn FROM links)
  SELECT host, link, CASE WHEN row_number() OVER (PARTITION BY host ORDER BY _ord, pos) > 6 THEN 'past-page-limit' END AS reason
  FROM firsts WHERE rn = 1""", ("web_pages",))
def cap_per_group(spark, d):
    links = P.extract_links(view(spark, d, "web_pages"))
    order = [F.col("_ord"), F.col("pos")]
    return O.cap_per_group(
        P.dedupe_urls(links, ["host"], order), ["host"], order, vocab.PAGES_PER_PROVIDER, "past-page-limit"
    ).select("host", "link", "reason")


_REJ = vocab.REJECT_IMAGE_NAME.replace("'", "''")
SQL_IMAGES = f"""images AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, link ORDER BY pos) AS rn FROM (
  SELECT _ord, url, pos, alt, CASE WHEN src LIKE 'http%' THEN src WHEN src LIKE '/%' THEN {SQL_ORIGIN} || src
    ELSE {SQL_ORIGIN} || CASE WHEN regexp_extract(url, '(?i)^https?://[^/?#]*(/[^?#]*/|/)', 1) = '' THEN '/' ELSE regexp_extract(url, '(?i)^https?://[^/?#]*(/[^?#]*/|/)', 1) END || src END AS link
  FROM (SELECT _ord, url, unnest([
      {{'pos': 0, 'src': '/img/a' || _ord || '.jpg', 'alt': 'Kids at work ' || _ord}},
      {{'pos': 1, 'src': 'https://cdn.example.org/b' || (_ord % 50) || '.png', 'alt': ''}},
      {{'pos': 2, 'src': 'c' || _ord || '.webp', 'alt': 'x'}},
      {{'pos': 7, 'src': '/og' || (_ord % 7) || '.jpg', 'alt': 'og:image'}}], recursive := true) FROM page_images))
  WHERE NOT regexp_matches(link, '(?i){_REJ}')) WHERE rn = 1)"""


@query("q_extract_images", f"WITH {SQL_IMAGES} SELECT _ord, pos, link, alt FROM images", ("page_images",))
def extract_images(spark, d):
    return P.extract_images(view(spark, d, "page_images")).select(
        "_ord", F.col("pos").cast("bigint").alias("pos"), "link", "alt")


@query("q_plausible_urls", f"""SELECT _ord, url, NOT regexp_matches(url, '(?i){_REJ}') AND NOT regexp_matches(url, '(?i)\\.(svg|ico|gif)(\\?|$)')
  AND NOT regexp_matches(url, '(?i)^data:') AS plausible FROM (SELECT _ord, regexp_replace(url, '\\.jpg', CASE _ord % 4 WHEN 0 THEN '-Logo.jpg' WHEN 1 THEN '.GIF?x=1'
  WHEN 2 THEN '.svg' ELSE '.jpg' END) AS url FROM image_rows)""", ("image_rows",))
def plausible_urls(spark, d):
    end = F.element_at(F.array(*[F.lit(x) for x in ("-Logo.jpg", ".GIF?x=1", ".svg", ".jpg")]),
                       (F.col("_ord") % 4 + 1).cast("int"))
    return view(spark, d, "image_rows").select(
        "_ord", F.regexp_replace(F.col("url"), F.lit(r"\.jpg"), end).alias("url")
    ).withColumn("plausible", W.plausible_image(F.col("url")))


@query("q_robots", f"""SELECT w._ord, w.url FROM web_pages w WHERE NOT EXISTS (SELECT 1 FROM robots r WHERE r.host = w.host AND
  starts_with(CASE WHEN regexp_extract(w.url, '(?i)^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(w.url, '(?i)^https?://[^/?#]*([^?#]*)', 1) END, r.rule))""",
       ("web_pages", "robots"))
def robots(spark, d):
    return P.allowed_urls(view(spark, d, "web_pages"), view(spark, d, "robots")).select("_ord", "url")


@query("q_fetch_plan", """SELECT _ord, host, (row_number() OVER (PARTITION BY host ORDER BY _ord) - 1) * 1000 AS at_ms FROM web_pages""", ("web_pages",))
def fetch_plan(spark, d):
    return P.fetch_plan(view(spark, d, "web_pages")).select("_ord", "host", "at_ms")


@query("q_host_of", f"""SELECT _ord, {SQL_HOST.format(c='url')} AS host, regexp_extract(url, '^[^?#]*') AS url_key,
  regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '^www\\.', '') = 'blog.tionsh.example.net' AS same,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '/.*$', ''), '^www\\.', '') AS domain FROM web_pages""", ("web_pages",))
def host_of(spark, d):
    u = F.col("url")
    return view(spark, d, "web_pages").select(
        "_ord", W.host_of(u).alias("host"), W.url_key(u).alias("url_key"),
        W.same_site(u, F.lit("http://www.blog.tionsh.example.net/x")).alias("same"),
        W.clean_domain(u).alias("domain"))


@query("q_canonical_key", """SELECT _ord, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, 'https?://(?:www\\.)?([^?#]*)', 1)),
  '/styles/[^/]+/(public|private)/', '/'), '\\.(jpe?g|png)\\.webp$', '.\\1'), '-\\d{2,5}x\\d{2,5}(\\.[a-z0-9]+)$', '\\1'), '-(scaled|rotated)(\\.[a-z0-9]+)$', '\\2'), '@\\dx(\\.[a-z0-9]+)$', '\\1') AS key
  FROM image_rows""", ("image_rows",))
def canonical_key(spark, d):
    return view(spark, d, "image_rows").select("_ord", W.canonical_image_key(F.col("url")).alias("key"))


# --- names -----------------------------------------------------------------

_NAMES = """names AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'The ' || n_name || ' Community Center of NY, Inc.'
  WHEN 1 THEN 'New York ' || r_name || ' Youth & Family Services LLC' WHEN 2 THEN upper(r_name) || ' HOUSE INC'
  WHEN 3 THEN 'YMCA of Greater ' || r_name || '/Corporate' ELSE 'Robotics-Club ' || n_name || ' (R' END AS name
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey)"""
_NAMES_DUCK = _NAMES.format(supplier="supplier", nation="nation", region="region")


def _names(spark, d):
    tables = {t: view(spark, d, t) for t in ("supplier", "nation", "region")}
    return spark.sql(f"WITH {_NAMES} SELECT * FROM names", **tables)


@query("q_name_signals", f"""WITH {_NAMES_DUCK} SELECT k, array_to_string({sql_tokens('name')}, '|') AS tokens,
  array_to_string({sql_signals('name')}, '|') AS signals FROM names""")
def name_signals(spark, d):
    return _names(spark, d).select(
        "k", F.array_join(T.name_tokens(F.col("name")), "|").alias("tokens"),
        F.array_join(T.name_signals(F.col("name")), "|").alias("signals"))


_GEN = I.sql_list(vocab.TOO_GENERIC)


def _base(a: str) -> str:
    return f"CASE WHEN length(array_to_string({a}, '')) BETWEEN 4 AND 30 AND NOT (len({a}) = 1 AND {a}[1] IN ({_GEN})) THEN array_to_string({a}, '') END"


SQL_DOMAINS = f"""WITH {_NAMES_DUCK}, t AS (SELECT k, {sql_tokens('name')} AS t FROM names), t2 AS (SELECT k, t,
    list_filter(t, lambda w: w NOT IN ({I.sql_list(vocab.TRIMMABLE)})) AS m FROM t),
  t3 AS (SELECT *, CASE WHEN len(m) >= 2 THEN m ELSE t END AS a, coalesce(m[1], t[1]) AS one FROM t2),
  t4 AS (SELECT k, list_filter([{_base('t')}, {_base('m')}, {_base('t[1:4]')}, {_base('m[1:3]')}, {_base('t[1:2]')},
    CASE WHEN len(a) BETWEEN 3 AND 6 THEN array_to_string(list_transform(a, lambda w: left(w, 1)), '') END,
    CASE WHEN length(one) >= 5 AND one NOT IN ({_GEN}) THEN one END], lambda b: b IS NOT NULL) AS b FROM t3)"""


@query("q_domain_candidates", f"""{SQL_DOMAINS} SELECT k, array_to_string(flatten(list_transform({I.sql_distinct('b')},
  lambda x: [x || '.org', x || '.com', x || '.nyc'])), '|') AS candidates FROM t4""")
def domain_candidates(spark, d):
    return _names(spark, d).select(
        "k", F.array_join(T.domain_candidates(F.col("name")), "|").alias("candidates"))


@query("q_tidy_org", f"""WITH {_NAMES_DUCK}, s AS (SELECT k, {I.SQL_TIDY.format(c='name')} AS s FROM names)
  SELECT k, CASE WHEN s = upper(s) AND regexp_matches(s, '\\s') THEN array_to_string(list_transform(split(s, ' '),
  lambda w: left(w, 1) || lower(substr(w, 2))), ' ') ELSE s END AS org FROM s""")
def tidy_org(spark, d):
    return _names(spark, d).select("k", T.tidy_org(F.col("name")).alias("org"))


_KEY = ("regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower({c}), '\\([^)]*\\)?', ' ', 'g'), '&', ' and '), "
        "'\\bnew york\\b', 'ny', 'g'), '\\b(the|inc|incorporated|llc|ltd|corp|corporation)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')")
_KNOWN = """known AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name || ' community center of new york (old' WHEN 1 THEN '_comment'
  ELSE 'the ' || n_name || ' Community Center of NY' END AS name, 'h' || CAST(n_nationkey AS STRING) || '.org,www.h' || CAST(n_nationkey % 4 AS STRING) || '.org' AS hosts_text FROM {nation})"""


@query("q_normalized_join", f"""WITH {_NAMES_DUCK}, {_KNOWN.format(nation='nation')} SELECT DISTINCT names.k, names.name AS provider, host FROM names JOIN
  (SELECT name, unnest(split(hosts_text, ',')) AS host FROM known WHERE NOT starts_with(name, '_')) e ON {_KEY.format(c='names.name')} = {_KEY.format(c='e.name')}""")
def normalized_join(spark, d):
    known = spark.sql(f"WITH {_KNOWN} SELECT * FROM known", nation=view(spark, d, "nation")).withColumn(
        "hosts", F.split("hosts_text", ","))
    return R.normalized_join(_names(spark, d).withColumnRenamed("name", "provider"), known).select("k", "provider", "host")


# --- verification and resolution ---------------------------------------------

MARKERS = r"\b(the|que|der|la)\b"
_WEAK = I.sql_list(vocab.WEAK_SIGNALS)
_RE = {k: v.replace("'", "''") for k, v in {"ph": vocab.PARKED_HOSTS, "pt": vocab.PARKED_TEXT}.items()}
# Signals of a host: the first three of the title of its lowest page.
SQL_SIGNALS = f"""titles AS (SELECT host, regexp_extract(html, '(?i)<title[^>]*>([\\s\\S]{{0,300}}?)</title>', 1) AS title
    FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY _ord) AS rn FROM web_pages) WHERE rn = 1),
  signals AS (SELECT host, {sql_signals('title')} AS signals FROM titles)"""
SQL_JUDGE = f"""j0 AS (SELECT *, {SQL_IDENTITY} AS identity, {SQL_VISIBLE} AS text FROM asked),
  j1 AS (SELECT *, list_filter(signals, lambda s: contains(identity, s)) AS hit,
    list_filter(signals, lambda s: contains(identity || ' ' || lower(text), s)) AS found,
    split_part(regexp_replace(host, '^www\\.', ''), '.', 1) AS base,
    array_to_string(list_transform(signals, lambda s: left(s, 1)), '') AS initials FROM j0),
  j2 AS (SELECT *, len(list_filter(hit, lambda s: s NOT IN ({_WEAK}))) AS dist FROM j1),
  judged AS (SELECT *, CASE
    WHEN len(signals) = 0 OR regexp_matches(host, '(?i){_RE['ph']}') OR regexp_matches(url, '(?i){_RE['ph']}') OR regexp_matches(identity, '(?i){_RE['pt']}')
      OR regexp_matches(html, '(?i){_RE['pt']}') OR NOT (length(text) < 400 OR regexp_matches(text, '(?i){MARKERS}')) THEN NULL
    WHEN curated AND len(found) > 0 AND len(found) / len(signals) >= 0.5 THEN 'strong:' || array_to_string(found, '|')
    WHEN dist = 0 THEN NULL WHEN base IN ({_WEAK}) AND dist < 2 THEN NULL
    WHEN len(hit) / len(signals) >= 0.6 OR dist >= 2 THEN 'strong:' || array_to_string(hit, '|')
    WHEN length(base) <= 6 AND (contains(initials, base) OR contains(base, initials)) THEN 'acronym:' || array_to_string(hit, '|') END AS verdict FROM j2)"""


def _signals(spark, d):
    title = F.regexp_extract("html", r"(?i)<title[^>]*>([\s\S]{0,300}?)</title>", 1)
    first = O.first_per(view(spark, d, "web_pages"), ["host"], F.col("_ord"))
    return first.select("host", T.name_signals(title).alias("signals"))


@query("q_verify_pages", f"""WITH {SQL_SIGNALS}, asked AS (SELECT w.*, s.signals, w._ord % 3 = 0 AS curated FROM web_pages w JOIN signals s ON s.host = w.host),
  {SQL_JUDGE} SELECT _ord, split_part(verdict, ':', 1) AS confidence, split_part(verdict, ':', 2) AS matched FROM judged""", ("web_pages",))
def verify_pages(spark, d):
    pages = view(spark, d, "web_pages").join(_signals(spark, d), "host").select(
        "*", F.col("url").alias("final_url"), (F.col("_ord") % 3 == 0).alias("curated"))
    return R.verify_pages(pages, MARKERS).select("_ord", "confidence", F.array_join("matched", "|").alias("matched"))


@query("q_looks_local", f"SELECT doc_id, length(text) < 400 OR regexp_matches(text, '(?i){MARKERS}') AS local FROM documents")
def looks_local(spark, d):
    return view(spark, d, "documents").select("doc_id", T.looks_local(F.col("text"), MARKERS).alias("local"))


_SITES = "websites AS (SELECT host AS provider, arg_min(url, _ord) AS website FROM web_pages GROUP BY 1)"
SQL_BLOCKED = "(w.h = b.domain OR ends_with(w.h, '.' || b.domain))"


@query("q_blocklist", f"""WITH {_SITES}, w AS (SELECT *, {SQL_HOST.format(c='website')} AS h FROM websites), hit AS (SELECT w.provider, min(b.why) AS why FROM w JOIN blocklist_raw b
  ON b.provider = w.provider AND {SQL_BLOCKED} GROUP BY 1) SELECT w.provider, CASE WHEN hit.provider IS NULL THEN website END AS website,
  CASE WHEN hit.provider IS NULL THEN 'strong' ELSE 'unresolved' END AS confidence, hit.why FROM w LEFT JOIN hit ON hit.provider = w.provider""", ("web_pages", "blocklist_raw"))
def blocklist(spark, d):
    sites = view(spark, d, "web_pages").groupBy(F.col("host").alias("provider")).agg(
        F.min_by("url", "_ord").alias("website")).withColumn("confidence", F.lit("strong"))
    cleaned, cleared = R.apply_blocklist(sites, view(spark, d, "blocklist_raw"))
    return cleaned.join(cleared.select("provider", "why"), "provider", "left").select(
        "provider", "website", "confidence", "why")


SQL_CANDIDATES = f"""cand AS (SELECT host AS provider, {SQL_HOST.format(c='host')} AS host, 0 AS source_rank, 0 AS pos FROM signals WHERE length(host) % 4 = 0
    UNION ALL SELECT host, substr(host, strpos(host, '.') + 1), 1, 0 FROM signals UNION ALL SELECT host, {SQL_HOST.format(c='host')}, 1, 1 FROM signals),
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, host ORDER BY source_rank, pos) AS rn FROM cand) WHERE rn = 1)"""


def _candidates(spark, d):
    hosts = _signals(spark, d).select(F.col("host").alias("provider"))
    zero = F.lit(0).cast("bigint")
    own = R.host_of(F.col("provider"))
    known = hosts.where("length(provider) % 4 = 0").select("provider", own.alias("host"), zero.alias("pos"))
    above = F.expr("substr(provider, instr(provider, '.') + 1)")
    made = hosts.select("provider", F.posexplode(F.array(above, own)).alias("pos", "host"))
    return R.union_candidates(known, made.select("provider", "host", F.col("pos").cast("bigint").alias("pos")))


@query("q_union_candidates", f"""WITH {SQL_SIGNALS}, {SQL_CANDIDATES} SELECT provider, host, source_rank, pos FROM ranked""", ("web_pages",))
def union_candidates(spark, d):
    return _candidates(spark, d).select("provider", "host", "source_rank", "pos")


@query("q_resolve", f"""WITH {SQL_SIGNALS}, {SQL_CANDIDATES},
  home AS (SELECT * FROM (SELECT {SQL_HOST.format(c='url')} AS h, url, html, row_number() OVER (PARTITION BY {SQL_HOST.format(c='url')} ORDER BY url LIKE 'https:%' DESC, _ord) AS rn FROM web_pages) WHERE rn = 1),
  asked AS (SELECT c.provider, c.host, c.source_rank, c.pos, c.source_rank = 0 AS curated, s.signals, home.url, home.html FROM ranked c JOIN signals s ON s.host = c.provider JOIN home ON home.h = c.host
    WHERE NOT EXISTS (SELECT 1 FROM blocklist_raw b WHERE b.provider = c.provider AND (c.host = b.domain OR ends_with(c.host, '.' || b.domain)))),
  {SQL_JUDGE} SELECT provider, url AS website, host AS resolved_via, split_part(verdict, ':', 1) AS confidence, CASE source_rank WHEN 0 THEN 'known' ELSE 'generated' END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY source_rank, pos) AS rn FROM judged WHERE verdict IS NOT NULL) WHERE rn = 1""", ("web_pages", "blocklist_raw"))
def resolve(spark, d):
    signals = _signals(spark, d).withColumnRenamed("host", "provider")
    asked = _candidates(spark, d).join(signals, "provider").withColumn("curated", F.col("source_rank") == 0)
    pages = view(spark, d, "web_pages").select(
        R.host_of(F.col("url")).alias("host"), F.col("url").alias("final_url"), "html",
        F.lit("text/html").alias("content_type"), F.startswith("url", F.lit("https:")).alias("https"), "_ord")
    return R.resolve(asked, pages, view(spark, d, "blocklist_raw"), MARKERS).select(
        "provider", "website", "resolved_via", "confidence", "source")


@query("q_targets", """SELECT provider, website IS NULL AS todo_resolve, website IS NOT NULL AS todo_crawl FROM (SELECT provider, website FROM
  (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY _ord DESC) AS rn FROM facts_raw) WHERE rn = 1) WHERE website IS NOT NULL OR NOT (provider LIKE '%7 Inc')""", ("facts_raw",))
def targets(spark, d):
    last = O.first_per(view(spark, d, "facts_raw"), ["provider"], F.desc("_ord")).withColumn(
        "locked", F.endswith("provider", F.lit("7 Inc")))
    rows = [R.targets(last, s).select(
        "provider", F.lit(s == "resolve").alias("todo_resolve"), F.lit(s == "crawl").alias("todo_crawl"))
        for s in ("resolve", "crawl")]
    return rows[0].unionByName(rows[1])


@query("q_stage_targets", """WITH last AS (SELECT provider, website FROM
    (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY _ord DESC) AS rn FROM facts_raw) WHERE rn = 1),
  p AS (SELECT lower(split_part(url, '/', 3)) AS host, count(*) AS n FROM pages GROUP BY 1),
  i AS (SELECT provider, count(*) AS n FROM photos_raw GROUP BY 1),
  s AS (SELECT last.provider, website, coalesce(ends_with(last.provider, '7 Inc'), false) AS locked, p.n AS n_pages, i.n AS n_images FROM last
    LEFT JOIN p ON p.host = regexp_extract(website, '//([^/]+)', 1) LEFT JOIN i ON i.provider = last.provider)
  SELECT 'resolve' AS stage, provider FROM s WHERE website IS NULL AND NOT locked UNION ALL
  SELECT 'crawl', provider FROM s WHERE website IS NOT NULL UNION ALL
  SELECT 'extract', provider FROM s WHERE n_pages > 0 UNION ALL
  SELECT 'images', provider FROM s WHERE n_images > 0""", ("facts_raw", "photos_raw"))
def stage_targets(spark, d):
    """What each of the four stages still has to work on."""
    last = O.first_per(view(spark, d, "facts_raw"), ["provider"], F.desc("_ord")).select(
        "provider", "website", F.endswith("provider", F.lit("7 Inc")).alias("locked"),
        F.regexp_extract("website", "//([^/]+)", 1).alias("host"))
    pages = view(spark, d, "web_pages").groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    images = view(spark, d, "photos_raw").groupBy("provider").agg(F.count(F.lit(1)).alias("n_images"))
    state = last.join(pages, "host", "left").join(images, "provider", "left")
    rows = [R.targets(state, s).select(F.lit(s).alias("stage"), "provider") for s in ("resolve", "crawl", "extract", "images")]
    return reduce(DataFrame.unionByName, rows)
