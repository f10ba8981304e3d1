"""Input views over the given tables.

The tables hold no coordinates, images or programs, so these views derive them
by plain arithmetic.  Each text is SQL that Spark and DuckDB read alike:
``{name}`` stands for a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _lat(k: str, a: int) -> str:
    return f"40.60 + (({k}*{k}*31 + {k}*7919 + {a}) % 10007) / CAST(10007 AS DOUBLE) * 0.05"


def _lng(k: str, b: int) -> str:
    return f"-74.00 + (({k}*{k}*57 + {k}*104729 + {b}) % 10009) / CAST(10009 AS DOUBLE) * 0.06"


def _pick(k: str, values: list[str | None]) -> str:
    whens = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"CASE {k} % {len(values)} {whens} END"


VIEWS: dict[str, str] = {}

VIEWS["sites_raw"] = f"""
SELECT k AS _ord,
  CASE WHEN k % 3 > 0 AND site_no % 97 < 90 THEN '2026' ELSE '2025' END AS date,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Grades K - 5' WHEN 'AUTOMOBILE' THEN 'Grades K - 12'
    WHEN 'MACHINERY' THEN 'Ages 4+' WHEN 'HOUSEHOLD' THEN 'Ages 5 - 20'
    ELSE 'Grades 6 - 8' END AS age_range,
  CASE WHEN k % 101 = 0 THEN ' '
    WHEN k % 10 = 3 THEN ' Org ' || CAST(k % 40 AS STRING) || ' Inc '
    ELSE 'Org ' || CAST(k % 40 AS STRING) || ' Inc' END AS provider,
  'Site ' || CAST(site_no AS STRING) AS program_site_name,
  {_pick("k", ["Compass", "Beacon", "Cornerstone", "Explore"])} AS program_area,
  {_pick("k", ["COMPASS Elementary", "Beacon", "Cornerstone", "Explore",
               "COMPASS SONYC Pilot", "Beacon", "Cornerstone", "Explore"])} AS program_type,
  CAST(site_no % 50 AS STRING) || ' Main St' AS street_address,
  'New York' AS city,
  CASE WHEN k % 83 = 0 THEN NULL ELSE
    {_pick("k", ["Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island"])} END AS borough,
  CASE WHEN k % 97 = 50 THEN NULL ELSE CAST(10000 + site_no % 97 AS STRING) END AS zipcode,
  CASE WHEN k % 13 = 0 THEN 'NULL' ELSE 'N' || CAST(k % 30 AS STRING) END AS nta,
  CASE WHEN k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN 'NULL'
    ELSE CAST({_lat("k", 17)} AS STRING) END AS latitude,
  CASE WHEN k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN 'NULL'
    ELSE CAST({_lng("k", 31)} AS STRING) END AS longitude,
  CASE WHEN k % 17 = 0 THEN '' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) END AS totalslots,
  CASE WHEN k % 7 = 0 THEN 'n/a' ELSE CAST(k % 90 AS STRING) END AS totalparticipants,
  CASE WHEN k % 11 = 0 THEN 'NULL' WHEN k % 29 = 0 THEN NULL
    ELSE 'C' || CAST(k AS STRING) END AS contract
FROM (SELECT c_custkey AS k,
        CASE WHEN c_custkey % 20 = 0 THEN c_custkey + 1 ELSE c_custkey END AS site_no,
        c_acctbal, c_mktsegment FROM {{customer}}) base
"""

VIEWS["schools_raw"] = f"""
SELECT p_partkey AS _ord, 'D' || CAST(p_partkey AS STRING) AS system_code,
  p_name AS location_name,
  CASE WHEN p_partkey % 2 = 1 THEN NULL ELSE {_pick("p_size", ["0K,01,02,03,04,05", "06,07,08", "09,10,11,12", "PK,0K,01"])} END AS grades_final_text,
  {_pick("p_size", ["0K,01,02,03,04,05", "06,07,08", "09,10,11,12", "PK,0K,01"])} AS grades_text,
  p_type AS location_category_description,
  CAST(p_partkey AS STRING) || ' School Rd' AS primary_address_line_1,
  CAST(p_size AS STRING) AS geographical_district_code,
  p_brand AS principal_name, '555' AS principal_phone_number,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST({_lat("p_partkey", 5003)} AS STRING) END AS latitude,
  CASE WHEN p_partkey % 43 = 0 THEN '' ELSE CAST({_lng("p_partkey", 2711)} AS STRING) END AS longitude
FROM {{part}}
"""

VIEWS["nta_names"] = """
SELECT 'N' || CAST(n_nationkey AS STRING) AS nta_code, n_name AS nta_name, r_name AS borough
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

VIEWS["facts_raw"] = f"""
SELECT s_suppkey AS _ord, 'Org ' || CAST(s_suppkey % 40 AS STRING) || ' Inc' AS provider,
  CASE WHEN s_suppkey % 5 > 0 THEN 'https://www.org' || CAST(s_suppkey % 40 AS STRING) || '.example.org/' END AS website,
  {_pick("s_suppkey", ["strong", "acronym", "strong"])} AS confidence,
  {_pick("s_suppkey", ["known", "generated", "known", "generated"])} AS source,
  CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'About ' || s_name END AS summary,
  {_pick("s_suppkey", ["robotics,coding", "chess", "", "lego,3d printing", "cooking", "gardening"])} AS tools_text,
  {_pick("s_suppkey", ["biology,chess", "music", "", "robotics,mathematics", "sports & fitness"])} AS subjects_text,
  {_pick("s_suppkey", ["reading aloud,snacks", ""])} AS activities_text,
  CASE WHEN s_suppkey % 9 = 0 THEN 'Weekday evenings 5-8' ELSE '' END AS hours_text,
  CASE WHEN s_suppkey % 4 = 1 THEN 'hi@org' || CAST(s_suppkey AS STRING) || '.example.org' ELSE '' END AS contact_email,
  CASE WHEN s_suppkey % 4 = 2 THEN '212-555-0100' ELSE '' END AS contact_phone,
  {_pick("s_suppkey", ["we build robots", "", "chess on fridays"])} AS evidence_text,
  {_pick("s_suppkey", ["free", "sliding-scale", "paid", "unknown"])} AS cost_tier,
  CASE WHEN s_suppkey % 3 = 0 THEN 'keyword' ELSE 'gemini' END AS method,
  {_pick("s_suppkey", ["high", "medium", "low"])} AS fact_confidence
FROM {{supplier}}
"""

VIEWS["photos_raw"] = f"""
SELECT p_partkey AS _ord, 'Org ' || CAST(p_partkey % 45 AS STRING) || ' Inc' AS provider,
  'https://www.org' || CAST(p_partkey % 45 AS STRING) || '.example.org/img/p' || CAST(p_partkey % 1700 AS STRING) || {_pick("p_partkey", [".jpg", ".jpg?w=800", ".png"])} AS url,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'https://www.org' || CAST(p_partkey % 45 AS STRING) || '.example.org/gallery' END AS page,
  {_pick("p_partkey", ["Kids at work", "og:image", "", "Board gala", "Students painting"])} AS alt,
  CAST(300 + p_partkey*37 % 4200 AS BIGINT) AS width, CAST(200 + p_partkey*53 % 3800 AS BIGINT) AS height,
  p_partkey % 4 > 0 AS judged,
  CASE WHEN p_partkey % 4 > 0 THEN {_pick("p_partkey", ["program-photo", "flyer", "program-photo"])} END AS kind,
  CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 11 AS BIGINT) END AS suitability,
  (200 + p_partkey*53 % 3800 >= 600) AS carousel_ready
FROM {{part}}
"""

VIEWS["zip_requests"] = """
SELECT c_custkey AS request_id,
  CASE WHEN c_custkey % 31 = 7 THEN 'abc' WHEN c_custkey % 31 = 8 THEN '1000'
    WHEN c_custkey % 31 = 9 THEN ' ' || CAST(10000 + c_custkey % 120 AS STRING) || ' '
    ELSE CAST(10000 + c_custkey % 120 AS STRING) END AS zip
FROM {customer}
"""

VIEWS["web_pages"] = """
SELECT page_id AS _ord, page_id, url, html, lower(split_part(url, '/', 3)) AS host FROM {pages}
"""

VIEWS["page_images"] = """
SELECT page_id AS _ord, url, lower(split_part(url, '/', 3)) AS provider, html
  || '<img class="x" src="/img/a' || CAST(page_id AS STRING) || '.jpg" alt="Kids  at   work ' || CAST(page_id AS STRING) || ' ">'
  || '<IMG data-src="https://cdn.example.org/b' || CAST(page_id % 50 AS STRING) || '.png">'
  || '<img srcset="c' || CAST(page_id AS STRING) || '.webp 1x, d.webp 2x" alt="x">'
  || '<img src="/static/logo.png"><img src="/e.svg?x=1"><img src="data:image/png;base64,xx"><img alt="none">'
  || '<meta property="og:image" content="/og' || CAST(page_id % 7 AS STRING) || '.jpg#top">' AS html
FROM {pages}
"""

VIEWS["robots"] = f"""
SELECT DISTINCT host, {_pick("length(host)", ["/", "/en", "/fr", None])} AS rule
FROM (SELECT lower(split_part(url, '/', 3)) AS host FROM {{pages}}) hosts WHERE length(host) % 4 < 3
"""

VIEWS["blocklist_raw"] = """
SELECT DISTINCT host AS provider, substr(host, strpos(host, '.') + 1) AS domain, 'hand' AS why
FROM (SELECT lower(split_part(url, '/', 3)) AS host, page_id FROM {pages}) hosts
WHERE page_id % 7 = 0
""".replace("strpos(", "instr(")

VIEWS["claims"] = """
SELECT item_id * 4 + v AS claim_id, item_id, 'item_' || CAST(item_id AS STRING) AS label, v,
  CASE v WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'E') WHEN 2 THEN replace(text, ' ', '  ')
    ELSE replace(text, ' the ', ' THE other ') END AS quote
FROM {benchmark} JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) variants ON 1 = 1
""".replace("JOIN (", "CROSS JOIN (").replace(" ON 1 = 1", "")

VIEWS["image_rows"] = f"""
SELECT p_partkey AS _ord, p_brand AS provider,
  CAST(300 + p_partkey*37 % 4200 AS BIGINT) AS width, CAST(200 + p_partkey*53 % 3800 AS BIGINT) AS height,
  p_partkey*7919 % 9000000 AS bytes, CAST(p_partkey % 1500 AS STRING) AS digest,
  {_pick("p_partkey", ["image/jpeg", "image/png", "image/webp", "image/jpeg", "image/gif", "image/png", "image/jpeg", "image/jpeg", "image/webp"])} AS mime,
  'https://www.org.example.org/' || CASE WHEN p_partkey % 5 = 1 THEN 'styles/wide/public/' ELSE '' END
    || 'img/p' || CAST(p_partkey % 1700 AS STRING) || CASE p_partkey % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpg.webp'
    WHEN 2 THEN '-800x500.jpg' WHEN 3 THEN '-scaled.jpg' ELSE '.jpg?w=800' END AS url,
  p_partkey % 4 > 0 AS judged,
  CASE WHEN p_partkey % 4 > 0 THEN {_pick("p_partkey", ["program-photo", "flyer", "text-only", "logo", "stock", "other", None])} END AS kind,
  CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 11 AS BIGINT) END AS suitability
FROM {{part}}
"""

VIEWS["media_raw"] = f"""
SELECT o_orderkey AS _ord, o_custkey % 14 AS subject_no,
  {_pick("o_custkey", ["robotics", "coding", "chess", "engineering", "science", "gardening", "math",
                       "cooking", "art", "music", "dance", "reading", "sports", "default"])} AS subject,
  o_orderkey % 5 AS query_no, o_orderkey % 997 AS result_rank,
  'Photo ' || CAST(o_orderkey * 7 % 5000 AS STRING) || {_pick("o_orderkey", ["", " painting", " Children at school", "", " US_Navy day", "", " 1931 class"])} || '.jpg' AS title,
  {_pick("o_orderkey", ["CC BY 4.0", "CC BY-SA 3.0", "CC0", "All rights reserved", "Public domain"])} AS license,
  {_pick("o_custkey", ["Ann", "Bo", "Sgt Cy"])} AS artist,
  'https://media.example.org/File:' || {_pick("o_orderkey", ["kids", "a%20day", "the%20army"])} || CAST(o_orderkey % 9000 AS STRING) AS source,
  CAST(900 + o_custkey % 900 AS BIGINT) AS width, CAST(600 + o_orderkey % 500 AS BIGINT) AS height
FROM {{orders}}
"""

VIEWS["questions"] = """
SELECT k * 2 AS qid, CASE k % 10
    WHEN 0 THEN 'Free robotics in Brooklyn'
    WHEN 1 THEN 'Chess near ' || CAST(10000 + k % 120 AS STRING)
    WHEN 2 THEN 'programs for a 7 year old after 5pm'
    WHEN 3 THEN 'hello!'
    WHEN 4 THEN 'Tell me about Site ' || CAST(k AS STRING) || ' today'
    WHEN 5 THEN 'What''s good for kids on weekends around nation_' || CAST(k % 25 AS STRING)
    WHEN 6 THEN 'coding or cooking in ' || CAST(10000 + k % 110 AS STRING)
    WHEN 7 THEN 'How do I sign up?'
    WHEN 8 THEN 'paid evening dance in bk before 7:30pm'
    ELSE 'is it safe for my child' END AS question
FROM (SELECT c_custkey AS k FROM {customer}) c
UNION ALL
SELECT (conv_id * 100 + turn) * 2 + 1 AS qid, text AS question FROM {conversations} WHERE role = 'user'
"""

VIEWS["requests"] = """
SELECT event_id, user_id % 10 AS client, event_id * 7 % 3600 AS at_s FROM {events}
"""

VIEWS["replies"] = """
SELECT event_id, CASE event_id % 6
  WHEN 0 THEN '{"steps":[{"type":"model_output","content":[{"type":"text","text":"first"}]},{"type":"thought"},{"type":"model_output","content":[{"type":"image"},{"type":"text","text":"' || body || '"}]}]}'
  WHEN 1 THEN '{"steps":[{"type":"thought","signature":"s"},{"type":"model_output","content":[{"type":"text","text":"[' || body || '"},{"type":"text","text":",1]"}]}]}'
  WHEN 2 THEN '{"interaction":{"output_text":"' || body || '"}}'
  WHEN 3 THEN '{"output_text":"Here you are: ' || body || ' as asked"}'
  WHEN 4 THEN '{"candidates":[{"content":{"parts":[{"text":"```json' || chr(92) || 'n' || body || chr(92) || 'n```"}]}}]}'
  ELSE CASE WHEN event_id % 12 = 5 THEN '{"unexpected":true}' ELSE '{"output_text":"I can not help with that."}' END
  END AS reply
FROM (SELECT event_id, replace(props, '"', chr(92) || '"') AS body FROM {events}) e
"""
# Braces of JSON are doubled wherever the text is formatted.
VIEWS["replies"] = re.sub(r"[{}]", lambda m: m.group() * 2, VIEWS["replies"]).replace("{{events}}", "{events}")

VIEWS["fetches"] = """
SELECT event_id, event_type, user_id, event_id % 10 < 4 AS ok,
  CASE event_id % 10 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 200 WHEN 3 THEN 204 WHEN 4 THEN 404
    WHEN 5 THEN 500 WHEN 6 THEN 429 WHEN 7 THEN 0 WHEN 8 THEN NULL ELSE 408 END AS status,
  CASE WHEN event_id % 20 = 7 THEN 'robots' WHEN event_id % 20 = 8 THEN 'bad url'
    WHEN event_id % 20 = 17 THEN 'fetch failed' END AS error
FROM {events}
"""


def _names(text: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view as a DataFrame."""
    if name in BASE:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in _names(text)}
    return spark.sql(text, **inputs)


def with_views(sql: str, *names: str) -> str:
    """Oracle text: the named views as common table expressions, then ``sql``."""
    parts = []
    for n in names:
        text = VIEWS[n]
        parts.append(f"{n} AS ({text.format(**{b: b for b in _names(text)})})")
    joined = ",\n".join(parts)
    body = sql.strip()
    if body[:15].lower() == "with recursive ":
        return f"WITH RECURSIVE {joined},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"WITH {joined},\n{body[5:]}"
    return f"WITH {joined}\n{body}"
