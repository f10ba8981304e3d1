"""Queries over candidate images, photo choice and the media pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.text import subject_key
from gazetteer.operators import assign as A
from gazetteer.operators import dataset as D
from gazetteer.operators import images as M
from gazetteer.operators import order as O
from gazetteer.plans import inputs as I
from gazetteer.plans.registry import query
from gazetteer.plans.views import view
from gazetteer.sources.images import image_inventory

SQL_SCREEN = """screened AS (SELECT *, CASE WHEN reason IS NULL THEN round(width / height, 3) END AS aspect,
  CASE WHEN reason IS NULL THEN CASE WHEN width / height >= 1.2 THEN 'landscape' WHEN width / height <= 0.83 THEN 'portrait' ELSE 'square' END END AS orientation,
  CASE WHEN reason IS NULL THEN height >= 600 AND width / height >= 1.0 END AS carousel_ready FROM (SELECT *,
  CASE WHEN mime NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'mime' WHEN width < 400 OR height < 300 THEN 'too-small'
    WHEN greatest(width, height) > 4000 THEN 'too-large' WHEN width * height > 12000000 THEN 'too-many-pixels'
    WHEN bytes > 8000000 THEN 'too-heavy' WHEN width / height > 4 OR width / height < 0.25 THEN 'aspect' END AS reason FROM image_rows))"""
SQL_KEPT = """kept AS (SELECT *, carousel_ready AND (NOT judged OR coalesce(kind = 'program-photo', false)) AS ready FROM screened
  WHERE reason IS NULL AND (NOT judged OR coalesce(kind IN ('program-photo', 'flyer'), false)))"""


def _screened(spark, d):
    return M.screen_images(view(spark, d, "image_rows"))


def _kept(spark, d):
    return M.split_by_reason(M.judge(M.split_by_reason(_screened(spark, d))[0]))[0]


@query("q_screen_images", f"WITH {SQL_SCREEN} SELECT _ord, reason, aspect, orientation, carousel_ready FROM screened", ("image_rows",))
def screen_images(spark, d):
    return _screened(spark, d).select("_ord", "reason", "aspect", "orientation", "carousel_ready")


@query("q_partition_ledger", f"WITH {SQL_SCREEN} SELECT _ord, CASE WHEN reason IS NULL THEN 'kept' ELSE 'ledger' END AS side, reason FROM screened", ("image_rows",))
def partition_ledger(spark, d):
    kept, ledger = M.split_by_reason(_screened(spark, d))
    none = F.lit(None).cast("string").alias("reason")
    return kept.select("_ord", F.lit("kept").alias("side"), none).unionByName(
        ledger.select("_ord", F.lit("ledger").alias("side"), "reason"))


@query("q_reject_reason", """SELECT _ord, CASE WHEN judged AND coalesce(kind, '') NOT IN ('program-photo', 'flyer') THEN coalesce(kind, 'unclassified') END AS reason
  FROM image_rows""", ("image_rows",))
def reject_reason(spark, d):
    return view(spark, d, "image_rows").select(
        "_ord", M.reject_reason(F.col("judged"), F.col("kind")).alias("reason"))


@query("q_rank_photos", f"""WITH {SQL_SCREEN}, {SQL_KEPT} SELECT provider, _ord, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY provider
  ORDER BY CASE WHEN kind = 'flyer' THEN 1 ELSE 0 END, CASE WHEN ready THEN 0 ELSE 1 END, -coalesce(suitability, 0), -(width * height), _ord) AS rn FROM kept) WHERE rn <= 12""", ("image_rows",))
def rank_photos(spark, d):
    return O.top_per(_kept(spark, d), ["provider"], D.photo_rank(), vocab.IMAGES_PER_PROVIDER).select(
        "provider", "_ord", F.col("_rn").cast("bigint").alias("place"))


@query("q_nested_rollup", f"""WITH {SQL_SCREEN}, {SQL_KEPT}, l AS (SELECT provider, count(*) AS n_rejected FROM screened WHERE _ord NOT IN (SELECT _ord FROM kept) GROUP BY 1),
  k AS (SELECT provider, string_agg(url, ' ' ORDER BY rn) AS photos FROM (SELECT *, row_number() OVER (PARTITION BY provider
  ORDER BY CASE WHEN kind = 'flyer' THEN 1 ELSE 0 END, CASE WHEN ready THEN 0 ELSE 1 END, -coalesce(suitability, 0), -(width * height), _ord) AS rn FROM kept) WHERE rn <= 12 GROUP BY 1)
  SELECT k.provider, photos, coalesce(n_rejected, 0) AS n_rejected FROM k LEFT JOIN l ON l.provider = k.provider""", ("image_rows",))
def nested_rollup(spark, d):
    kept, all_rows = _kept(spark, d), view(spark, d, "image_rows")
    nested = D.nested_photos(kept.withColumns({"page": F.lit(""), "alt": F.lit("")}))
    rejected = O.difference(all_rows, kept, ["_ord"]).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    return nested.join(rejected, "provider", "left").select(
        "provider", F.array_join(F.col("photos.url"), " ").alias("photos"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n_rejected"))


@query("q_reject_funnel", f"""WITH {SQL_SCREEN} SELECT reason, count(*) AS n, CAST(list_position([{I.sql_list(vocab.REJECT_FUNNEL)}], reason) - 1 AS BIGINT) AS place
  FROM screened WHERE reason IS NOT NULL GROUP BY 1""", ("image_rows",))
def reject_funnel(spark, d):
    return M.reject_funnel(M.split_by_reason(_screened(spark, d))[1])


_KEYSQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, 'https?://(?:www\\.)?([^?#]*)', 1)),
  '/styles/[^/]+/(public|private)/', '/'), '\\.(jpe?g|png)\\.webp$', '.\\1'), '-\\d{2,5}x\\d{2,5}(\\.[a-z0-9]+)$', '\\1'), '-(scaled|rotated)(\\.[a-z0-9]+)$', '\\2')"""


@query("q_drop_copies", f"""WITH RECURSIVE {SQL_SCREEN}, o AS (SELECT provider, url, _ord, digest, {_KEYSQL} AS key,
    row_number() OVER (PARTITION BY provider ORDER BY -(width * height), _ord) AS rn FROM screened WHERE reason IS NULL),
  f AS (SELECT provider, 0::BIGINT AS rn, 0::BIGINT AS _ord, NULL::VARCHAR AS reason, NULL::VARCHAR AS duplicate_of,
      []::VARCHAR[] AS db, []::VARCHAR[] AS du, []::VARCHAR[] AS kb, []::VARCHAR[] AS ku FROM (SELECT DISTINCT provider FROM o)
    UNION ALL SELECT o.provider, o.rn, o._ord,
      CASE WHEN list_contains(db, digest) THEN 'duplicate-file' WHEN list_contains(kb, key) THEN 'resized-copy' END,
      CASE WHEN list_contains(db, digest) THEN du[list_position(db, digest)] WHEN list_contains(kb, key) THEN ku[list_position(kb, key)] END,
      CASE WHEN list_contains(db, digest) OR list_contains(kb, key) THEN db ELSE list_append(db, digest) END,
      CASE WHEN list_contains(db, digest) OR list_contains(kb, key) THEN du ELSE list_append(du, url) END,
      CASE WHEN list_contains(db, digest) OR list_contains(kb, key) THEN kb ELSE list_append(kb, key) END,
      CASE WHEN list_contains(db, digest) OR list_contains(kb, key) THEN ku ELSE list_append(ku, url) END
    FROM f JOIN o ON o.provider = f.provider AND o.rn = f.rn + 1)
  SELECT _ord, reason, duplicate_of FROM f WHERE rn > 0""", ("image_rows",))
def drop_copies(spark, d):
    kept = M.split_by_reason(_screened(spark, d))[0]
    return M.drop_copies(kept, F.col("digest")).select("_ord", "reason", "duplicate_of")


@query("q_collapse_groups")
def collapse_groups(spark, d):
    """Groups claimed by a rule: photos of one organisation with the same suitability."""
    best = O.top_per(_kept(spark, d).where("judged"), ["provider"], D.photo_rank(), vocab.IMAGES_PER_PROVIDER)
    rows = best.groupBy("provider").agg(F.array_sort(F.collect_list(F.struct(
        "_rn", "url", "kind", "carousel_ready", "suitability", "width", "height"))).alias("images"))
    at = F.transform("images", lambda im: F.struct(im["suitability"].alias("s"), im["_rn"].cast("double").alias("n")))
    groups = F.transform(
        F.array_distinct(F.transform(at, lambda x: x["s"])),
        lambda s: F.transform(F.filter(at, lambda x: x["s"] == s), lambda x: x["n"]))
    return M.collapse_groups(rows.withColumn("groups", groups)).select("provider", "url", "duplicate_of", "reason")


_RX = {n: getattr(vocab, n).replace("'", "''") for n in ("ADULT_OR_FUNDRAISING", "GRAPHIC", "ABOUT_KIDS", "OK_LICENSE", "NOT_A_PHOTO", "MILITARY")}
SQL_SCORE = f"""scored AS (SELECT *, CASE WHEN judged THEN CASE WHEN kind = 'program-photo' THEN 0 END
    WHEN regexp_matches(text, '(?i){_RX['ADULT_OR_FUNDRAISING']}') OR regexp_matches(file, '(?i){_RX['GRAPHIC']}') OR regexp_matches(alt, '(?i){_RX['GRAPHIC']}') THEN NULL
    WHEN regexp_matches(text, '(?i){_RX['ABOUT_KIDS']}') THEN 1
    WHEN (file LIKE '%.jpg' OR (file LIKE '%.png' AND width >= 900)) AND width / height BETWEEN 0.75 AND 2.6 THEN 2 END AS score
  FROM (SELECT *, regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/]*$') AS file,
    regexp_replace(CASE WHEN alt = 'og:image' THEN '' ELSE alt END || ' ' || regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/]*$') || ' ' || regexp_replace(page, '^https?://[^/]+', ''), '[_\\-./]+', ' ', 'g') AS text
    FROM photos_raw))"""


@query("q_score_photos", f"WITH {SQL_SCORE} SELECT _ord, score FROM scored", ("photos_raw",))
def score_photos(spark, d):
    return M.score_photos(view(spark, d, "photos_raw").withColumn("caption", F.col("alt"))).select("_ord", "score")


@query("q_denylist", """SELECT _ord FROM photos_raw WHERE regexp_extract(url, '^[^?#]*') NOT IN (SELECT regexp_extract(url, '^[^?#]*') FROM photos_raw WHERE _ord % 37 = 0)""", ("photos_raw",))
def denylist(spark, d):
    photos = view(spark, d, "photos_raw")
    return M.drop_denied(photos, photos.where("_ord % 37 = 0").select("url")).select("_ord")


@query("q_diff", f"""WITH {SQL_SCREEN} SELECT provider, url, 'unrecorded' AS reason FROM (SELECT DISTINCT provider, url FROM image_rows)
  WHERE (provider, url) NOT IN (SELECT (provider, url) FROM screened WHERE reason IS NULL)""", ("image_rows",))
def diff(spark, d):
    found = view(spark, d, "image_rows").select("provider", "url").distinct()
    return O.difference(found, M.split_by_reason(_screened(spark, d))[0], ["provider", "url"]).withColumn(
        "reason", F.lit("unrecorded"))


_CREDIT = "coalesce(artist, 'Wikimedia Commons') || ' · ' || license"
SQL_MEDIA = f"""media AS (SELECT *, {_CREDIT} AS credit FROM media_raw WHERE regexp_matches(license, '(?i){_RX['OK_LICENSE']}') AND width >= 1000
  AND width / height BETWEEN 1.2 AND 2.2 AND NOT regexp_matches(title, '(?i){_RX['NOT_A_PHOTO']}')
  AND NOT regexp_matches(title || ' ' || {_CREDIT} || ' ' || url_decode(source), '(?i){_RX['MILITARY']}'))"""


def _media(spark, d):
    return M.filter_media(view(spark, d, "media_raw").withColumn(
        "credit", M.media_credit(F.col("artist"), F.col("license"))))


@query("q_media_filter", f"WITH {SQL_MEDIA} SELECT _ord, title, credit FROM media", ("media_raw",))
def media_filter(spark, d):
    return _media(spark, d).select("_ord", "title", "credit")


_TARGETS = " ".join(f"WHEN '{s}' THEN {t}" for s, t in vocab.MEDIA_TARGETS.items())


SQL_INTERLEAVED = f"""have AS (SELECT subject, title, _ord AS id FROM media_raw WHERE _ord % 9973 = 5),
  fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY subject_no, result_rank, query_no, _ord) AS t FROM media
    WHERE title NOT IN (SELECT title FROM have)) WHERE t = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY result_rank, query_no, _ord) AS rn FROM fresh),
  interleaved AS (SELECT (SELECT max(id) FROM have) + row_number() OVER (ORDER BY subject_no, rn) AS id, r.subject, title, source FROM ranked r
    LEFT JOIN (SELECT subject, count(*) AS n FROM have GROUP BY 1) h ON h.subject = r.subject WHERE rn <= CASE r.subject {_TARGETS} END - coalesce(n, 0))"""


@query("q_interleave", f"WITH {SQL_MEDIA}, {SQL_INTERLEAVED} SELECT id, subject, title, source FROM interleaved", ("media_raw",))
def interleave(spark, d):
    existing = view(spark, d, "media_raw").where("_ord % 9973 = 5").select("subject", "title", F.col("_ord").alias("id"))
    return A.interleave(_media(spark, d), existing, vocab.MEDIA_TARGETS)


_SUBJ = " ".join(
    f"WHEN list_has_any(list_transform(subjects, lambda s: lower(s)), [{I.sql_list(v)}]) THEN '{k}'"
    for k, v in vocab.SUBJECT_KEYS.items())


@query("q_subject_key", f"""WITH {I.SQL_PROGRAMS}, {I.SQL_CARDS} SELECT id, CASE {_SUBJ} ELSE 'default' END AS key FROM cards""", I.PROGRAM_VIEWS)
def subject_keys(spark, d):
    return I.cards(spark, d).select("id", subject_key(F.col("subjects")).alias("key"))


# Programs as the picture rules see them: one subject each, some with a photo.
SQL_ROWS = f"""rows AS (SELECT c._ord, c.id, CASE {_SUBJ} ELSE 'default' END AS subject FROM core c JOIN (SELECT provider, subjects FROM facts) f ON f.provider = c.provider)"""


def _rows(spark, d):
    core = D.core_programs(view(spark, d, "sites_raw"))
    facts = D.last_per_provider(I.facts(spark, d)).select("provider", subject_key(F.col("subjects")).alias("subject"))
    return core.join(facts, "provider").select("_ord", "id", "subject")


_POOL = "pool AS (SELECT subject, source, _ord FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY _ord) AS rn FROM media) WHERE rn = 1)"


@query("q_assign_unique", f"""WITH {I.SQL_CORE}, {I.SQL_FACTS}, {SQL_ROWS}, {SQL_MEDIA}, {_POOL},
  a AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY _ord) AS j FROM rows), b AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY _ord) AS j FROM pool),
  own AS (SELECT a.id, b.source FROM a JOIN b ON a.subject = b.subject AND a.j = b.j),
  w AS (SELECT id, row_number() OVER (ORDER BY _ord) AS j FROM rows WHERE id NOT IN (SELECT id FROM own)),
  s AS (SELECT source, row_number() OVER (ORDER BY _ord) AS j FROM pool WHERE source NOT IN (SELECT source FROM own))
  SELECT id, source FROM own UNION ALL SELECT w.id, s.source FROM w JOIN s ON w.j = s.j""", ("sites_raw", "facts_raw", "media_raw"))
def assign_unique(spark, d):
    return A.pool_photos(_rows(spark, d), _media(spark, d).select("subject", "source", "_ord"))


# One by one: each program takes the first photo of its organisation that nobody has taken.
SQL_OWN = """progs AS (SELECT id, provider, _ord, row_number() OVER (ORDER BY _ord) AS n FROM core),
  listed AS (SELECT provider, url, _ord FROM photos_raw UNION ALL SELECT 'Org ' || (_ord % 40) || ' Inc', url, _ord FROM photos_raw WHERE _ord % 9 = 0),
  lists AS (SELECT provider, list(url ORDER BY _ord)[1:12] AS urls FROM (SELECT provider, url, min(_ord) AS _ord FROM listed GROUP BY 1, 2) GROUP BY 1),
  own_walk AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS id, NULL::VARCHAR AS photo, []::VARCHAR[] AS used UNION ALL
    SELECT n, id, photo, CASE WHEN photo IS NULL THEN used ELSE list_append(used, photo) END FROM (SELECT p.n, p.id, w.used,
      list_filter(coalesce(l.urls, []), lambda u: NOT list_contains(w.used, u))[1] AS photo FROM own_walk w JOIN progs p ON p.n = w.n + 1 LEFT JOIN lists l ON l.provider = p.provider))"""


def _listed(spark, d):
    """Photos by organisation; every ninth picture is listed by two."""
    photos = view(spark, d, "photos_raw")
    listed = photos.select("provider", "url", "_ord").unionByName(
        photos.where("_ord % 9 = 0").select(
            F.concat(F.lit("Org "), (F.col("_ord") % 40).cast("string"), F.lit(" Inc")).alias("provider"), "url", "_ord"))
    ranked = O.top_per(
        O.first_per(listed, ["provider", "url"], F.col("_ord")), ["provider"], [F.col("_ord")],
        vocab.IMAGES_PER_PROVIDER)
    return ranked.select("provider", F.col("url").alias("photo"), F.col("_rn").alias("pos"))


@query("q_assign_own", f"WITH RECURSIVE {I.SQL_CORE}, {SQL_OWN} SELECT id, photo FROM own_walk WHERE photo IS NOT NULL", ("sites_raw", "photos_raw"))
def assign_own(spark, d):
    core = D.core_programs(view(spark, d, "sites_raw")).select("id", "provider", "_ord")
    return A.own_photos(core, _listed(spark, d))


@query("q_assign_photos", f"""WITH RECURSIVE {I.SQL_CORE}, {I.SQL_FACTS}, {SQL_OWN}, {SQL_MEDIA}, {SQL_INTERLEAVED},
  stock AS (SELECT subject, max_by(source, _ord) AS source FROM media GROUP BY 1),
  pool AS (SELECT subject, source, min(id) AS first_id FROM interleaved WHERE source NOT IN (SELECT source FROM stock) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY min(id)) = 1),
  piles AS (SELECT row_number() OVER (ORDER BY min(first_id)) AS b, subject, list(source ORDER BY first_id) AS sources FROM pool GROUP BY 2),
  sizes AS (SELECT list(len(sources) ORDER BY b) AS size FROM piles),
  waiting AS (SELECT *, row_number() OVER (ORDER BY _ord) AS m FROM (SELECT c.id, c._ord, CASE WHEN f.provider IS NULL THEN 'default' ELSE CASE {_SUBJ} ELSE 'default' END END AS subject
    FROM core c LEFT JOIN (SELECT provider, subjects FROM facts) f ON f.provider = c.provider WHERE c.id NOT IN (SELECT id FROM own_walk WHERE photo IS NOT NULL))),
  pool_walk AS (SELECT 0::BIGINT AS m, NULL::VARCHAR AS id, NULL::BIGINT AS b, NULL::BIGINT AS turn, list_transform(size, lambda x: 0::BIGINT) AS taken FROM sizes UNION ALL
    SELECT m, id, b, taken[b] + 1, list_transform(taken, lambda x, i: CASE WHEN i = b THEN x + 1 ELSE x END) FROM (SELECT q.m, q.id, w.taken,
      CASE WHEN w.taken[p.b] < s.size[p.b] THEN p.b ELSE list_filter(range(1, len(s.size) + 1), lambda i: w.taken[i] < s.size[i])[1] END AS b
      FROM pool_walk w JOIN waiting q ON q.m = w.m + 1 CROSS JOIN sizes s LEFT JOIN piles p ON p.subject = q.subject)),
  pooled AS (SELECT w.id, p.sources[w.turn] AS picture FROM pool_walk w JOIN piles p ON p.b = w.b),
  stocked AS (SELECT q.id, s.source AS picture FROM waiting q JOIN stock s ON s.subject = q.subject WHERE q.id NOT IN (SELECT id FROM pooled) QUALIFY row_number() OVER (PARTITION BY s.source ORDER BY q._ord) = 1),
  served AS (SELECT id, 'own' AS way, photo AS picture FROM own_walk WHERE photo IS NOT NULL UNION ALL SELECT id, 'pool', picture FROM pooled UNION ALL SELECT id, 'local', picture FROM stocked)
  SELECT c.id, coalesce(way, 'none') AS way, picture FROM core c LEFT JOIN served s ON s.id = c.id""", ("sites_raw", "facts_raw", "photos_raw", "media_raw"))
def assign_photos(spark, d):
    """Own photo, pool photo of the subject or of any, stock photo, none: one walk over all programs."""
    core = D.core_programs(view(spark, d, "sites_raw")).select("id", "provider", "_ord")
    facts = D.last_per_provider(I.facts(spark, d)).select("provider", subject_key(F.col("subjects")).alias("subject"))
    programs = core.join(facts, "provider", "left").withColumn("subject", F.coalesce("subject", F.lit("default")))
    pool = interleave(spark, d).select("subject", "source", F.col("id").alias("_ord"))
    stock = _media(spark, d).groupBy("subject").agg(F.max_by("source", "_ord").alias("source"))
    return A.assign_photos(programs, _listed(spark, d), pool, stock)


@query("q_fill_tiles", f"""WITH {I.SQL_CORE}, {I.SQL_FACTS}, {SQL_ROWS}, {SQL_MEDIA}, {_POOL},
  slots AS (SELECT subject, source AS src, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN _ord % 3 = 0 THEN 1 ELSE 0 END, _ord) AS slot, count(*) OVER (PARTITION BY subject) AS size FROM pool),
  r AS (SELECT *, sum(3 - _ord % 3) OVER (PARTITION BY subject ORDER BY _ord) AS through, 3 - _ord % 3 AS gap FROM rows),
  w AS (SELECT r.id, r._ord, r.gap, r._ord % 3 AS have, k, slots.src FROM (SELECT *, unnest(range(gap + 1)) AS k FROM r) r JOIN slots ON slots.subject = r.subject
    AND slots.slot = CAST((r.through - r.gap + r.k) % slots.size AS BIGINT) + 1 AND r.k < slots.size)
  SELECT id, tile + have AS tile, src FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS tile FROM w) WHERE tile <= gap""", ("sites_raw", "facts_raw", "media_raw"))
def fill_tiles(spark, d):
    rows = _rows(spark, d).withColumns({"have": F.col("_ord") % 3, "main": F.lit(None).cast("string")})
    pool = O.first_per(_media(spark, d), ["source"], F.col("_ord")).select(
        "subject", F.col("source").alias("src"), (F.col("_ord") % 3 == 0).alias("claimed"), "_ord")
    return A.fill_tiles(rows, pool)


@query("q_image_inventory", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 300 + p_partkey * 37 % 4200 END AS width,
  CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 200 + p_partkey * 53 % 3800 END AS height,
  CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' END AS mime FROM part""")
def inventory(spark, d):
    w, h = F.expr("300 + p_partkey * 37 % 4200"), F.expr("200 + p_partkey * 53 % 3800")

    def big(c, n):
        return F.lpad(F.hex(c), 2 * n, "0")

    def little(c, n):
        return F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * i) % 256), 2, "0") for i in range(n)])

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4))
    gif = F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("00" * 14))
    jpeg = F.concat(F.lit("FFD8FFE000104A464946" + "00" * 10 + "FFC0000808"), big(h, 2), big(w, 2), F.lit("00" * 16))
    webp = F.concat(F.lit("524946461800000057454250565038580A00000000000000"), little(w - 1, 3), little(h - 1, 3), F.lit("0000"))
    body = F.element_at(F.array(png, gif, jpeg, webp, F.lit("3C21444F43545950452068746D6C3E" + "20" * 20)),
                        (F.col("p_partkey") % 5 + 1).cast("int"))
    files = view(spark, d, "part").select("p_partkey", F.unhex(body).alias("content"))
    return image_inventory(files).select("p_partkey", "width", "height", "mime")
