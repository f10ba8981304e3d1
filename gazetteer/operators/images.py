"""Screening, ranking and copy removal of candidate images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.regex import has
from gazetteer.functions.web import canonical_image_key, plausible_image, url_key
from gazetteer.operators.dataset import orientation
from gazetteer.operators.order import cap_per_group
from gazetteer.session import cut_lineage


def screen_images(df: DataFrame) -> DataFrame:
    """First rule an image fails, else its shape; wants width, height, mime, bytes."""
    w, h = F.col("width"), F.col("height")
    aspect = w / F.greatest(h, F.lit(1))
    reason = (
        F.when(w.isNull() | h.isNull() | F.col("mime").isNull(), "unparseable")
        .when(~F.col("mime").isin("image/jpeg", "image/png", "image/webp"), "mime")
        .when((w < vocab.IMAGE_MIN_WIDTH) | (h < vocab.IMAGE_MIN_HEIGHT), "too-small")
        .when(F.greatest(w, h) > vocab.IMAGE_MAX_SIDE, "too-large")
        .when(w * h > vocab.IMAGE_MAX_PIXELS, "too-many-pixels")
        .when(F.col("bytes") > vocab.IMAGE_MAX_BYTES, "too-heavy")
        .when((aspect > 4) | (aspect < 0.25), "aspect")
    )
    ok = F.col("reason").isNull()
    return (
        df.withColumn("reason", reason)
        .withColumn("aspect", F.when(ok, F.round(aspect, 3)))
        .withColumn("orientation", F.when(ok, orientation(aspect)))
        .withColumn("carousel_ready", F.when(
            ok, (h >= vocab.CAROUSEL_MIN_HEIGHT) & (aspect >= vocab.CAROUSEL_MIN_ASPECT)))
    )


def split_by_reason(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows and the ledger of rejects; every row is in exactly one."""
    return df.where("reason IS NULL").drop("reason"), df.where("reason IS NOT NULL")


def reject_reason(judged: Column, kind: Column) -> Column:
    """Why a judged image is dropped; unjudged images are kept."""
    return F.when(
        F.coalesce(judged, F.lit(False)) & ~F.coalesce(kind.isin(vocab.KEPT_KINDS), F.lit(False)),
        F.coalesce(kind, F.lit("unclassified")),
    )


def judge(df: DataFrame) -> DataFrame:
    """Adds ``reason``; the carousel flag stays only on photographs."""
    photo = ~F.coalesce(F.col("judged"), F.lit(False)) | (F.col("kind") == "program-photo")
    return df.withColumn("reason", reject_reason(F.col("judged"), F.col("kind"))).withColumn(
        "carousel_ready", F.col("carousel_ready") & F.coalesce(photo, F.lit(False)))


def shortlist(df: DataFrame, k: int = vocab.IMAGE_SHORTLIST) -> DataFrame:
    """Names that are never photos go first; the first ``k`` of the rest stay."""
    named = df.withColumn("reason", F.when(~plausible_image(F.col("url")), "filename"))
    passed = cap_per_group(
        named.where("reason IS NULL").drop("reason"), ["provider"], [F.col("_ord")], k, "shortlist-full")
    return passed.unionByName(named.where("reason IS NOT NULL"))


def drop_copies(images: DataFrame, digest: Column, group: str = "provider") -> DataFrame:
    """Mark identical files and resized variants; the largest copy is kept.

    Going from the largest image down, an image is kept unless an image kept
    before it has the same bytes or the same canonical URL.  An image that is
    dropped registers nothing.

    That order is settled in rounds for all groups at once.  An open image that
    comes first among the open images of its bytes and of its URL is kept; open
    images sharing either with it leave.  A round is two small aggregates and
    two equi joins, so a group of any size is spread over the cluster.
    """
    marked = images.withColumns({
        "_digest": digest, "_key": canonical_image_key(F.col("url")),
        "_place": F.struct((-(F.col("width") * F.col("height"))).alias("size"), F.col("_ord").alias("ord")),
    })
    by_bytes, by_key = [group, "_digest"], [group, "_key"]
    undecided = cut_lineage(marked.select(group, "_digest", "_key", "_place", "url"))
    kept_rounds: list[DataFrame] = []
    while not undecided.isEmpty():
        first_bytes = undecided.groupBy(*by_bytes).agg(F.min("_place").alias("_b"))
        first_key = undecided.groupBy(*by_key).agg(F.min("_place").alias("_k"))
        kept = cut_lineage(
            undecided.join(first_bytes, by_bytes).join(first_key, by_key)
            .where((F.col("_place") == F.col("_b")) & (F.col("_place") == F.col("_k")))
            .select(group, "_digest", "_key", "_place", "url")
        )
        kept_rounds.append(kept)
        undecided = cut_lineage(
            undecided.join(kept.select(*by_bytes), by_bytes, "left_anti")
            .join(kept.select(*by_key), by_key, "left_anti")
        )
    if not kept_rounds:
        return images.withColumn("reason", F.lit(None).cast("string")).withColumn(
            "duplicate_of", F.lit(None).cast("string"))
    winners = reduce(lambda a, b: a.unionByName(b), kept_rounds)
    same_bytes = winners.select(*by_bytes, F.struct("_place", "url").alias("_wb"))
    same_key = winners.select(*by_key, F.struct("_place", "url").alias("_wk"))
    joined = marked.join(same_bytes, by_bytes, "left").join(same_key, by_key, "left")
    file_copy = F.col("_wb._place") < F.col("_place")
    size_copy = F.col("_wk._place") < F.col("_place")
    return (
        joined.withColumn(
            "reason", F.when(file_copy, "duplicate-file").when(size_copy, "resized-copy"))
        .withColumn("duplicate_of", F.when(file_copy, F.col("_wb.url")).when(size_copy, F.col("_wk.url")))
        .drop("_digest", "_key", "_place", "_wb", "_wk")
    )


def collapse_groups(images: DataFrame) -> DataFrame:
    """Apply a scorer's near-duplicate groups; its numbers are only claims.

    One row per organisation with ``images`` (the judged photos, at most a dozen
    structs with url, kind, carousel_ready, suitability, width, height) and
    ``groups`` (1-based number lists).  Returns the dropped photos.
    """
    def place(im: Column) -> Column:
        return F.struct(
            F.coalesce(im["kind"] == "flyer", F.lit(False)).alias("flyer"),
            (~F.coalesce(im["carousel_ready"], F.lit(False))).alias("plain"),
            (-F.coalesce(im["suitability"], F.lit(0))).cast("bigint").alias("suit"),
            (-(im["width"] * im["height"])).cast("bigint").alias("area"),
        )

    def image(n: Column) -> Column:
        return F.element_at(F.col("images"), n.cast("int"))

    drop_type = "array<struct<url:string,duplicate_of:string>>"
    start = F.struct(
        F.array().cast("array<double>").alias("claimed"), F.array().cast(drop_type).alias("dropped"))

    def step(acc: Column, group: Column) -> Column:
        members = F.filter(
            F.array_distinct(F.coalesce(group, F.array().cast("array<double>"))),
            lambda n: (n == F.floor(n)) & n.between(1, F.size("images"))
            & ~F.array_contains(acc["claimed"], n),
        )
        ranked = F.array_sort(F.transform(
            members, lambda n, i: F.struct(place(image(n)).alias("p"), i.alias("i"), n.alias("n"))))
        best = image(F.get(ranked, F.lit(0))["n"])["url"]
        rest = F.transform(
            F.slice(ranked, F.lit(2), F.size(ranked)),
            lambda r: F.struct(image(r["n"])["url"].alias("url"), best.alias("duplicate_of")))
        real = F.size(members) >= 2
        return F.struct(
            F.when(real, F.concat(acc["claimed"], members)).otherwise(acc["claimed"]).alias("claimed"),
            F.when(real, F.concat(acc["dropped"], rest)).otherwise(acc["dropped"]).alias("dropped"),
        )

    groups = F.coalesce(F.col("groups"), F.array().cast("array<array<double>>"))
    return images.select(
        "provider", F.explode(F.aggregate(groups, start, step, lambda a: a["dropped"])).alias("d")
    ).select("provider", "d.url", "d.duplicate_of", F.lit("similar-photo").alias("reason"))


def score_photos(df: DataFrame) -> DataFrame:
    """How fit a photo is for a card: 0 judged so, 1 by its words, 2 a photograph, null never."""
    caption = F.when(F.col("caption") != "og:image", F.col("caption"))
    caption = F.coalesce(caption, F.lit(""))
    raw = F.regexp_extract(url_key(F.col("url")), "[^/]*$", 0)
    file = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    page = F.regexp_replace(F.coalesce("page", F.lit("")), r"^(?i)https?://[^/]+", "")
    text = F.regexp_replace(F.concat_ws(" ", caption, file, page), r"[_\-./]+", " ")
    ext = F.lower(F.regexp_extract(file, r"(?i)\.([a-z0-9]+)$", 1))
    aspect = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    photograph = (ext.isin("jpg", "jpeg", "webp") | ((ext == "png") & (F.col("width") >= 900))) & aspect.between(0.75, 2.6)
    never = (
        has(text, vocab.ADULT_OR_FUNDRAISING) | has(file, vocab.GRAPHIC)
        | has(F.coalesce("caption", F.lit("")), vocab.GRAPHIC)
    )
    score = (
        F.when(F.col("judged"), F.when(F.col("kind") == "program-photo", 0))
        .when(never, F.lit(None).cast("int"))
        .when(has(text, vocab.ABOUT_KIDS), 1)
        .when(photograph, 2)
    )
    return df.withColumn("score", score)


def drop_denied(photos: DataFrame, denylist: DataFrame) -> DataFrame:
    """Photos a person has not rejected, compared without query and fragment."""
    denied = denylist.select(url_key(F.col("url")).alias("_key")).distinct()
    return photos.withColumn("_key", url_key(F.col("url"))).join(denied, "_key", "left_anti").drop("_key")


def reject_funnel(ledger: DataFrame) -> DataFrame:
    """Dropped images per reason in funnel order; reasons not in it come first."""
    order = F.array(*[F.lit(r) for r in vocab.REJECT_FUNNEL])
    return (
        ledger.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("place", F.array_position(order, F.col("reason")).cast("bigint") - 1)
        .orderBy("place", "reason")
    )


def filter_media(df: DataFrame) -> DataFrame:
    """Pictures a card may show: licence, shape, no artwork, no military setting."""
    ratio = F.col("width") / F.col("height")
    source = F.coalesce(
        F.try_url_decode(F.replace(F.col("source"), F.lit("+"), F.lit("%2B"))), F.col("source"), F.lit(""))
    about = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("credit", F.lit("")), source)
    return df.where(
        has(F.col("license"), vocab.OK_LICENSE)
        & (F.col("width") >= vocab.MEDIA_MIN_WIDTH)
        & ratio.between(vocab.MEDIA_MIN_ASPECT, vocab.MEDIA_MAX_ASPECT)
        & ~has(F.col("title"), vocab.NOT_A_PHOTO)
        & ~has(about, vocab.MILITARY)
    )


def media_credit(artist: Column, license: Column) -> Column:
    name = F.trim(F.regexp_replace(F.regexp_replace(artist, "<[^>]+>", ""), r"\s+", " "))
    name = F.substring(F.coalesce(name, F.lit("")), 1, 80)
    return F.concat_ws(" · ", F.when(name == "", "Wikimedia Commons").otherwise(name), license)


