"""HTML and URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.regex import SPACE, fold_space, has, let
from gazetteer.functions.text import rewrite

HOST = r"^(?i)(?:https?://)?(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::\d+)?(?:[/?#].*)?$"


def visible_text(html: Column, blocks=("script", "style", "noscript"), entities=("nbsp",)) -> Column:
    t = F.regexp_replace(html, rf"(?i)<({'|'.join(blocks)})[\s\S]*?</\1>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, f"&({'|'.join(entities)});", " ")
    return fold_space(t)


def crawl_text(html: Column) -> Column:
    """Page text as kept by the crawl: drawings go, common entities become blanks."""
    return visible_text(
        html, ("script", "style", "noscript", "svg"),
        ("nbsp", "amp", "quot", "#39", "rsquo", "ldquo", "rdquo"),
    )


def page_identity(html: Column) -> Column:
    """What a page calls itself: titles, selected meta content, headings."""
    parts = [
        r"(?i)<title[^>]*>([\s\S]{0,300}?)</title>",
        r"""(?i)<meta[^>]+(?:property|name)=["'](?:og:site_name|og:title|description)["'][^>]+content=["']([^"']{0,300})["']""",
        r"(?i)<h1[^>]*>([\s\S]{0,200}?)</h1>",
    ]
    grabbed = [F.array_join(F.regexp_extract_all(html, F.lit(p), F.lit(1)), " ") for p in parts]
    return F.lower(F.regexp_replace(F.concat_ws(" ", *grabbed), "<[^>]+>", " "))


def host_of(url: Column) -> Column:
    """Host of a URL or bare host, lower case, without ``www.``; null when invalid."""
    h = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.", "")
    return F.when(h != "", h)


def site_of(url: Column) -> Column:
    """Host with port, as the same-site test compares it."""
    h = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@\s]*@)?([^/?#@\s]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(h), r"^www\.", ""), F.lit(""))


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(site_of(a) == site_of(b), F.lit(False))


def url_key(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*", 0)


def clean_domain(answer: Column) -> Column:
    """Bare domain out of a free-form answer; null when it cannot be one."""
    d = F.regexp_replace(F.lower(F.trim(answer)), "^https?://", "")
    d = F.regexp_replace(F.regexp_replace(d, "/.*$", ""), r"^www\.", "")
    return F.when(F.contains(d, F.lit(".")) & (F.length(d) < 60), d)


def _tidy_path(path: Column) -> Column:
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, seg)),
    )
    joined = F.array_join(folded, "/")
    ends_open = path.rlike(r"/\.\.?$")
    return F.when(
        F.contains(path, F.lit("/.")), F.when(ends_open, F.concat(joined, F.lit("/"))).otherwise(joined)
    ).otherwise(path)


def _escape(url: Column) -> Column:
    """Percent-encode what a URL may not hold as it stands."""
    spaced = F.regexp_replace(url, " ", "%20")
    return F.when(
        spaced.rlike(r"[^\x00-\x7f]"),
        rewrite(spaced, r"[^\x00-\x7f]+", F.url_encode),
    ).otherwise(spaced)


def absolute(href: Column, base: Column) -> Column:
    """Absolute http(s) URL of a reference on a page, without its fragment."""
    parts = F.struct(
        F.regexp_extract(F.regexp_replace(href, rf"\A{SPACE}+|{SPACE}+\z", ""), "^[^#]*", 0).alias("ref"),
        F.regexp_extract(base, "^[^#]*", 0).alias("whole"),
        F.regexp_extract(base, "^[^?#]*", 0).alias("page"),
        F.regexp_extract(base, r"^(?i)https?://[^/?#]*", 0).alias("origin"),
    )
    joined = let(parts, _join_reference)
    split = let(joined, lambda u: F.struct(
        F.regexp_extract(u, r"^(?i)(https?://[^/?#]*)", 1).alias("start"),
        F.regexp_extract(u, r"^(?i)https?://[^/?#]*([^?]*)", 1).alias("path"),
        F.regexp_extract(u, r"^[^?]*(.*)", 1).alias("query"),
    ))
    return let(split, lambda s: F.when(s["start"] != "", _escape(F.concat(
        F.lower(s["start"]),
        F.when(s["path"] == "", F.lit("/")).otherwise(_tidy_path(s["path"])),
        s["query"]))))


def _join_reference(s: Column) -> Column:
    ref, origin = s["ref"], s["origin"]
    folder = F.regexp_extract(s["page"], r"^(?i)https?://[^/?#]*(/.*/|/)", 1)
    return F.when(origin != "", (
        F.when(ref == "", s["whole"])
        .when(ref.rlike(r"^(?i)https?://[^/?#\s]"), ref)
        .when(ref.rlike("^//"), F.concat(F.regexp_extract(origin, "^[^:]*:", 0), ref))
        .when(ref.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(ref.rlike("^/"), F.concat(origin, ref))
        .when(ref.rlike(r"^\?"), F.concat(s["page"], ref))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), ref))
    ))


def plausible_image(url: Column, extensions: str = "svg|ico|gif") -> Column:
    """Not a logo by name, not a drawing or icon by extension, not inline data."""
    return (
        ~has(url, vocab.REJECT_IMAGE_NAME)
        & ~url.rlike(rf"(?i)\.({extensions})(\?|\z)")
        & ~url.rlike("^(?i)data:")
    )


def canonical_image_key(url: Column) -> Column:
    """Key under which resized variants of one upload collide."""
    shape = r"^(?i)https?://(?:[^/?#@\s]*@)?([^/?#@\s]+)([^?#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, shape, 1)), r"^www\.", "")
    path = F.lower(F.regexp_extract(url, shape, 2))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    # A plus sign is not a blank in a path.
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    for pattern, to in [
        (r"/styles/[^/]+/(public|private)/", "/"),
        (r"/v1/(fill|fit|crop)/[^/]+/", "/"),
        (r"\.(jpe?g|png)\.webp$", ".$1"),
        (r"-\d{2,5}x\d{2,5}(\.[a-z0-9]+)$", "$1"),
        (r"-(?:scaled|rotated)(\.[a-z0-9]+)$", "$1"),
        (r"@\dx(\.[a-z0-9]+)$", "$1"),
    ]:
        plain = F.regexp_replace(plain, pattern, to)
    return F.when(host == "", url).otherwise(F.concat(host, plain))
