"""Which website belongs to which organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.regex import has
from gazetteer.functions.text import looks_local, provider_key
from gazetteer.functions.values import literal_array
from gazetteer.functions.web import host_of, page_identity, visible_text
from gazetteer.operators.order import first_per, union_in_order


def verdict(
    identity: Column, text: Column, host: Column, final_url: Column, signals: Column,
    html: Column, curated: Column, markers: str = vocab.REGION_MARKERS,
) -> Column:
    """``struct<confidence, matched>`` of a candidate page, or null to reject it."""
    weak = literal_array(vocab.WEAK_SIGNALS)
    hit = F.filter(signals, lambda s: F.contains(identity, s))
    distinctive = F.size(F.filter(hit, lambda s: ~F.array_contains(weak, s)))
    body = F.concat_ws(" ", identity, F.lower(text))
    found = F.filter(signals, lambda s: F.contains(body, s))
    base = F.element_at(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."), 1)
    initials = F.array_join(F.transform(signals, lambda s: F.substring(s, 1, 1)), "")
    acronym = (F.length(base) <= 6) & (F.contains(initials, base) | F.contains(base, initials))

    def accept(confidence: str, matched: Column) -> Column:
        return F.struct(F.lit(confidence).alias("confidence"), matched.alias("matched"))

    rejected = (
        (F.size(signals) <= 0)
        | has(host, vocab.PARKED_HOSTS) | has(final_url, vocab.PARKED_HOSTS)
        | has(identity, vocab.PARKED_TEXT) | has(html, vocab.PARKED_TEXT)
        | ~looks_local(text, markers)
    )
    none = F.lit(None)
    return (
        F.when(F.coalesce(rejected, F.lit(True)), none)
        .when(curated & (F.size(found) > 0) & (F.size(found) / F.size(signals) >= 0.5),
              accept("strong", found))
        .when(distinctive == 0, none)
        .when(F.array_contains(weak, base) & (distinctive < 2), none)
        .when(F.size(hit) / F.size(signals) >= 0.6, accept("strong", hit))
        .when(distinctive >= 2, accept("strong", hit))
        .when(acronym, accept("acronym", hit))
    )


def verify_pages(df: DataFrame, markers: str = vocab.REGION_MARKERS) -> DataFrame:
    """Adds ``confidence`` and ``matched``; both null where the page is rejected."""
    judged = df.withColumn("_identity", page_identity(F.col("html"))).withColumn(
        "_text", visible_text(F.col("html"))
    )
    v = verdict(
        F.col("_identity"), F.col("_text"), F.col("host"), F.col("final_url"),
        F.col("signals"), F.col("html"), F.col("curated"), markers,
    )
    return judged.withColumn("_v", v).withColumn("confidence", F.col("_v.confidence")).withColumn(
        "matched", F.col("_v.matched")
    ).drop("_v", "_identity", "_text")


def domains_above(host: Column) -> Column:
    """The host itself and every parent domain."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def blocked_rows(df: DataFrame, blocklist: DataFrame, provider: str, url: str, key: list[str]) -> DataFrame:
    """Rows whose host is, or lies under, a domain blocked for that organisation.

    Every parent domain of a host is an equi-join key, so there is no search of
    the blocklist per row.
    """
    domains = blocklist.select(
        F.col("provider").alias(provider), host_of(F.col("domain")).alias("_domain"), "why"
    ).where("_domain IS NOT NULL").groupBy(provider, "_domain").agg(F.min("why").alias("why"))
    return (
        df.where(F.col(url).isNotNull())
        .withColumn("_domain", F.explode(domains_above(host_of(F.col(url)))))
        .join(domains, [provider, "_domain"])
        .groupBy(*key).agg(F.min("why").alias("why"))
    )


def apply_blocklist(providers: DataFrame, blocklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clear blocked websites so that they are resolved again; report the cleared."""
    hits = blocked_rows(providers, blocklist, "provider", "website", ["provider"])
    marked = providers.join(hits.withColumn("_hit", F.lit(True)), "provider", "left")
    cleared = marked.where("_hit").select("provider", "website", "why")
    blank = F.col("_hit").isNotNull()
    cleaned = marked.withColumn("website", F.when(~blank, F.col("website")))
    if "resolved_via" in providers.columns:
        cleaned = cleaned.withColumn("resolved_via", F.when(~blank, F.col("resolved_via")))
    if "matched" in providers.columns:
        cleaned = cleaned.withColumn(
            "matched", F.when(blank, F.array().cast("array<string>")).otherwise(F.col("matched")))
    cleaned = cleaned.withColumn("confidence", F.when(blank, "unresolved").otherwise(F.col("confidence")))
    return cleaned.drop("_hit", "why"), cleared


def normalized_join(providers: DataFrame, known: DataFrame) -> DataFrame:
    """Curated hosts of each organisation, matched on the folded name."""
    entries = (
        known.where(~F.startswith(F.col("name"), F.lit("_")))
        .select(provider_key(F.col("name")).alias("_key"), F.explode("hosts").alias("host"))
        .distinct()
    )
    return providers.withColumn("_key", provider_key(F.col("provider"))).join(entries, "_key").drop("_key")


def resolve(
    candidates: DataFrame, pages: DataFrame, blocklist: DataFrame, markers: str = vocab.REGION_MARKERS
) -> DataFrame:
    """First candidate host, in priority order, whose page proves the organisation.

    ``candidates``: provider, host, pos, source_rank, curated, signals.
    ``pages``: host, final_url, html, content_type, https and _ord.  A host is
    asked over https before http; an answer that is not HTML ends that host.
    """
    allowed = candidates.join(
        blocked_rows(candidates, blocklist, "provider", "host", ["provider", "host"]),
        ["provider", "host"], "left_anti")
    home = first_per(pages, ["host"], F.desc("https"), F.col("_ord")).where(
        F.lower("content_type").contains("html"))
    judged = verify_pages(allowed.join(home.drop("_ord"), "host"), markers).where(
        "confidence IS NOT NULL").drop("html")
    landed = judged.join(
        blocked_rows(judged.select("provider", "final_url"), blocklist, "provider", "final_url",
                     ["provider", "final_url"]),
        ["provider", "final_url"], "left_anti")
    return first_per(landed, ["provider"], F.col("source_rank"), F.col("pos")).select(
        "provider", F.col("final_url").alias("website"), F.col("host").alias("resolved_via"),
        "confidence", "matched",
        F.element_at(F.array(F.lit("known"), F.lit("generated"), F.lit(vocab.MODEL_METHOD)),
                     F.col("source_rank") + 1).alias("source"))


def union_candidates(known: DataFrame, generated: DataFrame, guessed: DataFrame | None = None) -> DataFrame:
    """Curated, then generated, then guessed hosts; each host once per organisation."""
    sources = [known, generated] + ([guessed] if guessed is not None else [])
    return union_in_order(sources, ["provider"], "host", "pos")


def targets(df: DataFrame, stage: str) -> DataFrame:
    """Rows a stage still has to work on; pages and images come as counts, which stay small."""
    return df.where({
        "resolve": "NOT coalesce(locked, false) AND website IS NULL",
        "crawl": "website IS NOT NULL",
        "extract": "n_pages > 0",
        "images": "n_images > 0",
    }[stage])
