"""Checks of the published tables and of each stage's output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.geo import haversine, in_city
from gazetteer.operators.spatial import schools_within


def _rows(counted: DataFrame, level: str = "fail") -> DataFrame:
    """One row of failure counts as (check, level, failing)."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in counted.columns)
    out = counted.select(F.expr(f"stack({len(counted.columns)}, {pairs}) AS (check, failing)"))
    return out.select("check", F.when(F.col("failing") == 0, "pass").otherwise(level).alias("level"), "failing")


def _failing(ok: Column) -> Column:
    return F.count_if(~F.coalesce(ok, F.lit(False)))


def check_programs(programs: DataFrame) -> DataFrame:
    """Every rule about a program that needs no other table, counted in one pass."""
    e, cost, host = "enrichment", F.col("cost"), F.col("inSchoolBuilding")
    method = F.coalesce(F.col(f"{e}.method"), F.lit(""))
    tools, evidence = F.size(f"{e}.stemTools"), F.size(f"{e}.evidence")
    quoted = F.size(f"{e}.subjects") == F.size(f"{e}.subjectEvidence")
    stated = cost["tier"] != "unknown"
    by_rule = cost["source"] == vocab.COST_SOURCES[0]
    return _rows(programs.agg(
        _failing(F.col("id").isNotNull() & (F.col("id") != "")).alias("id-present"),
        _failing(cost["tier"].isin(vocab.COST_TIERS)).alias("cost-tier-known"),
        _failing(cost["source"].isin(vocab.COST_SOURCES)).alias("cost-source-known"),
        _failing(~stated | F.when(by_rule, F.col("programArea") == vocab.FREE_AREA).otherwise(
            (cost["source"] == vocab.COST_SOURCES[1]) & (method == vocab.MODEL_METHOD))).alias("price-has-source"),
        _failing((method != vocab.KEYWORD_METHOD) | (((tools == 0) | (evidence > 0)) & quoted)).alias("keywords-quoted"),
        _failing((method != vocab.MODEL_METHOD) | (tools == 0) | (evidence > 0)).alias("model-tools-backed"),
        _failing(F.col(f"{e}.stemTools").isNotNull() & F.col(f"{e}.evidence").isNotNull()
                 & F.col("photos").isNotNull()).alias("arrays-present"),
        _failing(F.col("lat").isNull() | F.col("lng").isNull() | in_city(F.col("lat"), F.col("lng"))).alias("inside-box"),
        _failing(host.isNull() | (host["distanceM"] <= vocab.SCHOOL_RADIUS_M)).alias("host-in-radius"),
        _failing(F.forall("photos", lambda p: p["url"].rlike("^https?://") & (
            F.coalesce(p["sourcePage"], F.lit("")) != ""))).alias("photos-attributed"),
    ))


def check_hosts(programs: DataFrame, schools: DataFrame, radius_m: float = vocab.SCHOOL_RADIUS_M) -> DataFrame:
    """Hosts against the schools themselves: in radius, and serving where a school in radius does.

    A host is met by its number alone, and only programs whose host does not
    serve look for schools around, so neither makes lists or all pairs in radius.
    """
    hosted = programs.where("inSchoolBuilding IS NOT NULL").select(
        F.monotonically_increasing_id().alias("id"), "lat", "lng", "inSchoolBuilding.dbn", "inSchoolBuilding.servesK5")
    known = schools.select(F.col("dbn").alias("r_dbn"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    near = haversine(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"), vocab.EARTH_M) <= radius_m
    apart = hosted.join(known, (F.col("dbn") == F.col("r_dbn")) & near, "left_anti")
    bare = hosted.where(~F.coalesce("servesK5", F.lit(False)))
    passed_over = schools_within(bare, schools.where("serves_k5"), radius_m, copy_left=True).select("id").distinct()
    return _rows(apart.agg(F.count(F.lit(1)).alias("host-is-co-located"))).unionByName(
        _rows(passed_over.agg(F.count(F.lit(1)).alias("host-serves-when-possible"))))


def check_unique(df: DataFrame, key: str, name: str) -> DataFrame:
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _rows(copies.agg(F.count(F.lit(1)).alias(name)))


def check_density(zips: DataFrame, programs: DataFrame) -> DataFrame:
    """Programs per ZIP as published against a recount."""
    recount = programs.groupBy(F.col("address.zip").alias("zip")).agg(F.count(F.lit(1)).alias("_n"))
    wrong = zips.join(recount, "zip", "left").where(
        F.col("k5ProgramsNow") != F.coalesce("_n", F.lit(0).cast("bigint")))
    return _rows(wrong.agg(F.count(F.lit(1)).alias("density-matches")))


def check_counts(counts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Published counts (counter, n) against the tables themselves."""
    actual = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).alias("_actual")).withColumn("counter", F.lit(name))
        for name, df in tables.items()])
    wrong = actual.join(counts, "counter", "left").where(~F.col("_actual").eqNullSafe(F.col("n")))
    return _rows(wrong.agg(F.count(F.lit(1)).alias("counts-match")))


def check_version(meta: DataFrame) -> DataFrame:
    return _rows(meta.agg(_failing(F.col("schemaVersion").rlike(r"^\d+\.\d+\.\d+$")).alias("version-declared")))


def check_contract(programs: DataFrame, zips: DataFrame, schools: DataFrame, counts: DataFrame, meta: DataFrame) -> DataFrame:
    tables = {"programs": programs, "schools": schools, "zips": zips}
    parts = [
        check_programs(programs), check_hosts(programs, schools), check_unique(programs, "id", "ids-unique"),
        check_counts(counts, tables), check_density(zips, programs), check_version(meta)]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- stages ------------------------------------------------------------------

def coverage(rows: DataFrame, expected: DataFrame, key: str = "provider") -> DataFrame:
    """Expected keys, those missing, and one of them; copies cannot hide a gap."""
    want = expected.select(key).where(F.col(key).isNotNull()).distinct()
    have = rows.select(key).distinct().withColumn("_have", F.lit(True))
    gap = F.col("_have").isNull()
    return want.join(have, key, "left").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(gap).alias("missing"),
        F.min(F.when(gap, F.col(key))).alias("example"))


def level_of(ok: Column, otherwise: str = "fail", testable: Column | None = None) -> Column:
    """pass, or the given level; ``warn`` where there is nothing to test."""
    out = F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(otherwise)
    return out if testable is None else F.when(testable, out).otherwise("warn")


def _levels(counted: DataFrame, checks: dict[str, Column], stage: str) -> DataFrame:
    found = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("level")) for n, c in checks.items()])
    return counted.select(F.explode(found).alias("c")).select(F.lit(stage).alias("stage"), "c.check", "c.level")


def check_resolve(providers: DataFrame) -> DataFrame:
    resolved = F.coalesce(F.col("website"), F.lit("")) != ""
    n = providers.agg(
        F.count_if(resolved).alias("ok"),
        F.count_if(resolved & ~F.coalesce(F.col("confidence").isin("strong", "acronym"), F.lit(False))).alias("unsure"),
        F.count_if(resolved & (F.coalesce(F.col("resolved_via"), F.lit("")) == "")).alias("untraced"))
    return _levels(n, {
        "some-verified": level_of(F.col("ok") > 0),
        "confidence-known": level_of(F.col("unsure") == 0),
        "route-recorded": level_of(F.col("untraced") == 0, "warn"),
    }, "resolve")


def check_crawl(pages: DataFrame, providers: DataFrame) -> DataFrame:
    sites = pages.groupBy("provider").agg(F.max(F.length("text")).alias("longest"))
    n = sites.agg(
        F.count(F.lit(1)).alias("crawled"),
        F.count_if(~F.coalesce(F.col("longest") > vocab.MIN_PAGE_TEXT, F.lit(False))).alias("empty"))
    resolved = providers.where("coalesce(website, '') <> ''").agg(F.count(F.lit(1))).scalar()
    return _levels(n, {
        "all-crawled": level_of(F.col("crawled") >= resolved, "warn"),
        "text-found": level_of(F.col("empty") == 0, "warn"),
    }, "crawl")


def check_extract(facts: DataFrame, crawled: DataFrame) -> DataFrame:
    missing = coverage(facts, crawled).select("missing").scalar()
    model = F.coalesce(F.col("method") == vocab.MODEL_METHOD, F.lit(False))
    n = facts.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(model).alias("model"),
        F.count_if(model & (F.size("stem_tools") > 0) & (F.size("evidence") <= 0)).alias("unbacked"),
        F.count_if(F.size("subjects") != F.size("subject_evidence")).alias("unquoted"))
    return _levels(n, {
        "facts-cover": level_of(missing == 0),
        "all-by-model": level_of(F.col("model") == F.col("n"), "warn"),
        "tools-backed": level_of(F.col("unbacked") == 0, testable=F.col("model") > 0),
        "subjects-quoted": level_of(F.col("unquoted") == 0),
    }, "extract")


def check_images(photos: DataFrame, ledger: DataFrame, crawled: DataFrame) -> DataFrame:
    missing = coverage(photos, crawled).select("missing").scalar()
    unreasoned = ledger.where("reason IS NULL").agg(F.count(F.lit(1))).scalar()
    judged = F.coalesce(F.col("judged"), F.lit(False))
    n = photos.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(judged).alias("judged"),
        F.count_if(judged & F.col("suitability").isNull()).alias("unscored"))
    return _levels(n, {
        "photos-cover": level_of(missing == 0, "warn"),
        "all-judged": level_of(F.col("judged") == F.col("n"), "warn"),
        "scores-present": level_of(F.col("unscored") == 0, testable=F.col("judged") > 0),
        "reasons-recorded": level_of(unreasoned == 0, "warn"),
    }, "images")


def check_build(programs: DataFrame, stale: DataFrame) -> DataFrame:
    late = stale.where("stale").agg(F.count(F.lit(1))).scalar()
    copies = programs.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1))).scalar()
    n = programs.agg(
        F.count_if(F.col("enrichment.stemTools").isNull()).alias("no_tools"),
        F.count_if((F.col("cost.tier") == "free") & (F.col("enrichment.method") == vocab.KEYWORD_METHOD)).alias("rash"))
    return _levels(n, {
        "newer-than-inputs": level_of(late == 0, "warn"),
        "ids-unique": level_of(copies == 0),
        "tools-are-arrays": level_of(F.col("no_tools") == 0),
        "free-not-by-keyword": level_of(F.col("rash") == 0, "warn"),
    }, "build")


def stale_inputs(output: DataFrame, inputs: dict[str, DataFrame], at: str = "updated_at") -> DataFrame:
    """For each input whether it changed after the output was written."""
    written = output.agg(F.max(at)).scalar()
    rows = [df.agg(F.max(at).alias("changed_at")).select(
        F.lit(name).alias("input"), "changed_at",
        F.coalesce(F.col("changed_at") > written, F.lit(False)).alias("stale")) for name, df in inputs.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def file_times(df: DataFrame) -> DataFrame:
    """Change times of the files behind a table, as ``updated_at``."""
    return df.select(F.col("_metadata.file_modification_time").alias("updated_at"))
