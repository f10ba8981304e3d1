"""Groups of near-copies among texts of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer.functions.regex import let
from gazetteer.operators.order import top_per
from gazetteer.session import cut_lineage

HASHES, BANDS = 32, 16
GROWTH = 4  # times as many leaders a bucket in each round


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct hashes of every k words in a row."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))

    def runs(words: Column) -> Column:
        n = F.size(words)
        zipped = F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)])
        hashed = F.transform(zipped, lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(k)]))
        return F.array_distinct(F.slice(hashed, F.lit(1), F.greatest(n - k + 1, F.lit(1))))

    return let(F.split(plain, " "), runs)


def min_hashes(h: str, n: int = HASHES) -> list[Column]:
    """Aggregates: for each of ``n`` hash functions the least value over the shingles of a text."""
    return [F.min(F.xxhash64(h, F.lit(i))).alias(f"_m{i}") for i in range(n)]


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_duplicate_groups(
    texts: DataFrame, threshold: float = 0.7, group: str = "source", key: str = "doc_id"
) -> DataFrame:
    """Label each text with the lowest key of its group of near-copies.

    A group is a connected component: texts of one source are linked where they
    share a bucket and their true Jaccard similarity reaches the threshold.

    Exact copies fold first.  The rest fall into buckets by MinHash bands; in
    each round the lowest open keys of a bucket lead it and meet all its open
    texts.  Leaders then are done, and texts near enough to one join the lowest
    such leader and leave the bucket.  A text that leaves may still be linked
    to one that is not near that leader: Jaccard distance is a metric, so only
    texts whose similarities to the leader differ by at most 1 - threshold can
    be, and just those meet.  The first round has one leader a bucket, each
    later one four times as many.  A tight group thus yields one pair per open
    text and leader, never all pairs, and a bucket of unlike texts, all of
    whose pairs have to be looked at, takes as many rounds as its size has
    digits to the base of four.  Shingles are kept of texts that share a bucket
    only.  Rounds end when no bucket has two open texts; links then run to
    the lowest label of their component.
    """
    text = F.coalesce("text", F.lit(""))
    hashed = texts.select(group, key, F.sha2(text, 256).alias("_sha"))
    lead = hashed.groupBy(group, "_sha").agg(F.min(key).alias("_lead"))
    copies = hashed.join(lead, [group, "_sha"]).select(key, "_lead")
    # Signatures of copies cost less than dealing out all texts to leave the copies out.
    signature = texts.select(group, key, F.explode(shingles(text)).alias("_h")).groupBy(group, key).agg(*min_hashes("_h"))
    signature = cut_lineage(signature.join(lead.select(F.col("_lead").alias(key)), key, "left_semi"))
    width, place = HASHES // BANDS, [group, "_bucket"]
    bands = F.array(*[
        F.xxhash64(F.lit(i), F.array(*[F.col(f"_m{i * width + j}") for j in range(width)])) for i in range(BANDS)])
    bucketed = signature.select(group, key, F.explode(bands).alias("_bucket"))
    crowded = bucketed.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    open_rows = cut_lineage(bucketed.join(crowded, place).select(group, key, "_bucket"))
    marked = cut_lineage(
        texts.join(open_rows.select(key).distinct(), key, "left_semi").select(group, key, shingles(text).alias("_sh")))
    share, links, far = 1, None, None
    while True:
        leaders = top_per(open_rows, place, [F.col(key)], share).select(*place, F.col(key).alias("_leader"))
        met = cut_lineage(open_rows.join(leaders, place).where(F.col(key) > F.col("_leader")))
        if met.isEmpty():
            break
        scored = cut_lineage(_scored(met.select(key, "_leader").distinct(), marked, key))
        met = cut_lineage(met.join(scored, [key, "_leader"]))
        near = F.col("_j") >= threshold
        close = scored.where(near).select(key, "_leader")
        judged = cut_lineage(met.groupBy(*place, key).agg(
            F.count(F.lit(1)).alias("_n"), F.min(F.when(near, F.struct("_leader", "_j"))).alias("_home")))
        left = judged.where("_home IS NOT NULL").select(*place, key, "_home.*")
        across = cut_lineage(_across(left, met.where(~near), [*place, "_leader"], key, 1 - threshold))
        links = close if links is None else links.unionByName(close)
        far = across if far is None else far.unionByName(across)
        # A leader meets only the leaders below it, any other text as many as lead.
        open_rows = judged.where((F.col("_n") == share) & F.col("_home").isNull()).select(group, key, "_bucket")
        share *= GROWTH
    if links is not None:
        links = links.unionByName(
            _scored(far.distinct(), marked, key).where(F.col("_j") >= threshold).select(key, "_leader"))
    labels = _components(links, key) if links is not None else None
    out = copies
    if labels is not None:
        out = out.join(labels.withColumnsRenamed({key: "_lead", "label": "_label"}), "_lead", "left")
        out = out.withColumn("label", F.coalesce("_label", "_lead"))
    else:
        out = out.withColumn("label", F.col("_lead"))
    return out.select(key, "label")


def _scored(pairs: DataFrame, marked: DataFrame, key: str) -> DataFrame:
    """Pairs of ``key`` and ``_leader`` with their Jaccard similarity ``_j``."""
    sets = marked.select(key, "_sh")
    return (
        pairs.join(sets, key)
        .join(sets.select(F.col(key).alias("_leader"), F.col("_sh").alias("_lsh")), "_leader")
        .select(key, "_leader", jaccard(F.col("_sh"), F.col("_lsh")).alias("_j")))


def _across(left: DataFrame, rest: DataFrame, leader: list[str], key: str, reach: float) -> DataFrame:
    """Pairs of a text that left with a leader and one that is not near that leader, which may be linked.

    The extremes of each side cut the other before the two meet.
    """
    reach = reach + 1e-9  # similarities are floating-point numbers
    lowest = left.groupBy(*leader).agg(F.min("_j").alias("_low"))
    highest = rest.groupBy(*leader).agg(F.max("_j").alias("_high"))
    near = rest.join(lowest, leader).where(F.col("_low") - F.col("_j") <= reach).select(*leader, key, "_j")
    far = left.join(highest, leader).where(F.col("_j") - F.col("_high") <= reach)
    far = far.select(*leader, F.col(key).alias("_other"), F.col("_j").alias("_lj"))
    met = near.join(far, leader).where(F.col("_lj") - F.col("_j") <= reach)
    return met.select(F.greatest(key, "_other").alias(key), F.least(key, "_other").alias("_leader")).distinct()


def _components(links: DataFrame, key: str) -> DataFrame:
    """Lowest key of each linked component, by passing labels along the links."""
    edges = cut_lineage(
        links.select(F.col(key).alias("a"), F.col("_leader").alias("b"))
        .unionByName(links.select(F.col("_leader").alias("a"), F.col(key).alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("_heard"))
        # A label's own label is heard too, which halves long chains.
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("_jump"))
        moved = cut_lineage(
            labels.join(heard, "a").join(jump, "label", "left")
            .select("a", F.least("label", "_heard", F.coalesce("_jump", "label")).alias("new"), "label"))
        done = moved.where("new <> label").isEmpty()
        labels = moved.select("a", F.col("new").alias("label"))
        if done:
            return labels.withColumnRenamed("a", key)
