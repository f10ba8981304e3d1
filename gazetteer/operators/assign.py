"""Which photo goes to which program: no photo twice, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.operators.order import BUCKET, exact_rank, first_per, global_rank, running_sum, top_per
from gazetteer.session import cut_lineage


def own_photos(programs: DataFrame, photos: DataFrame, limit: int = vocab.IMAGES_PER_PROVIDER) -> DataFrame:
    """Each program, in order, takes the first unused photo of its organisation.

    ``programs``: id, provider, _ord.  ``photos``: provider, photo, pos (1-based,
    best first, at most ``limit`` per organisation).  A list of m photos serves
    at most the first m programs of the organisation, so only those take part.

    Where no photo is listed by two organisations, the j-th program takes the
    j-th photo.  Elsewhere programs propose in rounds: each photo stays with the
    earliest program that proposed it, the others move on to their next photo.
    This ends in the same assignment as going through programs one by one.
    """
    photos = first_per(photos, ["provider", "photo"], F.col("pos"))
    photos = top_per(photos, ["provider"], [F.col("pos")], limit).drop("pos").withColumnRenamed("_rn", "pos")
    first = top_per(programs.select("id", "provider", "_ord"), ["provider"], [F.col("_ord")], limit)
    shared_photo = photos.groupBy("photo").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tangled = photos.join(shared_photo, "photo", "left_semi").select("provider").distinct()

    plain = (
        first.join(tangled, "provider", "left_anti")
        .withColumnRenamed("_rn", "pos").join(photos, ["provider", "pos"]).select("id", "photo")
    )
    return plain.unionByName(_propose(first.join(tangled, "provider", "left_semi"), photos))


def _propose(programs: DataFrame, photos: DataFrame) -> DataFrame:
    state = cut_lineage(programs.select("id", "provider", "_ord", F.lit(1).alias("pos")))
    lists = cut_lineage(photos.join(programs.select("provider").distinct(), "provider", "left_semi"))
    while True:
        asking = state.join(lists, ["provider", "pos"])
        holder = asking.groupBy("photo").agg(F.min("_ord").alias("_holder"))
        held = asking.join(holder, "photo")
        losers = held.where("_ord <> _holder").select("id", F.lit(1).alias("_step"))
        moved = cut_lineage(
            state.join(losers, "id", "left")
            .withColumn("pos", F.col("pos") + F.coalesce("_step", F.lit(0))))
        if moved.where("_step IS NOT NULL").isEmpty():
            return held.where("_ord = _holder").select("id", "photo")
        state = moved.drop("_step")


def pool_photos(programs: DataFrame, pool: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """Pool photos for programs without one of their own.

    ``programs``: id, subject, _ord.  ``pool``: subject, source, _ord.  The j-th
    program of a subject takes the j-th photo of that subject.  Programs and
    photos left over are matched by their overall rank, so that nobody goes
    without while photos remain.
    """
    photos = first_per(pool, ["source"], F.col("_ord"))
    if reserved is not None:
        photos = photos.join(reserved.select("source").distinct(), "source", "left_anti")
    asked = exact_rank(programs, ["subject"], "_ord", "_j")
    offered = exact_rank(photos, ["subject"], "_ord", "_j")
    own = asked.join(offered.select("subject", "_j", "source"), ["subject", "_j"]).select("id", "source")
    waiting = programs.join(own, "id", "left_anti").withColumn("_all", F.lit(0))
    spare = photos.join(own, "source", "left_anti").withColumn("_all", F.lit(0))
    rest = (
        exact_rank(waiting, ["_all"], "_ord", "_j")
        .join(exact_rank(spare, ["_all"], "_ord", "_j").select("_j", "source"), "_j")
        .select("id", "source")
    )
    return own.unionByName(rest)


def _exhaustions(placed: DataFrame, sizes: dict[str, int], bucket: int) -> list[tuple[int, list[str], str | None]]:
    """Phases of a walk in which programs draw from subject piles.

    A program (pos, subject) takes from its subject's pile or, where that is
    empty or missing, from the first pile that is not (``sizes`` is in that
    order).  Returns (last pos, piles left, pile for overflow) of each phase;
    a phase ends with the draw that empties a pile.

    Within a phase each pile is drawn by known subjects only, so it is empty at
    a known count of their programs.  Counts per range of positions find the
    range, rows of that one range find the place.  Subjects are few: their
    totals are all that reaches the driver.
    """
    ranged = placed.select("subject", "pos", F.floor(F.col("pos") / bucket).alias("_range"))
    totals = cut_lineage(ranged.groupBy("_range", "subject").agg(F.count(F.lit(1)).alias("n")))
    spark = placed.sparkSession
    left, phases, done, end = dict(sizes), [], {}, 0
    every = {r["subject"]: r["n"] for r in totals.groupBy("subject").agg(F.sum("n").alias("n")).collect()}
    while any(left.values()):
        live = [s for s, n in left.items() if n]
        draws = {s: [s] for s in live}
        draws[live[0]] = [live[0], *[s for s in every if s not in live]]
        # How many programs of its subjects there are in all when a pile is empty.
        goal = {s: left[s] + sum(done.get(x, 0) for x in who) for s, who in draws.items()}
        needs = [(s, x, goal[s]) for s, who in draws.items() for x in who if sum(every.get(y, 0) for y in who) >= goal[s]]
        if not needs:
            break
        asked = F.broadcast(spark.createDataFrame(needs, "pile string, subject string, goal long"))
        upto = Window.partitionBy("pile").orderBy("_range")
        reach = totals.join(asked, "subject").groupBy("pile", "goal", "_range").agg(F.sum("n").alias("n"))
        reach = reach.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= F.col("goal"))
        at = reach.groupBy("pile", "goal").agg(F.min_by(F.struct("_range", (F.col("upto") - F.col("n")).alias("before")), "_range").alias("at"))
        found = at.select("pile", F.col("goal").alias("_goal"), "at.*").collect()
        first = min(r["_range"] for r in found)
        here = [(r["pile"], x, r["_goal"] - r["before"]) for r in found if r["_range"] == first for x in draws[r["pile"]]]
        asked = F.broadcast(spark.createDataFrame(here, "pile string, subject string, nth long"))
        nth = F.row_number().over(Window.partitionBy("pile").orderBy("pos"))
        hit = ranged.where(F.col("_range") == first).join(asked, "subject").withColumn("_nth", nth).where("_nth = nth")
        end, pile = hit.agg(F.min(F.struct("pos", "pile"))).first()[0]
        passed = totals.where(F.col("_range") < first).select("subject", "n").unionByName(
            ranged.where((F.col("_range") == first) & (F.col("pos") <= end)).select("subject", F.lit(1).cast("bigint").alias("n")))
        phases.append((end, live, live[0]))
        before, done = done, {r["subject"]: r["n"] for r in passed.groupBy("subject").agg(F.sum("n").alias("n")).collect()}
        for s, who in draws.items():
            left[s] -= sum(done.get(x, 0) - before.get(x, 0) for x in who)
    live = [s for s, n in left.items() if n]
    return [*phases, (2**62, live, live[0] if live else None)]


def walk_pool(programs: DataFrame, pool: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pool photos as a walk in order would hand them out: (id, source).

    ``programs``: id, subject, _ord.  ``pool``: subject, source, _ord; a photo
    listed by several subjects belongs to the first.  Every program takes the
    next photo of its subject, else the next of the first subject, in pool order,
    that has one left.
    """
    photos = first_per(pool, ["source"], F.col("_ord"))
    piles = photos.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("_ord").alias("_at")).orderBy("_at").collect()
    placed = cut_lineage(global_rank(programs.select("id", "subject", "_ord"), "_ord", "pos", bucket))
    taken_from = F.lit(None).cast("string")
    for end, live, spill in reversed(_exhaustions(placed, {r["subject"]: r["n"] for r in piles}, bucket)):
        pile = F.when(F.col("subject").isin(live), F.col("subject")).otherwise(F.lit(spill).cast("string"))
        taken_from = F.when(F.col("pos") <= end, pile).otherwise(taken_from)
    drawn = placed.withColumn("pile", taken_from).where("pile IS NOT NULL")
    # Whoever draws from a pile gets its photos one after the other.
    turn = exact_rank(drawn.select("id", "pile", "pos"), ["pile"], "pos", "_turn", bucket)
    lying = exact_rank(photos.select(F.col("subject").alias("pile"), "source", "_ord"), ["pile"], "_ord", "_turn", bucket)
    return turn.join(lying.select("pile", "_turn", "source"), ["pile", "_turn"]).select("id", "source")


def assign_photos(
    programs: DataFrame, photos: DataFrame, pool: DataFrame, local: DataFrame, bucket: int = BUCKET
) -> DataFrame:
    """One picture for each program, no picture twice: (id, way, picture).

    ``programs``: id, provider, subject, _ord.  ``way`` is the first that has a
    picture left: ``own`` (an unused photo of the organisation), ``pool`` (a
    pool photo of the subject, then of any subject), ``local`` (the subject's
    stock photo, for the first program that needs it) or ``none``.  ``local``:
    subject, source; these and own photos are never handed out by the pool.
    """
    own = cut_lineage(own_photos(programs, photos).withColumnRenamed("photo", "picture"))
    waiting = programs.join(own, "id", "left_anti")
    reserved = local.select("source").unionByName(own.select(F.col("picture").alias("source"))).distinct()
    pooled = cut_lineage(walk_pool(waiting, pool.join(reserved, "source", "left_anti"), bucket).withColumnRenamed("source", "picture"))
    still = waiting.join(pooled, "id", "left_anti")
    free = local.join(own.select(F.col("picture").alias("source")), "source", "left_anti")
    stock = first_per(still.join(free, "subject"), ["source"], F.col("_ord")).select("id", F.col("source").alias("picture"))
    ways = [df.select("id", F.lit(way).alias("way"), "picture") for way, df in (("own", own), ("pool", pooled), ("local", stock))]
    served = ways[0].unionByName(ways[1]).unionByName(ways[2])
    return programs.select("id").join(served, "id", "left").withColumn("way", F.coalesce("way", F.lit("none")))


def fill_tiles(rows: DataFrame, pool: DataFrame, n: int = vocab.TILES) -> DataFrame:
    """Fill each program's row of thumbnails up to ``n`` from its subject's pool.

    ``rows``: id, subject, _ord, have (photos it has), main (its picture).
    ``pool``: subject, src, claimed, _ord; unclaimed photos come first.  A row
    starts where the rows before it stopped, so neighbours differ; the row's own
    picture is passed over.  One more photo than needed is looked up for that.
    """
    gaps = rows.withColumn("_gap", F.greatest(F.lit(n) - F.col("have"), F.lit(0))).where("_gap > 0")
    starts = running_sum(gaps, ["subject"], "_ord", F.col("_gap"), "_through")
    pool = pool.withColumn("_taken", F.coalesce("claimed", F.lit(False)))
    sizes = pool.groupBy("subject").agg(F.count(F.lit(1)).alias("_size"), F.count_if(~F.col("_taken")).alias("_open"))
    # Claimed photos are ranked by themselves and go on where the unclaimed end.
    slots = exact_rank(pool, ["subject", "_taken"], "_ord", "_slot").join(sizes.select("subject", "_open"), "subject")
    slots = slots.withColumn("_slot", F.col("_slot") + F.when(F.col("_taken"), F.col("_open")).otherwise(F.lit(0)))
    wanted = (
        starts.join(sizes.drop("_open"), "subject")
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap"))))
        .where(F.col("_k") < F.col("_size"))
        .withColumn("_slot", (F.col("_through") - F.col("_gap") + F.col("_k")) % F.col("_size") + 1)
    )
    found = wanted.join(slots.select("subject", "_slot", "src"), ["subject", "_slot"]).where(
        ~F.col("src").eqNullSafe(F.col("main")))
    # At most n + 1 rows per program meet here.
    w = Window.partitionBy("id").orderBy("_k")
    return (
        found.withColumn("tile", F.row_number().over(w)).where(F.col("tile") <= F.col("_gap"))
        .withColumn("tile", F.col("tile") + F.col("have")).select("id", "tile", "src")
    )


def interleave(results: DataFrame, existing: DataFrame, targets: dict[str, int]) -> DataFrame:
    """New pool entries: best result of every query in turn, up to a target per subject.

    ``results``: subject, subject_no, query_no, result_rank, title, source, _ord.
    A title belongs to the first subject that lists it and is never taken twice
    or taken again when ``existing`` (subject, title, id) has it.  Ids go on from
    the highest there, so earlier reviews keep their numbers.
    """
    goal = F.coalesce(
        *[F.when(F.col("subject") == s, F.lit(t)) for s, t in targets.items()], F.lit(0))
    fresh = results.join(existing.select("title").distinct(), "title", "left_anti")
    order = [F.col("subject_no"), F.col("result_rank"), F.col("query_no"), F.col("_ord")]
    fresh = first_per(fresh, ["title"], *order)
    top = top_per(fresh, ["subject"], order[1:], max(targets.values()))
    have = existing.groupBy("subject").agg(F.count(F.lit(1)).alias("_have"))
    taken = top.join(have, "subject", "left").where(
        F.col("_rn") <= goal - F.coalesce("_have", F.lit(0)))
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(-1)))
    # The sum of all targets bounds what this window sees.
    number = F.row_number().over(Window.orderBy("subject_no", "_rn"))
    return taken.select(
        (highest.scalar() + number).alias("id"), "subject", "title", "source")

