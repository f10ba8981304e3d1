"""Joins by distance, as equi joins on grid cells.

Every point falls into one cell of a latitude/longitude grid whose cells are at
least one search radius wide at their latitude; cells of a latitude band close
across the date line.  Only the smaller side is copied to its nine neighbouring
cells; the join itself is an equi join that AQE may split when one cell is hot.
Spark's size estimate does not see those copies, so the join is never a
broadcast: it would collect nine times the estimated rows in the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.functions.geo import haversine
from gazetteer.functions.regex import let
from gazetteer.session import cut_lineage

DEGREES_PER_METRE = 360.0 / (2 * math.pi * vocab.EARTH_M)
METRES_PER_MILE = vocab.EARTH_M / vocab.EARTH_MILES


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def _reach(band: Column, dlat: float) -> Column:
    """Degrees of longitude that the radius reaches in a latitude band.

    Two points within the radius lie in one band or in neighbouring ones, so
    the widest reach is at the greatest latitude of the band and its neighbours.
    """
    edge = F.least((F.abs(band + 0.5) + 1.5) * dlat, F.lit(90.0))
    sine = F.lit(math.sin(math.radians(dlat) / 2)) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    return F.degrees(2 * F.asin(F.least(sine, F.lit(1.0)))) * 1.0001


def _around(band: Column, dlat: float) -> Column:
    """Cells in one turn of a latitude band, each as wide as the radius reaches there."""
    return F.greatest(F.floor(360.0 / _reach(band, dlat)), F.lit(1)).cast("bigint")


def _turn(lng: Column, cells: Column) -> Column:
    """Cell number of a longitude among the cells of its band; the date line joins the last and the first."""
    return F.pmod(F.floor((lng + 180.0) / 360.0 * cells).cast("bigint"), cells)


def _spread(df: DataFrame, lat: str, lng: str, dlat: float) -> DataFrame:
    """Copy each row into its own and the neighbouring cells of its own and the neighbouring bands."""
    bands = df.withColumn("_ci", F.explode(F.array(*[_cell(F.col(lat), dlat) + i for i in (-1, 0, 1)])))
    bands = bands.withColumn("_n", _around(F.col("_ci"), dlat))
    own = _turn(F.col(lng), F.col("_n"))
    near = F.array_distinct(F.array(*[F.pmod(own + j, F.col("_n")) for j in (-1, 0, 1)]))
    return bands.withColumn("_cj", F.explode(near)).drop("_n")


def _in_box(radius_m: float) -> Column:
    """Whether two places (``lat``, ``lng`` and ``r_lat``, ``r_lng``) may lie within the radius: a test without trigonometry.

    ``_reach`` is the left row's reach in longitude.
    """
    dlat = radius_m * DEGREES_PER_METRE * 1.0001
    gap = F.abs(F.col("r_lng") - F.col("lng"))
    turned = F.pmod(F.col("r_lng") - F.col("lng") + F.col("_reach"), F.lit(360.0)) <= 2 * F.col("_reach")
    return (F.abs(F.col("r_lat") - F.col("lat")) <= dlat) & (
        (gap <= F.col("_reach")) | ((gap > 180.0) & turned))  # past 180 the date line may lie between


def within(
    left: DataFrame, right: DataFrame, radius_m: float,
    earth: float = vocab.EARTH_M, out: str = "distance", copy_left: bool = False,
) -> DataFrame:
    """All pairs within a radius.  Left has ``lat``/``lng``, right ``r_lat``/``r_lng``.

    ``out`` is the unrounded distance in the unit of ``earth``; ``radius_m`` is
    in metres of the standard sphere.  Right is the side that is copied to the
    neighbouring cells, or left if it is the smaller one (``copy_left``).
    Cosines are taken once a place, and pairs outside the box around a place
    are dropped before any distance is taken.
    """
    dlat = radius_m * DEGREES_PER_METRE * 1.0001
    sides = [
        (left.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns({
            "_cos": F.cos(F.radians(F.col("lat"))), "_reach": _reach(_cell(F.col("lat"), dlat), dlat)}), "lat", "lng"),
        (right.where(F.col("r_lat").isNotNull() & F.col("r_lng").isNotNull()).withColumn(
            "_r_cos", F.cos(F.radians(F.col("r_lat")))), "r_lat", "r_lng"),
    ]
    (once, lat, lng), copied = sides[::-1] if copy_left else sides
    placed = once.withColumn("_ci", _cell(F.col(lat), dlat)).withColumn(
        "_cj", _turn(F.col(lng), _around(F.col("_ci"), dlat)))
    around = _spread(*copied, dlat)
    limit = radius_m if earth == vocab.EARTH_M else radius_m / METRES_PER_MILE
    d = haversine(
        F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"), earth, F.col("_cos"), F.col("_r_cos"))
    met = placed.join(around.hint("merge"), ["_ci", "_cj"]).where(_in_box(radius_m) & (d <= limit))
    return met.select(
        *[met[c] for c in [*left.columns, *[c for c in right.columns if c not in left.columns]]], d.alias(out))


def schools_within(
    sites: DataFrame, schools: DataFrame, radius_m: float = vocab.SCHOOL_RADIUS_M, copy_left: bool = False,
) -> DataFrame:
    """Site and school pairs in radius; ``distance_m`` is rounded after the test."""
    right = schools.select(
        "dbn", F.col("name").alias("school_name"), "serves_k5",
        F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"),
        F.col("_ord").alias("school_ord"),
    )
    return (
        within(sites.select("id", "lat", "lng"), right, radius_m, copy_left=copy_left)
        .withColumn("distance_m", F.floor(F.col("distance") + 0.5).cast("bigint"))
        .drop("r_lat", "r_lng", "lat", "lng", "distance")
    )


def with_schools(sites: DataFrame, schools: DataFrame, out: str, radius_m: float = vocab.SCHOOL_RADIUS_M) -> DataFrame:
    """Sites with the list of their schools in radius, nearest first; null or empty where there is none.

    The schools around a cell are one array, which each site of the cell reads
    as it passes.  So no pair is a row that has to be sorted, and no list goes
    through a shuffle; an array holds the schools of nine cells, as one list may
    hold those of four.
    """
    dlat = radius_m * DEGREES_PER_METRE * 1.0001
    placed = sites.withColumn("_ci", _cell(F.col("lat"), dlat)).withColumns({
        "_cj": F.coalesce(_turn(F.col("lng"), _around(F.col("_ci"), dlat)), F.xxhash64("id")),  # without a place: any task
        "_reach": _reach(F.col("_ci"), dlat)})
    around = (
        _spread(schools.where("lat IS NOT NULL AND lng IS NOT NULL"), "lat", "lng", dlat)
        .groupBy("_ci", "_cj")
        .agg(F.collect_list(F.struct("lat", "lng", "_ord", "dbn", "name", "serves_k5")).alias("_around"))
    )
    boxed = F.filter("_around", lambda x: (F.abs(x["lat"] - F.col("lat")) <= dlat) & (
        F.pmod(x["lng"] - F.col("lng") + F.col("_reach"), F.lit(360.0)) <= 2 * F.col("_reach")))
    rest = ("_ord", "dbn", "name", "serves_k5")
    measured = F.transform(boxed, lambda x: F.struct(
        haversine(F.col("lat"), F.col("lng"), x["lat"], x["lng"], vocab.EARTH_M).alias("d"), *[x[c].alias(c) for c in rest]))
    near = F.transform(F.filter(measured, lambda x: x["d"] <= radius_m), lambda x: F.struct(
        F.floor(x["d"] + 0.5).cast("bigint").alias("d"), *[x[c].alias(c) for c in rest]))
    listed = F.transform(F.sort_array(near), lambda x: F.struct(
        x["dbn"].alias("dbn"), x["name"].alias("name"), x["d"].alias("distanceM"), x["serves_k5"].alias("servesK5")))
    return placed.join(around.hint("merge"), ["_ci", "_cj"], "left").withColumn(
        out, listed).drop("_ci", "_cj", "_reach", "_around")


def pick_preferred(pairs: DataFrame, key: str = "id") -> DataFrame:
    """The nearest match that serves the audience, else the nearest of all; ``shared`` tells whether there are others."""
    best = F.min_by(
        F.struct("dbn", "school_name", "distance_m", "serves_k5"),
        F.struct(~F.col("serves_k5"), F.col("distance_m"), F.col("school_ord")),
    )
    return pairs.groupBy(key).agg(best.alias("host"), (F.count(F.lit(1)) > 1).alias("shared")).select(
        key, "host.*", "shared")


NEAR_SHARES = (32, 8)  # the first searches for a host go these parts of the radius


def preferred_schools(sites: DataFrame, schools: DataFrame, radius_m: float = vocab.SCHOOL_RADIUS_M) -> DataFrame:
    """The preferred school of each site, as ``pick_preferred`` finds it among all pairs in radius.

    A site with a serving school close by needs no other pair but one that tells
    that there are others, since no school further away comes before that one.
    So serving schools are looked for nearby first, and only sites that are not
    settled there meet all schools in radius: where schools lie dense, few pairs
    are made.  What a search settles is stored, so that no search runs twice.
    """
    rest, found = cut_lineage(sites.select("id", "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL")), []
    for share in NEAR_SHARES:
        near = radius_m / share
        close = pick_preferred(schools_within(rest, schools.where("serves_k5"), near, copy_left=True))
        # Rounded distances decide: all schools that round to this one or less lie in the near radius.
        settled = cut_lineage(close.where((F.col("distance_m") + 0.5 <= near) & F.col("shared")))
        rest = rest.join(settled.select("id"), "id", "left_anti")
        found.append(settled)
    found.append(pick_preferred(schools_within(rest, schools, radius_m, copy_left=True)))
    return reduce(lambda a, b: a.unionByName(b), found)


# --- nearest neighbour ------------------------------------------------------

ROOT = 45.0  # degrees, so at most 45 cells cover the globe
FAN = 2      # bits: a cell has 4 x 4 cells below it
DEPTH = 8    # the finest cells are some 80 m wide
AXES = ("x", "y", "z")


def _turned(lng: Column) -> Column:
    """A longitude between -180 and 180."""
    return F.when(F.abs(lng) <= 180, lng).otherwise(F.pmod(lng + 180.0, F.lit(360.0)) - 180.0)


def _on_sphere(lat: Column, lng: Column) -> list[Column]:
    """A place as a point of the unit sphere; chords order places as distances do."""
    a, b = F.radians(lat), F.radians(lng)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def _least(cell: Column) -> Column:
    """No target of the cell has a smaller squared chord to the row's place, by the box around them."""
    gaps = [F.greatest(cell["low"][a] - F.col(a), F.col(a) - cell["high"][a], F.lit(0.0)) for a in AXES]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) * (1 - 1e-8) - 1e-15  # slack for rounding


def _reached(cell: Column) -> Column:
    """Squared chord to the target that stands for the cell; the nearest is no further."""
    steps = [cell["stand"][a] - F.col(a) for a in AXES]
    return sum((d * d for d in steps[1:]), steps[0] * steps[0])


def _score(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.struct(
        _least(c).alias("least"), _reached(c).alias("most"), c["_i"].alias("_i"), c["_j"].alias("_j")))


def _choose(cells: Column) -> Column:
    """The scored cells that may hold the nearest target."""
    best = F.array_min(F.transform(cells, lambda c: c["most"]))
    return let(best, lambda b: F.filter(cells, lambda c: c["least"] <= b))


def _tree(placed: DataFrame) -> DataFrame:
    """For each cell of each level above the finest the cells below it, at most 16 (level -1: the roots).

    A cell is the box around its targets and the one closest to its middle.
    """
    level = F.col("_level")
    up = F.lit(FAN) * (DEPTH - level)
    size = F.lit(ROOT) / F.pow(F.lit(2.0), F.lit(FAN) * level)
    off = F.abs(F.col("r_lat") - (F.col("_i") + 0.5) * size) + F.abs(F.col("r_lng") - (F.col("_j") + 0.5) * size)
    at = F.struct(*AXES)
    cells = (
        placed.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(DEPTH + 1)])))
        .withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), up)).cast("bigint") for c in ("_i", "_j")})
        .groupBy("_level", "_i", "_j").agg(
            F.struct(*[F.min(a).alias(a) for a in AXES]).alias("low"),
            F.struct(*[F.max(a).alias(a) for a in AXES]).alias("high"),
            F.min(F.struct(off.alias("off"), *AXES)).alias("stand")))
    above = {c: F.when(level > 0, F.shiftright(c, FAN)).otherwise(F.lit(0).cast("bigint")) for c in ("_i", "_j")}
    return (
        cells.withColumn("_kid", F.struct("low", "high", "stand", "_i", "_j")).withColumns(above)
        .groupBy((level - 1).alias("_level"), "_i", "_j").agg(F.collect_list("_kid").alias("_kids")))


def nearest(points: DataFrame, targets: DataFrame, earth: float = vocab.EARTH_MILES) -> DataFrame:
    """For each point the closest target; ties go to the lowest ``r_ord``.

    Points have ``point_id``, ``lat``, ``lng``; targets ``target``, ``r_lat``,
    ``r_lng``, ``r_ord``.  Rows without a place (a null, not a number, a
    latitude past a pole) are left out; without targets no row is returned.

    Targets form a tree of grid cells that know the box around their targets
    and one target in it.  A point goes down from the root cells: the target
    that stands for a cell bounds the distance from above, the boxes bound it
    from below, and only cells that may still hold the nearest go on to the
    next level.  So a point meets few cells wherever it lies, also across the
    date line and far from all targets, and only targets of its last cells.
    Targets at one place fold into the first of them.
    """
    points = points.where(F.col("lat").between(-90, 90) & ~F.isnan("lng") & (F.abs("lng") < math.inf))
    targets = targets.where(F.col("r_lat").between(-90, 90) & ~F.isnan("r_lng") & (F.abs("r_lng") < math.inf))
    size = ROOT / (1 << FAN * DEPTH)
    placed = (
        targets.groupBy("r_lat", "r_lng").agg(F.min(F.struct("r_ord", "target")).alias("_first"))
        .withColumns({"_i": _cell(F.col("r_lat"), size), "_j": _cell(_turned(F.col("r_lng")), size)}))
    tree = cut_lineage(_tree(placed.select("r_lat", "r_lng", "_i", "_j", *_on_sphere(F.col("r_lat"), F.col("r_lng")))))
    root = tree.where("_level = -1").select("_kids").scalar()
    place = ["point_id", "lat", "lng", *AXES]
    found = (
        points.select("point_id", "lat", "lng", *_on_sphere(F.col("lat"), F.col("lng")), root.alias("_kids"))
        .select(*place, let(_score(F.col("_kids")), _choose).alias("_cells")))

    def step(df: DataFrame) -> DataFrame:
        return df.select(*place, F.inline(F.transform(
            "_cells", lambda c: F.struct(c["_i"].alias("_i"), c["_j"].alias("_j")))))

    for level in range(DEPTH):
        kids = tree.where(F.col("_level") == level).drop("_level")
        met = step(found).join(kids, ["_i", "_j"]).select(
            *place, let(_score(F.col("_kids")), _choose).alias("_cells"))
        found = met.groupBy(*place).agg(F.flatten(F.collect_list("_cells")).alias("_cells")).withColumn(
            "_cells", _choose(F.col("_cells")))
    d = haversine(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"), earth)
    return (
        step(found).join(placed, ["_i", "_j"])
        .groupBy("point_id")
        .agg(F.min(F.struct(d.alias("distance"), "_first")).alias("_best"))
        .select("point_id", F.col("_best._first.target").alias("target"),
                F.col("_best.distance").alias("distance"))
    )
