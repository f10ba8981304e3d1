"""Cost rule, schools in radius, nearest search, order operators, roster."""

import random

import pytest
from pyspark.sql import functions as F

from gazetteer import vocab
from gazetteer.operators import dataset as D
from gazetteer.operators import order as O
from gazetteer.operators import spatial as S
from gazetteer.plans import inputs as I


@pytest.mark.parametrize("contract, area, tier, method, want", [
    ("91000A", "Cornerstone", None, None, ("unknown", "not-published", True)),
    ("X1", "Compass", None, None, ("free", "dycd-program-rules", True)),
    ("X1", "Compass", "paid", "gemini", ("free", "dycd-program-rules", True)),
    ("X1", "Beacon", "free", "gemini", ("free", "provider-website", True)),
    ("X1", "Cornerstone", "free", "keyword", ("unknown", "not-published", True)),
    ("X1", "Beacon", "unknown", "gemini", ("unknown", "not-published", True)),
    ("X1", "Beacon", "paid", "gemini", ("paid", "provider-website", True)),
    ("X1", "Beacon", "paid", None, ("paid", "provider-website", True)),
    ("NULL", None, None, None, ("unknown", "not-published", False)),
    (None, None, None, None, ("unknown", "not-published", False)),
])
def test_cost(one, contract, area, tier, method, want):
    c = one(D.derive_cost(*[F.lit(x).cast("string") for x in (contract, area, tier, method)]))
    assert (c["tier"], c["source"], c["publiclyFunded"]) == want


def schools(spark, rows):
    return spark.createDataFrame(rows, "dbn string, name string, lat double, lng double, serves_k5 boolean, _ord long")


def test_nearest_school_first_and_far_ones_out(spark):
    s = schools(spark, [("A", "A", 40.7, -73.9, False, 1), ("B", "B", 40.70005, -73.9, True, 2), ("C", "C", 40.8, -73.9, True, 3)])
    site = spark.createDataFrame([("x", 40.7, -73.9)], "id string, lat double, lng double")
    pairs = S.schools_within(site, s)
    assert [r["dbn"] for r in pairs.orderBy("distance_m", "school_ord").collect()] == ["A", "B"]
    assert S.pick_preferred(pairs).first()["dbn"] == "B"
    assert S.pick_preferred(pairs.where("dbn = 'A'")).first()["dbn"] == "A"
    assert S.pick_preferred(pairs.where("false")).count() == 0


def test_copies_of_the_cells_are_never_broadcast(spark):
    # Tables whose small size Spark knows.
    s = spark.sql("SELECT 'A' AS dbn, 'A' AS name, 40.7D + id AS lat, -73.9D + id AS lng, false AS serves_k5, id AS _ord FROM range(2)")
    site = spark.sql("SELECT 'x' AS id, 40.7D + id AS lat, -73.9D + id AS lng FROM range(1)")
    pairs = S.schools_within(site, s)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert [tuple(r) for r in pairs.select("id", "dbn", "distance_m").collect()] == [("x", "A", 0)]


def test_hosts_near_first_equal_all_pairs_and_make_few(spark, monkeypatch):
    rng = random.Random(5)
    sites = [(f"s{i}", 40.7 + rng.random() * 0.002, -73.9 + rng.random() * 0.002) for i in range(200)]
    sites += [(f"f{i}", 41 + i / 1000, -73.9) for i in range(9)] + [("null", None, -73.9), ("alone", 42.0, -73.9)]
    # Dense schools with equal distances, then single ones further out, some of which serve.
    near = [(f"d{i}", "n", 40.7 + rng.randrange(200) * 1e-5, -73.9 + rng.randrange(200) * 1e-5, i % 3 == 0, i) for i in range(900)]
    near += [(f"e{i}{j}", "n", 41 + i / 1000 + j * m / 111195, -73.9, j == 2 and i % 3 > 0, 2000 + i * 9 + j)
             for i in range(9) for j, m in ((1, 10), (2, 14.4 + i / 10), (3, 40))]
    left = spark.createDataFrame(sites, "id string, lat double, lng double")
    right = schools(spark, near)
    pairs = S.schools_within(left, right)
    want, all_pairs = sorted(map(tuple, S.pick_preferred(pairs).collect())), pairs.count()
    assert len(want) == 209
    made, pick = [], S.pick_preferred
    monkeypatch.setattr(S, "pick_preferred", lambda p, *a: (made.append(p.count()), pick(p, *a))[1])
    assert sorted(map(tuple, S.preferred_schools(left, right).collect())) == want
    assert sum(made) * 5 < all_pairs


def test_few_pairs_are_made_where_schools_lie_very_dense(spark, monkeypatch):
    rng = random.Random(6)
    place = lambda: (40.7 + rng.random() * 0.0006, -73.9 + rng.random() * 0.0006)
    left = spark.createDataFrame([(f"s{i}", *place()) for i in range(60)] + [("alone", 42.0, -73.9), ("one", 43.0, -73.9)], "id string, lat double, lng double")
    right = schools(spark, [(f"d{i}", "n", *place(), i % 2 == 0, i) for i in range(3000)] + [("o", "n", 43.00001, -73.9, True, 9000)])
    pairs = S.schools_within(left, right)
    want, all_pairs = sorted(map(tuple, S.pick_preferred(pairs).collect())), pairs.count()
    assert [(r[0], r[-1]) for r in want if r[0] == "one"] == [("one", False)] and all(r[-1] for r in want if r[0] != "one")
    made, pick = [], S.pick_preferred
    monkeypatch.setattr(S, "pick_preferred", lambda p, *a: (made.append(p.count()), pick(p, *a))[1])
    assert sorted(map(tuple, S.preferred_schools(left, right).collect())) == want
    assert 0 < sum(made) * 20 < all_pairs


@pytest.mark.parametrize("earth", [vocab.EARTH_M, vocab.EARTH_MILES])
def test_either_side_may_be_copied(spark, earth):
    rng = random.Random(7)
    for lat0, lng0, wide in ((40.7, -73.9, 0.004), (-0.001, 179.999, 0.004), (89.9985, 10.0, 90.0)):
        place = lambda: (lat0 + rng.random() * 0.0015, (lng0 + rng.random() * wide + 180) % 360 - 180)  # noqa: B023, E731
        left = spark.createDataFrame([(i, *place()) for i in range(80)] + [(99, None, 1.0)], "id int, lat double, lng double")
        right = spark.createDataFrame([(i, *place()) for i in range(90)] + [(99, 1.0, None)], "r_id int, r_lat double, r_lng double")
        one, two = [S.within(left, right, 120, earth, copy_left=c) for c in (False, True)]
        every = left.crossJoin(right).withColumn("distance", S.haversine(*[F.col(c) for c in ("lat", "lng", "r_lat", "r_lng")], earth))
        limit = 120 if earth == vocab.EARTH_M else 120 / S.METRES_PER_MILE
        want = sorted(map(tuple, every.where(F.col("distance") <= limit).collect()))
        assert one.columns == two.columns == every.columns
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == want and want


@pytest.mark.parametrize("partitions", [1, 16])
def test_grid_equals_all_pairs(spark, partitions):
    rng = random.Random(2)
    # One cell holds a third of the sites.
    sites = [(f"s{i}", 40.7 + rng.random() * (0.0005 if i % 3 == 0 else 0.02), -73.9 + rng.random() * 0.02) for i in range(300)]
    near = [(f"d{i}", "n", 40.7 + rng.random() * 0.02, -73.9 + rng.random() * 0.02, True, i) for i in range(150)]
    left = spark.createDataFrame(sites, "id string, lat double, lng double").repartition(partitions)
    right = schools(spark, near).repartition(partitions)
    got = S.schools_within(left, right).select("id", "dbn", "distance_m").collect()
    import math

    def metres(a, b, c, e):
        r = math.radians
        h = math.sin(r(c - a) / 2) ** 2 + math.cos(r(a)) * math.cos(r(c)) * math.sin(r(e - b) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {(i, n[0]) for i, a, b in sites for n in near if metres(a, b, n[2], n[3]) <= 120}
    assert {(r["id"], r["dbn"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("lat0, lng0", [(40.7, -73.9), (-0.001, 179.999), (89.9985, 10.0)])
def test_school_lists_equal_all_pairs(spark, lat0, lng0):
    rng = random.Random(5)
    wide = 0.004 if lat0 < 80 else 90.0
    place = lambda: (lat0 + rng.random() * 0.0015, (lng0 + rng.random() * wide + 180) % 360 - 180)
    left = spark.createDataFrame([(str(i), *place()) for i in range(60)] + [("no", None, None)], "id string, lat double, lng double")
    right = schools(spark, [(f"D{i}", f"S{i}", *place(), i % 3 == 0, i) for i in range(200)] + [("null", "n", None, 1.0, True, 999)])
    pairs = S.schools_within(left, right).orderBy("distance_m", "school_ord").collect()
    want = {str(i): [] for i in range(60)} | {"no": []}
    for r in pairs:
        want[r["id"]].append((r["dbn"], r["school_name"], r["distance_m"], r["serves_k5"]))
    got = {r["id"]: [tuple(x) for x in r["co"] or []] for r in S.with_schools(left, right, "co").collect()}
    assert got == want and pairs


def test_school_lists_are_not_shuffled(spark):
    """The lists of co-located schools are made by the last join, and by none where nobody reads them."""
    programs = I.programs(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    above, below = plan(programs).split("collect_list", 1)
    assert "Exchange hash" not in above.split("collect_list", 1)[0].split("SortMergeJoin")[0]
    assert "collect_list(struct(lat" in plan(programs)
    assert "collect_list(struct(lat" not in plan(programs.select("id", "cost", "enrichment", "inSchoolBuilding"))


def test_counts_make_no_lists(spark):
    """Whether a campus is shared is known from the search for the host."""
    d = "/root/testdata/sf0.001"
    programs = I.programs(spark, d)
    counts = D.dataset_counts(programs, I.schools(spark, d), I.zips(spark, d))
    assert "collect_list(struct(lat" not in counts._jdf.queryExecution().executedPlan().toString()
    lists = programs.select("_shared", F.size("coLocatedSchools").alias("n")).collect()
    assert all(r["_shared"] == (r["n"] > 1) for r in lists) and {r["_shared"] for r in lists} == {True, False}


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(4)
    points = [(i, 40 + rng.random() * 5, -75 + rng.random() * 5) for i in range(60)] + [(60, 10.0, 20.0), (61, -33.0, 151.0)]
    targets = [(f"t{i}", 40 + rng.random() ** 4 * 3, -75 + rng.random() ** 4 * 3, i) for i in range(80)]
    got = S.nearest(
        spark.createDataFrame(points, "point_id int, lat double, lng double"),
        spark.createDataFrame(targets, "target string, r_lat double, r_lng double, r_ord int")).collect()
    import math

    def dist(p, t):
        r = math.radians
        h = math.sin(r(t[1] - p[1]) / 2) ** 2 + math.cos(r(p[1])) * math.cos(r(t[1])) * math.sin(r(t[2] - p[2]) / 2) ** 2
        return 2 * 3958.8 * math.asin(min(1, math.sqrt(h)))

    want = {p[0]: min(targets, key=lambda t: (dist(p, t), t[3]))[0] for p in points}
    assert {r["point_id"]: r["target"] for r in got} == want


def test_nearest_around_the_globe_and_odd_rows(spark):
    import math

    rng = random.Random(9)
    spots = [(0.0, 179.99), (0.0, -179.99), (89.9, 10.0), (-89.9, -120.0), (40.7, -74.0), (-33.9, 151.2)]

    def near(n, wide):
        out = []
        for _ in range(n):
            a, b = rng.choice(spots)
            out.append((max(-90.0, min(90.0, a + rng.gauss(0, wide))), (b + rng.gauss(0, wide) + 180) % 360 - 180))
        return out

    places = near(300, 0.3) + [(40.7, -74.0)] * 3 + [(0.0, 0.0)]
    asked = near(150, 1.0) + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [
        (90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (40.7, -74.0)]
    targets = [(f"t{i}", a, b, i) for i, (a, b) in enumerate(places)]
    points = [(i, a, b) for i, (a, b) in enumerate(asked)]
    odd = [(9001, None, 1.0), (9002, 1.0, None), (9003, float("nan"), 1.0), (9004, 91.0, 1.0), (None, 40.7, -74.0)]
    got = S.nearest(
        spark.createDataFrame(points + odd, "point_id int, lat double, lng double"),
        spark.createDataFrame(targets + [("x", None, None, 0), ("y", 1.0, float("inf"), 0)],
                              "target string, r_lat double, r_lng double, r_ord int")).collect()

    def dist(p, t):
        r = math.radians
        h = math.sin(r(t[1] - p[1]) / 2) ** 2 + math.cos(r(p[1])) * math.cos(r(t[1])) * math.sin(r(t[2] - p[2]) / 2) ** 2
        return 2 * 3958.8 * math.asin(min(1, math.sqrt(h)))

    by = {r["point_id"]: r for r in got}
    assert len(got) == len(by) and set(by) == {p[0] for p in points} | {None}
    for p in points:
        best = min(dist(p, t) for t in targets)
        assert abs(by[p[0]]["distance"] - best) < 1e-6
    assert by[points[-1][0]]["target"] == by[None]["target"] == min(
        (t for t in targets if t[1:3] == (40.7, -74.0)), key=lambda t: t[3])[0]


def test_nearest_without_targets_or_points(spark):
    points = spark.createDataFrame([(1, 40.1, -74.0)], "point_id int, lat double, lng double")
    targets = spark.createDataFrame([("a", 40.0, -74.0, 2)], "target string, r_lat double, r_lng double, r_ord int")
    assert S.nearest(points, targets.limit(0)).count() == 0
    assert S.nearest(points.limit(0), targets).count() == 0


def test_nearest_keeps_the_first_of_equals(spark):
    t = [("b", 40.0, -74.0, 2), ("a", 40.0, -74.0, 1)]
    got = S.nearest(spark.createDataFrame([(1, 40.1, -74.0)], "point_id int, lat double, lng double"),
                    spark.createDataFrame(t, "target string, r_lat double, r_lng double, r_ord int")).first()
    assert got["target"] == "a"


def test_ranks_across_buckets(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 5)}", o, rng.randint(0, 9)) for o in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): (r["rank"], r["running"]) for r in O.running_sum(
        O.exact_rank(df, ["k"], "o", "rank", 50), ["k"], "o", F.col("v"), "running", 50).collect()}
    want, seen = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        n, s = seen.get(k, (0, 0))
        seen[k] = want[(k, o)] = (n + 1, s + v)
    assert got == want
    ranks = sorted(r["rank"] for r in O.global_rank(df, "o", "rank", 64).collect())
    assert ranks == list(range(1, len(rows) + 1))


def test_rows_past_the_cap_get_a_reason(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 9), (None, 8), ("b", 1)], "k string, o int")
    got = {(r["k"], r["o"]): r["reason"] for r in O.cap_per_group(df, ["k"], [F.col("o")], 1, "over").collect()}
    assert got == {("a", 1): None, ("a", 2): "over", ("a", 3): "over", (None, 8): None, (None, 9): "over", ("b", 1): None}


def test_roster_and_prior(spark):
    sites = spark.createDataFrame(
        [(" Zed Inc ", "B"), ("Zed Inc", "A"), ("alpha", None), ("Beta", "Q"), ("  ", "X"), (None, "X")], "provider string, borough string")
    r = D.in_roster_order(D.roster(sites)).collect()
    assert [(x["provider"], x["site_count"], x["boroughs"]) for x in r] == [
        ("Zed Inc", 2, ["A", "B"]), ("alpha", 1, []), ("Beta", 1, ["Q"])]
    prior = spark.createDataFrame([("Zed Inc", "old", 1), ("Zed Inc", "new", 2)], "provider string, website string, _ord int")
    merged = {x["provider"]: x["website"] for x in D.merge_prior(D.roster(sites), prior, ["website"]).collect()}
    assert merged == {"Zed Inc": "new", "alpha": None, "Beta": None}


def test_small_top_k_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id")
    plan = O.top_per(df, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_global_rank_of_hashed_and_crowded_numbers(spark):
    rng = random.Random(2)
    for numbers in ([rng.randrange(-2**62, 2**62) for _ in range(500)], [*range(480), *[10**15 + i for i in range(20)]], []):
        df = spark.createDataFrame([(n,) for n in numbers], "o long").repartition(3)
        got = {r["o"]: r["rank"] for r in O.global_rank(df, "o", "rank", 64).collect()}
        assert got == {n: i + 1 for i, n in enumerate(sorted(numbers))}
        if numbers:
            sizes = df.repartitionByRange(8, "o").groupBy(F.spark_partition_id()).count().collect()
            assert max(r["count"] for r in sizes) < 200
