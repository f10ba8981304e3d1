"""Nothing is cut: long names, large groups, high latitudes, the date line, one call per request."""

import math
import random

from pyspark.sql import functions as F

from gazetteer.functions import text as T
from gazetteer.operators import cache as C
from gazetteer.operators.images import collapse_groups
from gazetteer.operators.spatial import within
from gazetteer import vocab


def test_long_names_stay_whole(one):
    assert one(T.label(F.lit("a" + "b" * 3000))) == "A" + "b" * 3000
    assert one(T.tidy_org(F.lit("HELLO " + "B" * 3000))) == "Hello B" + "b" * 2999


def test_group_of_any_size_collapses_to_one(spark):
    photos = [(f"u{i}", "program-photo", True, 5, 100 + i, 100) for i in range(1500)]
    df = spark.createDataFrame(
        [("org", photos, [[float(i + 1) for i in range(1500)]])],
        "provider string, images array<struct<url:string,kind:string,carousel_ready:boolean,suitability:bigint,width:bigint,height:bigint>>,"
        " groups array<array<double>>")
    assert collapse_groups(df).count() == 1499


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    s = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * vocab.EARTH_M * math.asin(min(1, math.sqrt(s)))


def test_pairs_at_any_latitude_and_across_the_date_line(spark):
    g = random.Random(4)
    points = [(75 + g.random() * 0.004, g.random() * 0.02) for _ in range(60)]
    points += [(g.random() * 0.004, (180 - g.random() * 0.002) * g.choice([-1, 1])) for _ in range(60)]
    points += [(89.9995 + g.random() * 0.0005, g.uniform(-180, 180)) for _ in range(30)]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    left = spark.createDataFrame(rows, "id long, lat double, lng double")
    right = spark.createDataFrame(rows, "r_id long, r_lat double, r_lng double")
    got = sorted((r["id"], r["r_id"]) for r in within(left, right, 120).collect())
    want = sorted((i, j) for i, a in enumerate(points) for j, b in enumerate(points) if distance(a, b) <= 120)
    assert got == want and len(want) > 400


def test_scorer_is_called_once_within_the_budget(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch[["key"]].assign(answer="yes")

    todo = spark.range(20).selectExpr("id AS _ord", "id AS thing")
    stored = spark.createDataFrame([], "key string, stored_at long, answer string")
    answers, entries = C.score(todo, fn, "key string, answer string", stored, ["thing"], lambda c: F.col("answer") == "yes", max_calls=5)
    assert answers.count() == 5 and entries.count() == 5 and calls.value == 5
    assert sorted(r["_ord"] for r in answers.collect()) == [0, 1, 2, 3, 4]
