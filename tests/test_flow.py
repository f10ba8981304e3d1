"""Sources, replies, cache, budget, limits, streams."""

import datetime
import json
import random

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from gazetteer.functions.replies import recover_json, reply_text
from gazetteer.functions.values import is_definitive
from gazetteer.operators import cache as C
from gazetteer.sources import files as S
from gazetteer.sources.paged import read_paged
from gazetteer.streaming import rate as R
from gazetteer.streaming.refresh import current_facts, refresh, refresh_batch


def step(*texts, kind="model_output"):
    return {"type": kind, "content": [{"type": "text", "text": t} for t in texts]}


@pytest.mark.parametrize("reply, want", [
    ({"steps": [{"type": "thought", "signature": "s"}, step('{"ok": true}')]}, '{"ok": true}'),
    ({"steps": [{"type": "thought"}]}, None),
    ({"steps": [step('{"a":', "1}")]}, '{"a":1}'),
    ({"steps": [{"type": "model_output", "content": [{"type": "image", "data": "x"}, {"type": "text", "text": "hi"}]}]}, "hi"),
    ({"steps": [step("first"), {"type": "thought"}, step("last")]}, "last"),
    ({"interaction": {"output_text": "a"}}, "a"),
    ({"output_text": "b"}, "b"),
    ({"candidates": [{"content": {"parts": [{"text": "c"}]}}]}, "c"),
    ({"unexpected": True}, None),
    (None, None),
])
def test_reply_shapes(one, reply, want):
    assert one(reply_text(F.lit(json.dumps(reply)))) == want


@pytest.mark.parametrize("text, want", [
    ('{"ok": true}', '{"ok":true}'), ('```json\n{"ok": true}\n```', '{"ok":true}'),
    ("Here: [1, 2] as asked", "[1,2]"), ("I can not help.", None), ("{broken", None),
])
def test_recovered_json(one, text, want):
    assert one(F.to_json(recover_json(F.lit(text)))) == want


def final(df):
    return is_definitive(F.col("ok"), F.col("status"), F.lit(None).cast("string"))


def enrich(spark, cached, status):
    """One request against a cache of (ok, status) entries; the service answers ``status``."""
    todo = spark.createDataFrame([("u",), ("u",)], "url string")
    key = todo.select(C.cache_key(["url"]).alias("key")).first()["key"]
    cache = spark.createDataFrame([(key, i, ok, s) for i, (ok, s) in enumerate(cached)], "key string, stored_at long, ok boolean, status int")
    return C.cached_enrich(
        todo, cache, ["url"],
        lambda m: m.withColumns({"ok": F.lit(status == 200), "status": F.lit(status)}), final)


def test_transient_answers_are_not_stored(spark):
    answers, stored = enrich(spark, [], 503)
    assert answers.count() == 2 and stored.count() == 0


def test_final_answers_are_stored_once_and_served(spark):
    answers, stored = enrich(spark, [], 200)
    assert answers.count() == 2 and stored.count() == 1
    answers, stored = enrich(spark, [(True, 200)], 404)
    assert {(r["status"], r["from_cache"]) for r in answers.collect()} == {(200, True)} and stored.count() == 0


def test_entries_of_a_looser_rule_count_as_misses(spark):
    answers, stored = enrich(spark, [(False, 500)], 200)
    assert {(r["status"], r["from_cache"]) for r in answers.collect()} == {(200, False)} and stored.count() == 1


def test_budget_leaves_the_rest(spark):
    todo = spark.range(40).withColumnRenamed("id", "_ord")
    got = {r["_ord"]: r["slot"] for r in C.apply_budget(todo, max_calls=30, per_minute=12).collect()}
    assert got == {i: (i // 12 if i < 30 else None) for i in range(40)}


def test_scorer_runs_on_misses_within_the_budget(spark):
    def fn(batches):
        for b in batches:
            yield b[["key"]].assign(points=b["v"] * 2)

    todo = spark.createDataFrame([(i, i // 2) for i in range(10)], "_ord int, v int")
    key = todo.where("v = 0").select(C.cache_key(["v"]).alias("key")).first()["key"]
    cache = spark.createDataFrame([(key, 1, 99)], "key string, stored_at long, points long")
    answers, stored = C.score(todo, fn, "key string, points long", cache, ["v"], lambda d: F.col("points") >= 0, max_calls=2)
    assert sorted((r["v"], r["points"]) for r in answers.collect()) == [(0, 99), (0, 99), (1, 2), (1, 2), (2, 4), (2, 4)]
    assert stored.count() == 2


# --- limits -------------------------------------------------------------------

def requests(seed=1, n=400, pause=True):
    rng = random.Random(seed)
    rows, t = [], {0: 0, 1: 0, 2: 0}
    for i in range(n):
        c = rng.choice([0, 0, 1, 2])
        t[c] += rng.choice([0, 0, 0, 1, 2, 9] + ([75] if pause else []))
        rows.append((i, c, t[c]))
    # A flood at one instant.
    return rows + [(n + i, 0, 1000) for i in range(30)]


def walked(rows):
    out, times = {}, {}
    for e, c, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        recent = [x for x in times.get(c, []) if t - x < 60]
        ok = len(recent) < 12
        out[e] = (ok, None if ok else max(1, 60 - (t - recent[0])))
        times[c] = [*recent, t] if ok else recent
    return out


@pytest.mark.parametrize("partitions", [1, 16])
@pytest.mark.parametrize("pause", [True, False])
def test_sliding_equals_the_walk(spark, partitions, pause):
    rows = requests(pause=pause)
    df = spark.createDataFrame(rows, "event_id long, client long, at_s long").repartition(partitions)
    got = {r["event_id"]: (r["allowed"], r["retry_after_s"]) for r in R.rate_sliding(df).collect()}
    assert got == walked(rows)


@pytest.mark.parametrize("windows", [1, 3])
def test_one_client_without_a_pause_is_walked_in_chunks(spark, windows):
    rng = random.Random(7)
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([0, 1, 2, 2, 3, 20])
        rows.append((i, "only", t))
    df = spark.createDataFrame(rows, "event_id long, client string, at_s long").repartition(8)
    judged = R.rate_sliding(df, windows_a_chunk=windows)
    got = {r["event_id"]: (r["allowed"], r["retry_after_s"]) for r in judged.collect()}
    assert got == walked(rows)
    assert t // 60 // windows > 5  # it was cut


def test_fixed_counts_rejected_ones(spark):
    rows = [(i, 1, i * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, client long, at_s long")
    got = {r["event_id"]: (r["allowed"], r["retry_after_s"]) for r in R.rate_fixed(df).collect()}
    assert all(got[i][0] == (i % 30 < 12) for i in range(40))
    assert got[12] == (False, 36) and got[29] == (False, 2)


def streamed(spark, folder, parts, schema, **kwargs):
    """Feed the parts one after the other, as files that arrive between two runs of one query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKS)
    rows = []
    try:
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            query = (
                R.rate_sliding_stream(stream, **kwargs).writeStream.outputMode("append")
                .foreachBatch(lambda df, _: rows.extend(df.collect()))
                .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return rows


def at(second):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=second)


def test_sliding_stream_equals_batch(spark, tmp_path):
    rows = sorted(requests(3, 120), key=lambda r: r[2])
    parts = [[(f"c{c}", at(t), e) for e, c, t in rows if lo <= t < hi] for lo, hi in ((0, 200), (200, 400), (400, 10**6))]
    got = streamed(spark, tmp_path, parts, "client string, at timestamp, event_id long", late="0 seconds")
    assert {r["event_id"]: (r["allowed"], r["retry_after_s"]) for r in got} == walked(rows)
    assert {r["client"] for r in got} == {"c0", "c1", "c2"}


def test_alerts_equal_batch_after_three_batches_and_a_replay(spark, tmp_path):
    rng, schema, out = random.Random(5), "client string, ts timestamp", str(tmp_path / "out")
    rows = [(f"c{rng.randrange(3)}", at(i * 2)) for i in range(600)]
    told = []
    for low in (0, 200, 400):
        spark.createDataFrame(rows[low:low + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        R.write_alerts(R.over_limit(stream, limit=9), out).awaitTermination()
        told.append({tuple(r) for r in R.current_alerts(spark, out).collect()})
    counts = {}
    for c, t in rows:
        counts[c, t.replace(second=0)] = counts.get((c, t.replace(second=0)), 0) + 1
    want = {(c, m, n) for (c, m), n in counts.items() if n > 9}
    assert told[2] == want and told[0] and not told[0] - {(c, m, n) for c, m, n in want | told[0]}
    batches = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "alerts").glob("batch=*"))
    assert len(batches) >= 3
    first = spark.read.parquet(f"{out}/alerts/batch={batches[0]}")
    again = spark.createDataFrame(first.collect(), first.schema)
    R.store_alerts(again, batches[0], out)  # the first batch is told once more
    assert {tuple(r) for r in R.current_alerts(spark, out).collect()} == want


def test_late_requests_and_other_names(spark, tmp_path):
    schema = "who long, seen timestamp, n int"
    first = [(5, at(100), i) for i in range(3)]
    # Behind the newest but not behind the watermark: judged as if it came at second 100.
    second = [(5, at(70), 3), (6, at(300), 4)]
    third = [(5, at(90), 5), (6, at(301), 6)]  # second 90 is behind the watermark now
    got = streamed(spark, tmp_path, [first, second, third], schema, client="who", at="seen", order="n", limit=3)
    assert {r["n"]: (r["allowed"], r["retry_after_s"]) for r in got} == {
        0: (True, None), 1: (True, None), 2: (True, None), 3: (False, 60), 4: (True, None), 6: (True, None)}


def test_refresh_redoes_changed_organisations_only(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "provider string, url string, text string, _ord long"
    facts = "provider string, pages long, words string"

    def extract(pages):
        return pages.groupBy("provider").agg(
            F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_list("text")), " ").alias("words"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        refresh(stream, out, extract, facts).awaitTermination()
        return {r["provider"]: (r["pages"], r["words"]) for r in current_facts(spark, out, facts).collect()}

    assert arrive([("a", "u1", "x", 1), ("a", "u2", "y", 2), ("b", "u3", "z", 3)]) == {"a": (2, "x y"), "b": (1, "z")}
    assert arrive([("a", "u1", "new", 4), ("b", "u3", "z", 5)]) == {"a": (2, "new y"), "b": (1, "z")}
    redone = spark.read.parquet(f"{out}/facts").where("epoch = 1").select("provider").collect()
    assert [r["provider"] for r in redone] == ["a"]


def test_refresh_reads_only_touched_buckets_and_survives_a_broken_batch(spark, tmp_path):
    out, facts = str(tmp_path / "out"), "provider string, words string"

    def extract(pages):
        return pages.where("text <> 'none'").groupBy("provider").agg(
            F.array_join(F.array_sort(F.collect_list("text")), " ").alias("words"))

    def batch(epoch, rows):
        df = spark.createDataFrame(rows, "provider string, url string, text string, _ord long")
        refresh_batch(df, epoch, out, extract, facts, buckets=4)

    def now():
        return {r["provider"]: r["words"] for r in current_facts(spark, out, facts).collect()}

    assert now() == {}
    names = [f"p{i}" for i in range(12)]
    batch(0, [(p, "u", "x", i) for i, p in enumerate(names)] + [(None, "u", "x", 1), ("p1", None, "x", 1), ("p0", "v", None, 1)])
    assert now() == {p: "x" for p in names}
    batch(1, [])
    batch(2, [("p3", "u", "old", 1), ("p3", "u", "new", 2), ("p4", "u", "x", 9)])
    assert now() == {p: "new" if p == "p3" else "x" for p in names}
    # Only the bucket of p3 was written again, and with it nothing of other buckets.
    assert len(list((tmp_path / "out" / "current" / "epoch=2").glob("bucket=*"))) == 1
    # A batch that breaks before its index is written changes nothing; repeated, it counts once.
    with pytest.raises(ZeroDivisionError):
        refresh_batch(spark.createDataFrame([("p5", "u", "y", 1)], "provider string, url string, text string, _ord long"),
                      3, out, lambda p: 1 / 0, facts, buckets=4)
    assert now()["p5"] == "x"
    batch(3, [("p5", "u", "y", 1), ("p6", "u", "none", 1)])
    batch(3, [("p5", "u", "y", 1), ("p6", "u", "none", 1)])
    assert now()["p5"] == "y" and "p6" not in now() and len(now()) == 11


# --- sources ------------------------------------------------------------------

def test_paged_reads_until_a_short_page(spark):
    for total in (0, 7, 20):
        def fetch(offset, limit, total=total):
            return [{"a": i, "b": None} for i in range(offset, min(offset + limit, total))]

        rows = read_paged(spark, fetch, ["a", "b"], page_size=5, lanes=3).orderBy("_ord").collect()
        assert [(r["_ord"], r["a"], r["b"]) for r in rows] == [(i, str(i), None) for i in range(total)]


def test_only_a_missing_input_is_empty(spark, tmp_path):
    assert S.read_or_empty(spark, str(tmp_path / "none"), "a string").count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.parquet").write_text("not parquet")
    with pytest.raises((AnalysisException, PySparkException, Exception)):
        S.read_or_empty(spark, str(bad), "a string").count()


def test_snapshots_and_config(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('[{"a": "1", "b": "x"},\n {"a": "2"}]')
    assert [tuple(r) for r in S.read_snapshot(spark, str(path), "a string, b string").collect()] == [("1", "x"), ("2", None)]
    config = tmp_path / "c.json"
    config.write_text('{"_comment": ["no"],\n "Org": ["a.org", "b.org"]}')
    assert [tuple(r) for r in S.read_text_config(spark, str(config), "array<string>").collect()] == [("Org", ["a.org", "b.org"])]


def test_only_whole_datasets_are_read(spark, tmp_path):
    path, meta = str(tmp_path / "set"), spark.range(1).select(F.lit("x").alias("note"))
    small, large = spark.range(3), spark.range(5)
    broken = large.select(F.raise_error(F.lit("cut off")).cast("long").alias("id"))
    with pytest.raises(Exception, match="cut off"):
        S.write_dataset({"programs": small, "zips": broken}, path, "v1", meta)
    with pytest.raises(AnalysisException):  # nothing was ever whole
        S.read_dataset(spark, path, "v1", ["programs"])
    S.write_dataset({"programs": small, "zips": small}, path, "v1", meta)
    old, = S.read_dataset(spark, path, "v1", ["programs"])
    with pytest.raises(Exception, match="cut off"):
        S.write_dataset({"programs": large, "zips": broken}, path, "v1", meta)
    assert [t.count() for t in S.read_dataset(spark, path, "v1", ["programs", "zips"])] == [3, 3]
    S.write_dataset({"programs": large, "zips": large}, path, "v1", meta)
    assert [t.count() for t in S.read_dataset(spark, path, "v1", ["programs", "zips"])] == [5, 5]
    assert old.count() == 3 and S.read_meta(spark, path, "v1").first()["note"] == "x"


def test_a_stage_runs_twice_alike(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "_ord")
    once = S.run_stage(lambda x: x.selectExpr("_ord * 2 AS v"), [df], str(tmp_path / "o"), limit=5).collect()
    twice = S.run_stage(lambda x: x.selectExpr("_ord * 2 AS v"), [df], str(tmp_path / "o"), limit=5).collect()
    assert sorted(once) == sorted(twice) and len(once) == 5


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = S.source_slice(df, ["o_orderkey"], "o_orderstatus = 'F'", [F.col("o_orderkey")])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "o_totalprice" not in plan


def test_tables_made_from_others_read_what_was_written(spark, tmp_path):
    path, rows = str(tmp_path / "made"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    programs = spark.range(50).mapInArrow(seen, "id long")
    S.write_dataset(
        {"programs": programs, "zips": lambda t: t["programs"].selectExpr("id % 5 AS zip").distinct()}, path, "v1",
        lambda t: t["programs"].crossJoin(t["zips"].selectExpr("count(*) AS zips")).groupBy("zips").count())
    assert rows.value == 50  # computed once
    assert S.read_meta(spark, path, "v1").select("zips", "count").first()[:] == (5, 50)
    assert [df.count() for df in S.read_dataset(spark, path, "v1", ["programs", "zips"])] == [50, 5]
