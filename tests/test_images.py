"""Image headers, screening, copies, groups, photo choice."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gazetteer.operators import assign as A
from gazetteer.operators import images as M
from gazetteer.operators.dataset import photo_rank
from gazetteer.sources.images import frame_sizes, image_inventory, read_image_files

PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR"


def jpeg(w, h, app0=True):
    head = b"\xff\xd8" + (b"\xff\xe0\x00\x10JFIF\x00" + bytes(9) if app0 else b"")
    return head + b"\xff\xc0\x00\x08\x08" + struct.pack(">HH", h, w) + bytes(18)


HEADERS = [
    (PNG + struct.pack(">II", 800, 600), (800, 600, "image/png")),
    (b"GIF89a" + struct.pack("<HH", 120, 90) + bytes(14), (120, 90, "image/gif")),
    (jpeg(1024, 768), (1024, 768, "image/jpeg")),
    (jpeg(640, 480, False), (640, 480, "image/jpeg")),
    (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (1599).to_bytes(3, "little") + (1199).to_bytes(3, "little") + bytes(2), (1600, 1200, "image/webp")),
    (b"RIFF\0\0\0\0WEBPVP8L" + bytes(16), (0, 0, "image/webp")),
    (bytes(8), None), (b"<!DOCTYPE html>" + b" " * 40, None), (jpeg(800, 600)[:12], None), (None, None),
]


def test_headers(spark):
    files = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _) in enumerate(HEADERS)], "path int, content binary")
    got = {r["path"]: (r["width"], r["height"], r["mime"]) for r in image_inventory(files).collect()}
    assert [got[i] for i in range(len(HEADERS))] == [want or (None, None, None) for _, want in HEADERS]


def test_frames_of_many_files_at_once():
    """Each file alone and all together, with padding, long segments, false frames and cut files."""
    rng = random.Random(8)
    bodies, want = [], []
    for _ in range(200):
        body = b"\xff\xd8"
        for _ in range(rng.randrange(5)):
            size = rng.randrange(2, 400)
            body += bytes([0xFF, rng.choice([0xE0, 0xE1, 0xC4, 0xC8, 0xCC, 0xDB])]) + struct.pack(">H", size) + rng.randbytes(size - 2)
            body += bytes(rng.randrange(3))
        w, h = rng.randrange(1, 5000), rng.randrange(1, 5000)
        whole = rng.random() < 0.8
        body += b"\xff\xc2\x00\x11\x08" + struct.pack(">HH", h, w) + bytes(12) if whole else b""
        bodies.append(body)
        want.append((w, h) if whole else (0, 0))
    bodies += [b"", None, b"\xff\xd8", b"\xff" * 50]
    together = list(zip(*(x.tolist() for x in frame_sizes(pa.array(bodies, pa.binary()))), strict=True))
    assert together[:200] == want and together[200:203] == [(0, 0)] * 3
    for body, size in zip(bodies, together, strict=True):
        assert [x.tolist()[0] for x in frame_sizes(pa.array([body], pa.binary()))] == list(size)


def test_inventory_of_files_spark_lists(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.jpg").write_bytes(jpeg(30, 40))
    (tmp_path / "deep" / "b.png").write_bytes(PNG + struct.pack(">II", 7, 9))
    (tmp_path / "deep" / "c.txt").write_bytes(b"no image at all, only words here")
    rows = image_inventory(read_image_files(spark, str(tmp_path))).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["width"], r["height"], r["mime"]) for r in rows) == [
        ("a.jpg", 30, 40, "image/jpeg"), ("b.png", 7, 9, "image/png"), ("c.txt", None, None, None)]


def test_inventory_keeps_unreadable_files(spark):
    files = spark.createDataFrame([("a", bytearray(jpeg(10, 20))), ("b", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: (r["width"], r["height"], r["mime"], r["bytes"]) for r in image_inventory(files).collect()}
    assert got == {"a": (10, 20, "image/jpeg", len(jpeg(10, 20))), "b": (None, None, None, 1)}


@pytest.mark.parametrize("w, h, mime, size, reason, ready", [
    (1920, 1080, "image/jpeg", 5e5, None, True), (10800, 10800, "image/jpeg", 5e5, "too-large", None),
    (6016, 4016, "image/jpeg", 5e5, "too-large", None), (4000, 2000, "image/jpeg", 5e5, None, True),
    (4000, 3200, "image/jpeg", 5e5, "too-many-pixels", None), (4000, 3000, "image/jpeg", 5e5, None, True),
    (4000, 3001, "image/jpeg", 5e5, "too-many-pixels", None), (1600, 1200, "image/jpeg", 2e7, "too-heavy", None),
    (100, 100, "image/jpeg", 4e3, "too-small", None), (3000, 400, "image/jpeg", 5e5, "aspect", None),
    (400, 3000, "image/jpeg", 5e5, "aspect", None), (1200, 800, "image/gif", 5e5, "mime", None),
    (None, None, None, 5e5, "unparseable", None), (800, 450, "image/jpeg", 5e5, None, False),
    (800, 1200, "image/jpeg", 5e5, None, False),
])
def test_screening(spark, w, h, mime, size, reason, ready):
    df = spark.createDataFrame([(w, h, mime, int(size))], "width long, height long, mime string, bytes long")
    r = M.screen_images(df).first()
    assert (r["reason"], r["carousel_ready"]) == (reason, ready)


def sequential_copies(rows):
    out, by_bytes, by_key = {}, {}, {}
    for o, w, h, d, k in sorted(rows, key=lambda r: (-r[1] * r[2], r[0])):
        if d in by_bytes:
            out[o] = ("duplicate-file", by_bytes[d])
        elif k in by_key:
            out[o] = ("resized-copy", by_key[k])
        else:
            out[o] = (None, None)
            by_bytes[d], by_key[k] = f"https://o.org/{k}.jpg?{o}", f"https://o.org/{k}.jpg?{o}"
    return out


def run_copies(spark, groups):
    data = [(g, o, w, h, d, f"https://o.org/{k}.jpg?{o}") for g, rows in groups.items() for o, w, h, d, k in rows]
    df = spark.createDataFrame(data, "provider string, _ord long, width long, height long, digest string, url string")
    return {(r["provider"], r["_ord"]): (r["reason"], r["duplicate_of"])
            for r in M.drop_copies(df, F.col("digest")).collect()}


def test_copies_equal_the_ordered_walk(spark):
    rng = random.Random(3)
    groups = {
        f"g{i}": [(o, rng.randint(1, 4), 1, f"d{rng.randint(0, 9)}", f"k{rng.randint(0, 9)}") for o in range(rng.randint(1, 40))]
        for i in range(8)}
    # A dropped image registers nothing: b loses to a by URL, so c stays.
    groups["trap"] = [(1, 9, 9, "1", "k"), (2, 5, 5, "2", "k"), (3, 4, 4, "2", "m")]
    got = run_copies(spark, groups)
    want = {(g, o): v for g, rows in groups.items() for o, v in sequential_copies(rows).items()}
    assert got == want
    assert got[("trap", 3)] == (None, None)


def collapse(spark, images, groups):
    rows = spark.createDataFrame(
        [("p", images, groups)],
        "provider string, images array<struct<url:string,kind:string,carousel_ready:boolean,suitability:int,width:int,height:int>>, groups array<array<double>>")
    return {r["url"]: r["duplicate_of"] for r in M.collapse_groups(rows).collect()}


def test_best_of_each_group_stays(spark):
    images = [("1", "program-photo", True, 6, 1000, 700), ("2", "program-photo", True, 9, 1000, 700),
              ("3", "program-photo", False, 8, 800, 600), ("4", "flyer", False, 7, 800, 1000)]
    assert collapse(spark, images, [[1.0, 2.0], [3.0, 4.0]]) == {"1": "2", "4": "3"}


def test_malformed_groups_claim_nothing(spark):
    images = [(str(n), None, None, None, 10, 10) for n in (1, 2, 3)]
    groups = [[1.0], [0.0, 9.0, 1.5], [2.0, 2.0], [3.0, 1.0], [1.0, 3.0], None]
    assert collapse(spark, images, groups) == {"1": "3"}
    assert collapse(spark, images, None) == {}


def test_kinds_kept(one):
    reason = lambda j, k: one(M.reject_reason(F.lit(j), F.lit(k).cast("string")))
    assert [reason(True, k) for k in ("program-photo", "flyer", "text-only", "logo", None)] == [None, None, "text-only", "logo", "unclassified"]
    assert reason(False, None) is None


def test_photos_before_flyers(spark):
    df = spark.createDataFrame(
        [(1, "flyer", False, 10, 2000, 2000), (2, "program-photo", False, 3, 500, 400), (3, "program-photo", True, 3, 500, 400)],
        "_ord long, kind string, carousel_ready boolean, suitability int, width int, height int")
    assert [r["_ord"] for r in df.orderBy(*photo_rank()).collect()] == [3, 2, 1]


def test_shortlist_and_names(spark):
    df = spark.createDataFrame([("p", i, f"https://o.org/{'logo' if i == 1 else 'a'}{i}.jpg") for i in range(6)], "provider string, _ord long, url string")
    got = {r["_ord"]: r["reason"] for r in M.shortlist(df, 3).collect()}
    assert got == {0: None, 1: "filename", 2: None, 3: None, 4: "shortlist-full", 5: "shortlist-full"}


@pytest.mark.parametrize("title, military", [
    ("Can Do Soldiers build a robot 111615-A-XX999-020.jpg", True), ("Hour of Code 141212-M-FL273-032.jpg", True),
    ("Pupils tour Kadena Air Base.jpg", True), ("Sailors visit science class", True),
    ("Kids playing baseball.jpg", False), ("Children at the Warsaw museum.jpg", False),
    ("Students in the basement art room.jpg", False),
])
def test_military_settings_are_out(spark, title, military):
    df = spark.createDataFrame([(title, "Ann", "https://m.org/x", "CC BY 4.0", 1600, 1000)],
                               "title string, credit string, source string, license string, width int, height int")
    assert (M.filter_media(df).count() == 0) is military


def greedy(programs, lists):
    used, out = set(), {}
    for pid, provider, _ in sorted(programs, key=lambda p: p[2]):
        for photo in lists.get(provider, []):
            if photo not in used:
                used.add(photo)
                out[pid] = photo
                break
    return out


def test_own_photos_equal_the_greedy_walk(spark):
    rng = random.Random(11)
    for _ in range(3):
        providers = [f"p{i}" for i in range(7)]
        programs = [(f"id{i}", rng.choice(providers), i) for i in range(40)]
        lists = {p: rng.sample([f"ph{j}" for j in range(14)], rng.randint(0, 6)) if p < "p5"
                 else [f"{p}-{j}" for j in range(4)] for p in providers}
        photos = [(p, ph, i + 1) for p, phs in lists.items() for i, ph in enumerate(phs)]
        got = A.own_photos(
            spark.createDataFrame(programs, "id string, provider string, _ord long"),
            spark.createDataFrame(photos, "provider string, photo string, pos int")).collect()
        assert {r["id"]: r["photo"] for r in got} == greedy(programs, lists) and len(got) == len({r["id"] for r in got})


def test_pool_keeps_its_promises(spark):
    programs = [(f"id{i}", "a" if i % 3 else "b", i) for i in range(30)]
    pool = [("a", f"s{i}", i) for i in range(8)] + [("b", f"s{i}", i) for i in range(6, 30)]
    got = A.pool_photos(
        spark.createDataFrame(programs, "id string, subject string, _ord long"),
        spark.createDataFrame(pool, "subject string, source string, _ord long")).collect()
    sources = [r["source"] for r in got]
    assert len(sources) == len(set(sources)) == 30
    first = {r["id"]: r["source"] for r in got}
    assert first["id1"] == "s0" and first["id0"] == "s8"


def test_tiles_never_repeat_in_a_row(spark):
    rows = [(f"id{i}", "a", i, i % 3, "s1" if i % 2 else None) for i in range(12)]
    pool = [("a", f"s{i}", i % 2 == 0, i) for i in range(5)]
    got = A.fill_tiles(
        spark.createDataFrame(rows, "id string, subject string, _ord long, have int, main string"),
        spark.createDataFrame(pool, "subject string, src string, claimed boolean, _ord long")).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], []).append(r["src"])
    for pid, _, _, have, main in rows:
        tiles = by_id[pid]
        assert len(tiles) == 3 - have == len(set(tiles)) and main not in tiles


def test_tiles_take_unclaimed_photos_first_for_any_order_number(spark):
    rows = [("x", "a", 0, 2, None)]
    pool = [("a", "claimed", True, 1), ("a", "free", False, 2**41)]
    got = A.fill_tiles(
        spark.createDataFrame(rows, "id string, subject string, _ord long, have int, main string"),
        spark.createDataFrame(pool, "subject string, src string, claimed boolean, _ord long")).collect()
    assert [r["src"] for r in got] == ["free"]


def walk(programs, lists, pool, local):
    """One by one, as a reader would hand out pictures."""
    used, out = set(), {}
    for pid, provider, _, _ in programs:
        own = next((ph for ph in lists.get(provider, []) if ph not in used), None)
        if own:
            used.add(own)
            out[pid] = ("own", own)
    piles = {}
    for subject, source, _ in pool:
        if source not in local.values():
            piles.setdefault(subject, []).append(source)
    for pid, _, subject, _ in programs:
        if pid in out:
            continue
        for pile in [piles.get(subject, []), *piles.values()]:
            while pile and pile[0] in used:
                pile.pop(0)
            if pile:
                out[pid] = ("pool", pile.pop(0))
                used.add(out[pid][1])
                break
        else:
            stock = local.get(subject)
            out[pid] = ("none", None) if stock is None or stock in used else ("local", stock)
            used.add(stock)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pictures_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    subjects = ["a", "b", "c", "d", "unlisted"]
    n = [60, 120, 200, 40][seed]
    order = rng.sample(range(10**12), n) if seed % 2 else range(n)
    programs = [(f"id{i}", f"p{rng.randrange(8)}", rng.choices(subjects, [5, 1, 2, 1, 1 + seed])[0], o) for i, o in enumerate(sorted(order))]
    lists = {f"p{i}": rng.sample([f"ph{j}" for j in range(12)], rng.randrange(5)) for i in range(8)}
    pool = [(rng.choice(subjects[:4]), f"s{i}", i) for i in range([20, 60, 300, 0][seed])] + [("a", "stock-b", 900)]
    local = {s: f"stock-{s if s != 'd' else 'c'}" for s in subjects[:4]}
    got = A.assign_photos(
        spark.createDataFrame(programs, "id string, provider string, subject string, _ord long").repartition(3),
        spark.createDataFrame([(p, ph, i + 1) for p, phs in lists.items() for i, ph in enumerate(phs)], "provider string, photo string, pos int"),
        spark.createDataFrame(pool, "subject string, source string, _ord long"),
        spark.createDataFrame(list(local.items()), "subject string, source string"), bucket=16).collect()
    assert {r["id"]: (r["way"], r["picture"]) for r in got} == walk(programs, lists, pool, local)
    assert len(got) == n
