"""Links of near-equal vectors beside all pairs, and the lattice beside a search of its points."""

import collections
import math

import numpy as np
import pytest

from gazetteer.llm import lattice
from gazetteer.llm.graph import components

SCHEMA = "vec_id long, embedding array<float>, label int, key long, node long, vector string"
RNG = np.random.default_rng(2)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)


def every_pair(rows, threshold=0.95):
    """links, component of each row; rows of (id, vector)."""
    width = max((len(v) for _, v in rows if usable(v)), default=1)
    units = {}
    for k, (_, v) in enumerate(rows):
        if usable(v):
            u = np.zeros(width)
            u[: len(v)] = np.array(v, np.float32)
            u /= np.abs(u).max()
            units[k] = u / np.linalg.norm(u)
    at = list(units)
    m = np.stack([units[k] for k in at]) if at else np.zeros((0, width))
    near = m @ m.T >= threshold
    links, parent = collections.Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        if i != j:
            links[at[i]] += 1
            parent[find(at[i])] = find(at[j])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, links[k], least.get(find(k))) for k, (i, _) in enumerate(rows)]


def clustered(cosines=(0.999, 0.985, 0.96), width=64, many=60):
    """Pairs at given cosines, a chain, a dense cluster, copies and strangers."""
    unit = lambda v: v / np.linalg.norm(v)
    out = [unit(RNG.standard_normal(width)) for _ in range(many)]
    for c in cosines:
        for _ in range(many // 4):
            x = unit(RNG.standard_normal(width))
            y = RNG.standard_normal(width)
            y = unit(y - (y @ x) * x)
            out += [x * 3, c * x + math.sqrt(1 - c * c) * y]
    centre = unit(RNG.standard_normal(width))
    out += [unit(centre + RNG.standard_normal(width) * 0.012) for _ in range(many * 2)]
    x, y = unit(RNG.standard_normal(width)), RNG.standard_normal(width)
    y = unit(y - (y @ x) * x)
    out += [math.cos(a) * x + math.sin(a) * y for a in np.arange(0, 1.2, 0.12)]
    out += [out[0], out[0], out[5]]
    return [(i * 7 % 1009, v.astype(np.float32).tolist()) for i, v in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)


def test_same_as_every_pair(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [nan] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, [inf] * 64),
           (2006, [1.0]), (2007, [2.0, 0.0]), (None, [2.0, 0.01]), (2008, [-1.0]), (2009, [0.0, 1.0]), (None, [0.0, 0.0, 1.0]),
           (None, [0.0, 0.0, 5.0]), (2010, [1e-38, 1e-38]), (2011, [1e38, 1e38]), (2012, None)]
    rows = clustered() + odd
    rows.append(rows[3])  # a repeated row
    got = lattice.link(frame(spark, rows))
    assert got.columns == ["key", "n_links", "component_id", "kept"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    want = sorted(((i, n, c, i == c) for i, n, c in every_pair(rows)), key=repr)
    assert got == want


@pytest.mark.parametrize("limits", [(40, 8), (6, 2)])
def test_dealt_buckets_give_the_same(spark, monkeypatch, limits):
    monkeypatch.setattr(lattice, "LIMIT", limits[0])
    monkeypatch.setattr(lattice, "PART", limits[1])
    rows = clustered((0.951, 0.949, 0.955))
    got = sorted(tuple(r)[:3] for r in lattice.link(frame(spark, rows)).collect())
    want = sorted(every_pair(rows))
    close = sum(a == b for a, b in zip(got, want, strict=True))
    assert close >= 0.97 * len(want)
    monkeypatch.undo()
    assert got == sorted(tuple(r)[:3] for r in lattice.link(frame(spark, rows)).collect())


def test_small_groups_and_blocks_agree(monkeypatch, spark):
    rows = clustered()
    whole = sorted(tuple(r) for r in lattice.link(frame(spark, rows)).collect())
    monkeypatch.setattr(lattice, "FEW_PAIRS", 0)
    monkeypatch.setattr(lattice, "CELLS", 50)
    assert whole == sorted(tuple(r) for r in lattice.link(frame(spark, rows)).collect())


def test_empty_and_unusable(spark):
    assert lattice.link(spark.createDataFrame([], SCHEMA)).collect() == []
    got = lattice.link(frame(spark, [(1, None), (2, [0.0])])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize(("cosine", "least"), [(0.95, 0.95), (0.97, 0.985), (0.99, 0.999)])
def test_recall_at_an_angle(cosine, least):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((4000, 64))
    y -= (y * x).sum(axis=1)[:, None] * x
    y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1)[:, None]
    turns = lattice.projections(64)
    a, b = (lattice.cells(*lattice.sketch(v)[:2], turns) for v in (x, y))
    met = (a[:, :, :1] == b).any(axis=(1, 2)) | (b[:, :, :1] == a).any(axis=(1, 2))
    assert met.mean() >= least


def test_nearest_points_and_cells_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    z = rng.integers(-3 * lattice.UNIT, 3 * lattice.UNIT, (300, 8))
    points = lattice.nearest_points(z)
    assert (((points % 2).sum(axis=1) % 8) == 0).all() and (points.sum(axis=1) % 4 == 0).all()
    own = np.square(z - points * (lattice.UNIT // 2)).sum(axis=1)
    for root in lattice.ROOTS:  # the Voronoi cell of E8 is bounded by its shortest vectors
        assert (own <= np.square(z - (points + root) * (lattice.UNIT // 2)).sum(axis=1)).all()
    x = rng.standard_normal((50, 64))
    q, scale, lost = lattice.sketch(x / np.linalg.norm(x, axis=1)[:, None])
    turns = lattice.projections(64)
    whole = lattice.cells(q, scale, turns)
    assert all((lattice.cells(q[i: i + 1], scale[i: i + 1], turns)[0] == whole[i]).all() for i in range(50))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(500 + i, 501 + i) for i in range(70)] + [(7, 7)]
    edges += [(600, 601 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    want = set()
    for x in {x for a, b in edges if a != b for x in (a, b)}:
        r = x
        while parent[r] != r:
            r = parent[r]
        want.add((x, r))
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert set(got) == want and len(got) == len(want)
