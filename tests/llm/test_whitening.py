"""Whitening beside an eigendecomposition of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gazetteer.llm.queries import op13_embedding_whitening
from gazetteer.llm.whitening import bidiagonalise, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, rows string"


def expected(vectors):
    """Components from numpy, exact sums in integers; vectors of (id, list)."""
    usable = [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in usable), default=0)
    ints = [(k, tuple([math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)))) for k, v in usable]
    fit = sorted({x for _, x in ints})
    n = len(fit)
    sums = [sum(x[i] for x in fit) for i in range(width)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit]).reshape(n, width)
    values, vecs = np.linalg.eigh(centred.T @ centred / max(n, 1)) if width else (np.zeros(0), None)
    return ints, n, sums, values[::-1], None if vecs is None else vecs[:, ::-1]


def compare(vectors, got, components=4):
    ints, n, sums, values, vecs = expected(vectors)
    found = min(components, int((values > values.sum() * 1e-12).sum())) if len(values) else 0
    assert len(got) == found * len(ints)
    rows = {}
    for r in got:
        rows.setdefault((r["key"], r["component"]), []).append(r)
    for k, x in ints:
        far = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for j in range(found):
            same = rows[k, j + 1]
            assert all(r["n"] == n and r["deviation_digits"] == str(far) for r in same)
            assert all(r["deviation"] == (far if far < 2**63 else None) for r in same)
            assert all(abs(r["explained"] - values[j] / values.sum()) < 1e-9 for r in same)
            assert all(r["identity_error"] < 1e-9 for r in same)
    return rows, ints, n, sums, values, vecs, found


def test_matches_eigenvectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = whiten(df).collect()
    rows, ints, n, sums, values, vecs, found = compare(vectors, got)
    assert found == 4
    mean = np.array([s / n for s in sums])
    for j in range(4):
        want = np.array([(np.array(x) - mean) @ vecs[:, j] / math.sqrt(values[j]) for _, x in ints])
        have = np.array([rows[k, j + 1][0]["whitened"] for k, _ in ints])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9


def test_query_returns_every_usable_row(spark):
    found = op13_embedding_whitening(spark, SF)
    assert found.columns[0] == "vec_id" and found.count() == 4 * 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [0.5, 0.25, 0.0]), (2, [0.5, 0.25, 0.0]), (3, None), (4, [nan, 0.0, 1.0]), (5, [None, 0.0, 1.0]),
               (6, [inf, 0.0, 1.0]), (7, [-0.5, 0.125, 0.75]), (8, [0.25]), (9, []), (None, [0.125, -0.75, 0.5]),
               (7, [0.0, -1.0, 0.25]), (10, [-0.0, -0.0, -0.0])]
    df = spark.createDataFrame([(k, v, 0, "x", "rows") for k, v in vectors], SCHEMA)
    got = whiten(df).collect()
    usable = [(k, v) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert len(got) == 3 * len(usable)
    unique = [(k, v) for k, v in usable if k != 7]
    ints, n, sums, values, _ = expected(vectors)
    assert n == 6 and {r["n"] for r in got} == {6}
    digits = {(r["key"], r["deviation_digits"]) for r in got}
    for k, x in ints:
        assert (k, str(sum((n * c - s) ** 2 for c, s in zip(x, sums)))) in digits
    assert unique


def test_equal_eigenvalues_rank_and_offset(spark):
    # Two pairs of equal eigenvalues, a dependent column and a far offset.
    base = np.array([[8, 0, 0, 0], [-8, 0, 0, 0], [0, 8, 0, 0], [0, -8, 0, 0], [0, 0, 2, 0], [0, 0, -2, 0],
                     [0, 0, 0, 2], [0, 0, 0, -2]]) + 4096
    vectors = [(i, [*map(float, v), float(v[0])]) for i, v in enumerate(base.tolist())]
    df = spark.createDataFrame([(k, v, 0, "", "") for k, v in vectors], SCHEMA)
    got = whiten(df).collect()
    rows, ints, *_ = compare(vectors, got)
    white = np.array([[rows[k, j + 1][0]["whitened"] for j in range(4)] for k, _ in ints])
    assert np.abs(white.T @ white / len(white) - np.eye(4)).max() < 1e-9


def test_one_vector_none_and_great_numbers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whiten(empty).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0, "", ""), (2, [], 0, "", "")], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "", ""), (2, [1.0, 2.0], 0, "", "")], SCHEMA)).count() == 0
    vectors = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5e8, 1e8]), (4, [1.0, 2.0])]
    got = whiten(spark.createDataFrame([(k, v, 0, "", "") for k, v in vectors], SCHEMA)).collect()
    compare(vectors, got)
    huge = whiten(spark.createDataFrame([(1, [1e38, 0.0], 0, "", ""), (2, [-1e38, 1.0], 0, "", "")], SCHEMA)).collect()
    assert {r["deviation"] for r in huge} == {None} and all(int(r["deviation_digits"]) > 2**63 for r in huge)


@pytest.mark.parametrize("rank", [1, 3, 6])
def test_bidiagonal_form(rank):
    rng = np.random.default_rng(rank)
    a = rng.standard_normal((40, rank)) @ rng.standard_normal((rank, 6)) * 10.0 ** rng.integers(-3, 4, 6)
    small, right = bidiagonalise(lambda w: (a.T @ (a @ w), float((a @ w) @ (a @ w))), 6)
    assert np.abs(right.T @ right - np.eye(6)).max() < 1e-13
    assert np.abs(np.tril(small, -1)).max() == 0 and np.abs(np.triu(small, 2)).max() == 0
    want = np.linalg.svd(a, compute_uv=False)
    assert np.abs(np.linalg.svd(small, compute_uv=False) - want).max() < 1e-11 * want[0]
    left = a @ right @ np.linalg.svd(small)[2].T
    assert np.abs(left.T @ left - np.diag(want**2)).max() < 1e-11 * want[0] ** 2
