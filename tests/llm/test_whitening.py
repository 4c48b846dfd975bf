"""Whitening against numpy's eigenvalues on exact integers."""

import math

import numpy as np
import pytest

from claimscope.llm import whitening


def reference(vectors):
    """Rows (vec_id, component, n, deviation, |whitened|, explained) by numpy."""
    rows = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in rows})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in distinct], dtype=float) / n
    values, comps = np.linalg.eigh(centred.T @ centred / n)
    trace = values.sum()
    values, comps = values[::-1], comps[:, ::-1]
    many = min(16, int((values > 1e-9 * values[0]).sum()))
    out = {}
    for at, (k, x) in enumerate(rows):
        y = [n * a - s for a, s in zip(x, sums, strict=True)]
        dev, proj = sum(v * v for v in y), np.array(y, dtype=float) / n @ comps
        for j in range(many):
            out[at, j + 1] = (k, j + 1, n, dev, abs(proj[j] / math.sqrt(values[j])), values[j] / trace)
    return sorted(out.values(), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


def check(spark, vectors, schema="vec_id long, embedding array<float>"):
    got = [r.asDict() for r in whitening.whitened(spark.createDataFrame(vectors, schema).repartition(3)).collect()]
    got.sort(key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"], abs(r["whitened"])))
    want = reference(vectors)
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r["whitened"]) for r in got], [r[4] for r in want], atol=1e-7)
    assert np.allclose([r["explained"] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)


def _floats(x):
    return np.asarray(x, dtype=np.float32).astype(float).tolist()


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    mixed = rng.standard_normal((300, 24)) @ rng.standard_normal((24, 24)) * 2
    vectors = [(k, _floats(v)) for k, v in enumerate(mixed)]
    vectors += [(None, _floats(mixed[0])), (3, _floats(mixed[3])), (900, None), (901, []), (902, [None] + _floats(mixed[0])[1:]), (903, [math.nan] + _floats(mixed[0])[1:]), (904, [math.inf] + _floats(mixed[0])[1:])]
    check(spark, vectors)


def test_hot_vector_counts_once_in_the_fit(spark):
    rng = np.random.default_rng(2)
    some = [_floats(v) for v in rng.standard_normal((40, 5)) * [9, 5, 3, 2, 1]]
    check(spark, [(k, some[0] if k % 2 else some[k % 40]) for k in range(400)])


def test_dimensions_without_variance_are_left_out(spark):
    check(spark, [(k, _floats([k, 2 * k, 5, (k * k) % 7])) for k in range(50)])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_other_widths_and_columns(spark):
    rows = [(k, [float(k), float(k % 3)], "x") for k in range(9)] + [(50, [1.0], "y"), (51, [1.0, 2.0, 3.0], "z")]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string"))
    assert {r.vec_id for r in got.collect()} == set(range(9))


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [float(k % 2) * 1e12, float(k)]) for k in range(4)]
    assert {r.deviation for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == {None}


def _symmetric(rng, n, values):
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 60, 60), np.repeat([5.0, 3.0, 1.0], 20), 1 + 1e-9 * np.arange(60), np.exp(-np.arange(60.0)), np.concatenate([np.zeros(55), np.ones(5) * 1e8])],
    ids=["apart", "equal", "close", "falling", "low-rank"],
)
def test_leading_pairs(values):
    rng = np.random.default_rng(4)
    matrix = _symmetric(rng, len(values), values)
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_pairs(matrix, 16)
    norm = np.abs(values).max()
    assert np.allclose(found, np.sort(values)[::-1][:16], atol=1e-12 * norm)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * norm
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12


@pytest.mark.parametrize("matrix", [np.diag([3.0, 1.0, 2.0]), np.array([[2.0]]), np.array([[2.0, 1.0], [1.0, 2.0]]), np.zeros((4, 4)), np.eye(5)], ids=["diagonal", "one", "two", "zero", "identity"])
def test_small_matrices(matrix):
    found, vectors = whitening.leading_pairs(matrix, 16)
    assert np.allclose(found, np.linalg.eigvalsh(matrix)[::-1])
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(matrix)), atol=1e-12)


def test_sturm_counts():
    rng = np.random.default_rng(6)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    off[[4, 11]] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = rng.standard_normal(50) * 2
    assert whitening.counts_below(diagonal, off, at).tolist() == [(values < x).sum() for x in at]
