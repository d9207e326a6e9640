import math

import numpy as np
import pytest
from helpers import clashing

from shelfwise.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors):
    """The same numbers by numpy's own eigenvalues and Python's whole numbers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    deviation = [sum((n * r[d] - sums[d]) ** 2 for d in range(dims)) for r in x]
    centred = np.array(x, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return centred, cov, deviation, values[::-1], axes.T[::-1]


def random_symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [3.0, 1.0], [5.0], [2.0, 2.0, 2.0], [1e6, 1.0, 1e-6, 0.0], list(range(64)), [7.0] * 5 + [1.0] * 6,
        [1.0, 1.0 + 1e-9, 1.0 - 1e-9, 4.0], [0.0] * 6, [1.0] + [0.0] * 20, list(np.geomspace(1e-8, 1e8, 40)), [-3.0, 0.0, 3.0],
    ],
)
def test_divide_and_conquer_finds_the_spectrum(values):
    a = random_symmetric(values, len(values))
    scale = max(np.linalg.norm(a), 1.0)
    for want in (len(values), min(3, len(values))):
        found, axes = whitening.components(a, want)
        assert found.shape == (want,)
        assert np.allclose(found, sorted(values, reverse=True)[:want], atol=1e-12 * scale)
        assert np.abs(axes @ axes.T - np.eye(want)).max() < 1e-12
        assert np.abs(axes @ a - found[:, None] * axes).max() < 1e-12 * scale


def test_diagonal_matrices_and_shifts_that_meet_an_eigenvalue():
    for diagonal in ([1.0, 2.0, 3.0], [1.0, 1.0, 4.0, 2.0], [5.0, 5.0], [0.0, 2.0, 1.0, 1.0, 1.0]):
        found, axes = whitening.components(np.diag(diagonal), len(diagonal))
        assert np.allclose(found, sorted(diagonal, reverse=True), atol=1e-13)
        assert np.abs(axes @ np.diag(diagonal) - found[:, None] * axes).max() < 1e-13


def test_polar_factor_is_the_sign():
    a = random_symmetric([-4.0, -1e-9, 1e-7, 2.0, 9.0], 1)
    sign = whitening.polar(a)
    values, axes = np.linalg.eigh(a)
    assert np.abs(sign - axes @ np.diag(np.sign(values)) @ axes.T).max() < 1e-6
    assert np.abs(sign @ sign - np.eye(5)).max() < 1e-12


def test_equals_plain_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12)) * 0.3 + 0.2).tolist()
    vectors += [vectors[0]] * 40
    bad = [None, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [None] + [0.0] * 11]
    docs = clashing(frame(spark, vectors + bad), "x", "n", "component", "whitened", "length").repartition(13)
    rows = whitening.whitened_components(docs).collect()
    centred, cov, deviation, values, axes = plain(vectors)
    assert len(rows) == 8 * len(vectors)
    got = np.zeros((len(vectors), 8))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == len(vectors) and r.deviation == deviation[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-10
        assert r.identity_error < 1e-9
    want = centred @ axes[:8].T / np.sqrt(values[:8])
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-8)


def test_components_without_variance_lengths_and_few_rows(spark):
    flat = whitening.whitened_components(frame(spark, [[0.5, 0.25]] * 3)).collect()
    assert len(flat) == 6
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in flat} == {(0.0, 0.0, 0, 0.0)}
    few = whitening.whitened_components(frame(spark, [[1.0, 0.0, 2.0], [0.0, 3.0, 1.0]])).collect()
    assert sorted({round(abs(r.whitened), 9) for r in few if r.component == 1}) == [1.0]
    assert all(r.whitened == 0.0 for r in few if r.component > 1)
    assert all(r.identity_error < 1e-9 for r in few)
    mixed = whitening.whitened_components(frame(spark, [[1.0], [2.0], [4.0], [1.0, 2.0], [3.0, 1.0], []])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in mixed) == [(0, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]
    assert all(r.identity_error < 1e-9 for r in mixed)


def test_deviations_beyond_a_long_are_exact_or_null(spark):
    w = whitening.Whitener(3, np.array([0]), np.ones((1, 1)), np.ones(1), 1.0)
    assert w.deviations(np.array([[833_333_333], [2**31]])) == [2_499_999_999**2, None]
    assert w.deviations(np.array([[5]])) == [225]


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], None), (3, [2.0, 0.0], 1), (3, [2.0, 0.0], 1)]
    got = whitening.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["3"] * 4 + ["None"] * 4
    empty = whitening.whitened_components(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and "identity_error" in empty.columns
    assert whitening.whitened_components(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
