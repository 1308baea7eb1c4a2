import math

import numpy as np
import pytest

from portolan.llm import queries, whitening
from portolan.llm.common import table


def brute(rows):
    """Fit of usable vectors of one length: x by row, n, exact deviations, covariance."""
    xs = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], np.float64) / n
    return xs, n, sums, z.T @ z / n


def compare(rows, got, most=16):
    xs, n, sums, cov = brute(rows)
    dim = len(cov)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, dim)
    assert len(got) == len(xs) * count
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = None
    for i, x in xs:
        own = by_id[i]
        z = [n * c - s for c, s in zip(x, sums)]
        assert sorted(own) == list(range(1, count + 1))
        assert {(r.n, r.deviation) for r in own.values()} == {(n, sum(v * v for v in z))}
        want = np.array([v / n for v in z]) @ vectors[:, :count] / np.sqrt(values[:count])
        have = np.array([own[c].whitened for c in range(1, count + 1)])
        if signs is None:
            signs = np.sign(want * have)
        assert np.allclose(have, want * signs, rtol=0, atol=1e-6)
        assert np.allclose([own[c].explained for c in range(1, count + 1)], values[:count] / np.trace(cov), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-9
    have = np.array([[by_id[i][c].whitened for c in range(1, count + 1)] for i in {tuple(x): i for i, x in xs}.values()])
    assert np.abs((have - have.mean(axis=0)).T @ (have - have.mean(axis=0)) / n - np.eye(count)).max() < 1e-6


def test_table_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    got = queries.op13_whiten_embeddings(spark, sf_dir)
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    compare(rows, got.collect())


KIND = "vec_id long, embedding array<float>, label int, x int, n string, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y") for i, v in rows], KIND)


def test_odd_rows(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]  # a third of all rows are one vector
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [1.0, float("inf"), 0.0, 0.0, 0.0]), (204, [-0.0, 0.0, 0.0, 0.0, 0.0]), (205, [0.0] * 5)]
    whole = whitening.whiten(frame(spark, rows))
    assert whole.columns == ["vec_id", "dim", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(rows, whitening.digest(whole).collect())
    again = whitening.digest(whitening.whiten(frame(spark, [*rows, (300, [1.0, 2.0]), (301, [])]))).collect()
    compare(rows, [r for r in again if r.vec_id < 300])
    assert not [r for r in again if r.vec_id == 301]
    lone = [r for r in again if r.vec_id == 300]  # the only vector of its length
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]


def test_ids_and_empty_tables(spark):
    rows = [(None, [0.5, 1.0]), (1, [0.25, 2.0]), (1, [0.25, 2.0]), (1, [7.0, -3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.n) for r in got) == [(0, 3), (1, 3), (1, 3), (1, 3)]
    assert whitening.digest(whitening.whiten(frame(spark, []))).collect() == []
    assert whitening.digest(whitening.whiten(frame(spark, [(1, None)]))).collect() == []


def test_no_variance_in_some_directions(spark):
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 3.0]) for i in range(50)]
    got = {(r.vec_id, r.component): r for r in whitening.digest(whitening.whiten(frame(spark, rows))).collect()}
    assert all(got[i, c].whitened is None and got[i, c].explained < 1e-12 for i in range(50) for c in (2, 3))
    assert abs(abs(got[0, 1].whitened) - math.sqrt(2)) < 1e-9 and got[0, 1].identity_error < 1e-9


def test_far_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3e38, 2.0])]
    got = {r.vec_id: r for r in whitening.whiten(frame(spark, rows)).collect()}
    x = {1: (2**60 + 10**6, 10**6), 2: (-(2**60) + 10**6, 10**6 + 64), 3: (2**60 + 10**6, 10**6 + 128)}
    assert all(r.n == 3 and r.deviation is None and r.whitened[0] is not None for r in got.values())
    assert abs(got[1].whitened[0] - got[3].whitened[0]) < 1e-9 and x[1][0] == x[3][0]


def test_large_counts_stay_exact():
    model = whitening.Model(10**12, [10**18 + 7, -(10**18) - 1])
    x = np.array([[10**6 + 5, -(10**6)], [10**6, -(10**6) + 3]])
    z = whitening.spread(x, model)
    want = [[10**12 * int(a) - s for a, s in zip(row, model.sums)] for row in x.tolist()]
    assert z.tolist() == want
    exact = [sum(v * v for v in row) for row in want]
    assert whitening.deviations(z) == [v if v < 2**63 else None for v in exact]
    assert whitening.deviations(np.array([[3, 4]])) == [25]


def orthogonal(size, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    q = q.astype(np.longdouble)
    for _ in range(4):
        q = q @ (3 * np.eye(size, dtype=np.longdouble) - q.T @ q) / 2
    return q


@pytest.mark.parametrize("name, values", [
    ("apart", np.linspace(1, 40, 40)),
    ("wide range", 10.0 ** np.linspace(0, -12, 30)),
    ("pairs", np.repeat(np.linspace(1, 5, 10), 2) + np.tile([0, 1e-9], 10)),
    ("clusters", np.concatenate([3 + 1e-11 * np.arange(6), 2 + 1e-8 * np.arange(5), [1, 0.5, 0.25]])),
    ("nested", np.array([1, 1 + 1e-13, 1 + 1e-10, 1 + 1e-7, 1 + 1e-4, 2, 2 + 1e-12, 5])),
    ("equal", np.array([7.0] * 12 + [1.0] * 8)),
    ("one value", np.full(9, 2.5)),
])
def test_refinement_beyond_single_precision(name, values):
    q = orthogonal(len(values), 3)
    exact = np.asarray(values, np.longdouble)
    a = (q * exact) @ q.T
    a = (a + a.T) / 2
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    found, x = whitening.refine(a, start)
    size, eps = np.abs(a).max(), np.finfo(np.longdouble).eps
    assert np.abs(np.sort(found) - np.sort(exact)).max() <= 200 * len(a) * eps * size
    assert np.abs(x.T @ x - np.eye(len(a))).max() <= 200 * len(a) * eps
    assert np.abs(a @ x - x * found).max() <= 200 * len(a) * eps * size
    whole, vectors = whitening.eigen(a.astype(np.float64))
    assert (np.diff(whole) <= 0).all() and np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-14
    assert np.abs(a.astype(np.float64) @ vectors - vectors * whole).max() <= 20 * len(a) * np.finfo(float).eps * float(size)


def test_eigenvectors_of_close_values_are_those_of_the_exact_matrix():
    """Gaps of 1e-10 leave plain double precision about six digits; the refined vectors keep twice as many."""
    q = orthogonal(8, 9)
    values = np.array([1, 1 + 1e-10, 2, 3, 3 + 1e-10, 4, 5, 6], np.longdouble)
    a = (q * values) @ q.T
    _, x = whitening.refine((a + a.T) / 2, np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble))
    overlap = np.abs(q.T @ x)
    assert np.abs(overlap.max(axis=0) - 1).max() < 1e-12 and np.sort(overlap, axis=0)[-2].max() < 1e-8


def test_zero_matrix():
    values, vectors = whitening.eigen(np.zeros((3, 3)))
    assert values.tolist() == [0, 0, 0] and (vectors == np.eye(3)).all()
