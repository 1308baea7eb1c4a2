import numpy as np
import pytest

from portolan.llm import vectors
from portolan.llm.common import table
from portolan.llm.graph import components


def brute(rows, threshold=0.95):
    """(id, links, component, kept) of each row, by comparing all."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for size in {len(rows[i][1]) for i in ok}:
        same = [i for i in ok if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in same], float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        link[np.ix_(same, same)] = x @ x.T >= threshold
        alike = {}
        for i in same:
            alike.setdefault(tuple(rows[i][1]), []).append(i)
        for group in alike.values():
            link[np.ix_(group, group)] = True
    np.fill_diagonal(link, False)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], int(link[i].sum()), component, rows[i][0] == component))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=repr)


def test_table_equals_brute_force(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    assert got(vectors.near_vectors(df)) == brute([(r.vec_id, list(r.embedding)) for r in df.collect()])


@pytest.mark.parametrize("block", [1024, 8])
def test_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + rng.standard_normal(16) * 0.02).tolist()) for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, None), (202, []), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] + [1.0] * 15)]
    rows += [(206, [float("inf")] + [1.0] * 15), (None, rows[1][1]), (None, rng.standard_normal(16).tolist()), (207, [1.0] * 5), (208, [2.0] * 5), (5, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, n int")
    assert got(vectors.near_vectors(df)) == brute(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_components_of_any_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [3e-200, 3e-200]), (5, [1.0, 1.0]), (6, [5e-324, 0.0])]
    rows += [(7, [1e308, -1e308]), (8, [1e308, 1e-308]), (9, [0.0, 0.0]), (10, [1e308, 1e308])]
    out = got(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert out == brute(rows)
    assert [(i, n, c) for i, n, c, _ in out if i in (1, 2, 3, 4, 5, 10)] == [(i, 5, 1) for i in (1, 10, 2, 3, 4, 5)]


def test_near_pairs_of_the_table_equal_brute_force(spark, sf_dir):
    """The given vectors hold no close pair; each gets partners at three distances here."""
    rng = np.random.default_rng(4)
    rows = []
    for r in table(spark, sf_dir, "embeddings").collect():
        x = np.array(r.embedding, float)
        rows.append((r.vec_id, x.tolist()))
        for i, noise in enumerate((0.05, 0.2, 0.6)):
            y = rng.standard_normal(len(x))
            rows.append((100_000 * (i + 1) + r.vec_id, (x + noise * np.linalg.norm(x) / np.linalg.norm(y) * y).tolist()))
    out = got(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = brute(rows)
    assert sum(n for _, n, _, _ in want) >= len(rows) // 4
    assert out == want


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((400, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((400, 32))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * side
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b]))]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("n_links > 0").count()
    assert found >= 0.97 * 800


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {n for e in edges if e[0] != e[1] for n in e}
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: find(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
