import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.operators import cells, features, kmeans, segments, tiles


def brute_clusters(points, eps, least):
    """Clusters by growing from each unvisited core point in key order."""
    keys = sorted(points)
    near = {a: [b for b in keys if math.dist(points[a], points[b]) <= eps] for a in keys}
    core = {a for a in keys if len(near[a]) >= least}
    label, n = {}, 0
    for a in keys:
        if a in core and a not in label:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = n
                    if x in core:
                        todo += near[x]
            n += 1
    return {a: label.get(a, -1) for a in keys}, core


def brute_silhouette(points, label):
    scores = []
    for a in points:
        mean = {}
        for c in set(label.values()):
            others = [math.dist(points[a], points[b]) for b in points if label[b] == c and b != a]
            mean[c] = sum(others) / len(others) if others else None
        inside = mean.pop(label[a])
        outside = [m for m in mean.values() if m is not None]
        if inside is None or not outside:
            scores.append(0.0)
        else:
            scores.append((min(outside) - inside) / max(inside, min(outside)))
    return sum(scores) / len(scores)


def cloud(seed, n):
    r = random.Random(seed)
    centers = [(r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(4)]
    out = {}
    for key in range(n):
        x, y = r.choice(centers)
        out[key * 3 + 1] = (x + r.gauss(0, 0.35), y + r.gauss(0, 0.35))
    return out


def table(spark, groups):
    return spark.createDataFrame(
        [(g, k, [float(x) for x in p]) for g, points in groups.items() for k, p in points.items()],
        "reporter int, partner int, features array<double>",
    )


@pytest.mark.parametrize("block", [256, 7])
def test_density_clusters_against_growth(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    monkeypatch.setattr(cells, "BLOCK", block)
    chain = {k: (k * 0.45, 0.0) for k in range(40)}  # one long thin cluster
    twins = {k: (1.0, 1.0) for k in range(30)} | {99: (9.0, 9.0)}  # a hot spot of copies and noise
    groups = {1: cloud(1, 60), 2: chain, 3: twins, 4: {5: (0.0, 0.0)}, 5: cloud(2, 45)}
    found = segments.density_clusters(table(spark, groups), 0.5, 3)
    got = {}
    for r in found.collect():
        got.setdefault(r["reporter"], {})[r["partner"]] = (r["cluster"], r["is_core"])
    for g, points in groups.items():
        labels, core = brute_clusters(points, 0.5, 3)
        assert got[g] == {k: (labels[k], k in core) for k in points}
    summary = {r["reporter"]: r for r in segments.density_summary(found).collect()}
    for g, points in groups.items():
        labels, _ = brute_clusters(points, 0.5, 3)
        clusters = {c for c in labels.values() if c >= 0}
        assert summary[g]["n_clusters"] == len(clusters)
        assert summary[g]["n_noise"] == sum(c == -1 for c in labels.values())
        expected = brute_silhouette(points, labels) if len(clusters) > 1 else 0.0
        assert summary[g]["silhouette"] == pytest.approx(expected, abs=1e-9)


def test_density_clusters_in_five_dimensions(spark):
    """More features than the cells have axes, and coordinates on cell borders."""
    r = random.Random(11)
    points = {k: tuple(r.choice([0.0, 0.25, 0.5, 1.0, 1.5, -0.5]) if i < 3 else r.gauss(0, 0.3) for i in range(5)) for k in range(150)}
    labels, core = brute_clusters(points, 0.5, 3)
    found = {p["partner"]: p for p in segments.density_clusters(table(spark, {1: points}), 0.5, 3).collect()}
    assert {k: (p["cluster"], p["is_core"]) for k, p in found.items()} == {k: (labels[k], k in core) for k in points}
    assert {k: p["neighbours"] for k, p in found.items()} == {k: sum(math.dist(points[k], q) <= 0.5 for q in points.values()) for k in points}


def test_spread_points_meet_few_others(spark):
    n = 20_000
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate((r.random((n, 4)) * [40, 40, 0.1, 40]).tolist())], "reporter int, partner int, features array<double>")
    index = cells.Index(df, 0.5, "partner", "reporter")
    assert index.axes == [0, 1, 3]
    met = index.filed(df).groupBy("_cell").count().withColumnRenamed("count", "n")
    pairs = index.tiles.join(met, "_cell").join(met.select(F.col("_cell").alias("_there"), F.col("n").alias("m")), "_there").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert pairs < n * n / 1000
    dense = cells.Index(df.withColumn("features", F.transform("features", lambda x: x * 0)), 0.5, "partner", "reporter")
    blocks = math.ceil(n / cells.BLOCK)
    assert dense.tiles.count() == blocks * (blocks + 1) // 2


@pytest.mark.parametrize("block", [256, 5])
def test_silhouette_against_definition(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    points = cloud(7, 33)
    r = random.Random(8)
    labels = {k: [r.randrange(3), 0 if k > 1 else 1, r.randrange(2)] for k in points}
    df = spark.createDataFrame(
        [(1, k, list(p), labels[k]) for k, p in points.items()],
        "reporter int, partner int, features array<double>, labels array<int>",
    )
    for row in segments.silhouettes(df).collect():
        expected = brute_silhouette(points, {k: v[row["labelling"]] for k, v in labels.items()})
        assert row["points"] == len(points) and row["silhouette"] == pytest.approx(expected, abs=1e-9)


def test_scaling(spark):
    values = [1.0, 2.0, 4.0, 8.0, 50.0]
    df = spark.createDataFrame([(1, k, x, 3.0) for k, x in enumerate(values)], "reporter int, partner int, a double, flat double")
    standard = {r["partner"]: r for r in features.standard_scaled(df, ["a", "flat"]).collect()}
    z = (np.array(values) - np.mean(values)) / np.std(values)
    assert [standard[k]["a_scaled"] for k in range(5)] == pytest.approx(list(z))
    robust = {r["partner"]: r for r in features.robust_scaled(df, ["a", "flat"]).collect()}
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    assert [robust[k]["a_scaled"] for k in range(5)] == pytest.approx(list((np.array(values) - q2) / (q3 - q1)))
    # A column without spread is centred only.
    assert all(r["flat_scaled"] == 0 for r in (*standard.values(), *robust.values()))


def test_partner_features(flows, countries, as_rows):
    df = flows([(2020, 50, 1, 7, 10, 2), (2021, 50, 1, 8, 30, None), (2021, 50, 2, 8, 60, 0), (2021, 50, 3, 8, 999, 1)])
    got = as_rows(features.partner_features(df, countries([(1, "A", "A"), (2, "B", "B")]), 50), "partner")
    assert [(r["total_value"], r["total_quantity"], r["product_diversity"], r["years_active"]) for r in got] == [(40, 2, 2, 2), (60, 0, 1, 1)]
    assert got[0]["market_share"] == 0.4 and got[0]["avg_annual_trade"] == 20
    assert got[0]["unit_value"] == pytest.approx(40 / 2.001) and got[1]["unit_value"] == pytest.approx(60000)


def hills(seed, centers, size, first=0):
    r = random.Random(seed)
    return {first + c * size + i: (c * 20 + r.random(), c * 20 + r.random()) for c in range(centers) for i in range(size)}


@pytest.mark.parametrize("block", [1024, 4])
def test_kmeans_and_sweep_of_all_groups(spark, monkeypatch, block):
    monkeypatch.setattr(kmeans, "BLOCK", block)
    groups = {1: hills(4, 3, 10), 2: hills(5, 2, 6), 3: {1: (0.0, 0.0), 2: (5.0, 5.0)}, 4: {k: (1.0, 1.0) for k in range(6)}}
    df = table(spark, groups)
    sweep = segments.kmeans_sweep(df, 6, restarts=4)
    scores = {}
    for s in sweep.scores.collect():
        scores.setdefault(s["reporter"], {})[s["k"]] = s
    assert {g: sorted(v) for g, v in scores.items()} == {1: [2, 3, 4, 5, 6], 2: [2, 3, 4, 5, 6], 4: [2, 3, 4, 5]}
    assert [k for k, s in scores[1].items() if s["chosen"]] == [3] and [k for k, s in scores[2].items() if s["chosen"]] == [2]
    parts = {}
    for row in sweep.labelled.collect():
        parts.setdefault((row["reporter"], row["cluster"]), set()).add(row["partner"])
    assert sorted(map(sorted, (v for (g, _), v in parts.items() if g == 1))) == [list(range(i * 10, i * 10 + 10)) for i in range(3)]
    assert sorted(map(sorted, (v for (g, _), v in parts.items() if g == 2))) == [list(range(6)), list(range(6, 12))]
    for (g, cluster), members in parts.items():
        center = [c["center"] for c in sweep.centers.collect() if c["reporter"] == g and c["cluster"] == cluster]
        assert len(center) == 1 and center[0] == pytest.approx(np.mean([groups[g][m] for m in members], axis=0))
    assert scores[1][3]["inertia"] == pytest.approx(
        sum(((np.array([groups[1][m] for m in v]) - np.mean([groups[1][m] for m in v], axis=0)) ** 2).sum() for (g, _), v in parts.items() if g == 1)
    )
    checks = segments.cluster_checks(df, sweep.models).collect()
    assert len(checks) == 14
    for c in checks:
        xy = np.array(list(groups[c["reporter"]].values()))
        assert (c["points"], c["misplaced"], c["off_centre"], c["inertia_holds"]) == (len(xy), 0, 0, True)
        assert c["total_squares"] == pytest.approx(((xy - xy.mean(axis=0)) ** 2).sum(), abs=1e-9)


def test_kmeans_does_not_depend_on_blocks_and_finds_good_fits(spark, monkeypatch):
    points = {1: cloud(21, 120), 2: cloud(22, 80)}
    found = []
    for block in (1024, 16):
        monkeypatch.setattr(kmeans, "BLOCK", block)
        rows = segments.kmeans(table(spark, points), 4, restarts=10).labelled.collect()
        found.append({(r["reporter"], r["partner"]): r["cluster"] for r in rows})
    assert found[0] == found[1]
    fit = segments.kmeans(table(spark, points), 4)
    rng = np.random.default_rng(0)
    for row in fit.inertia.collect():  # no worse than many plain runs
        xy, best = np.array(list(points[row["reporter"]].values())), np.inf
        for _ in range(40):
            centers = xy[rng.choice(len(xy), 4, replace=False)]
            for _ in range(60):
                near = ((xy[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
                centers = np.array([xy[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(4)])
            best = min(best, ((xy[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum())
        assert row["inertia"] <= best * 1.02
    small = segments.kmeans(table(spark, {1: {1: (0.0, 1.0), 2: (3.0, 1.0)}}), 2)
    assert sorted(c["center"] for c in small.centers.collect()) == [[0.0, 1.0], [3.0, 1.0]]
    assert segments.kmeans(table(spark, {1: {1: (0.0, 1.0)}}), 2).labelled.collect() == []


def test_draws_follow_the_weights():
    """The first clock of weighted points rings as often as their weights say."""
    keys, weights = np.arange(4), np.array([1.0, 2.0, 0.0, 5.0])
    with np.errstate(divide="ignore"):
        first = [int((kmeans.clocks(keys, 42, start, 1) / weights).argmin()) for start in range(8000)]
    assert np.bincount(first, minlength=4) / 8000 == pytest.approx(weights / 8, abs=0.02)
    assert (kmeans.clocks(keys, 42, 3, 1) != kmeans.clocks(keys, 42, 3, 2)).all()


def test_principal_components_of_all_groups(spark):
    r = np.random.default_rng(5)
    groups = {g: r.normal(size=(40, 3)) * [5, 2, 0.5] @ r.normal(size=(3, 3)) + [100, -50, 7] for g in (1, 2)}
    lone = {3: np.array([[1.0, 2.0, 3.0]]), 4: np.array([[1.0, 2.0, 3.0]] * 5)}
    df = table(spark, {g: {k: tuple(p) for k, p in enumerate(xy)} for g, xy in (groups | lone).items()})
    found = segments.principal_components(df, 2)
    shares = {(v["reporter"], v["component"]): v for v in found.variance.collect()}
    assert len(shares) == 8
    for g, xy in groups.items():
        centred = xy - xy.mean(axis=0)
        values, vectors = np.linalg.eigh(np.cov(centred.T))
        order = np.argsort(values)[::-1][:2]
        assert [shares[g, c]["variance_share"] for c in (1, 2)] == pytest.approx(list(values[order] / values.sum()))
        assert [shares[g, c]["variance"] for c in (1, 2)] == pytest.approx(list(values[order]))
        placed = np.array([[p["pca1"], p["pca2"]] for p in found.points.filter(F.col("reporter") == g).orderBy("partner").collect()])
        # The direction of an axis is free in theory; here the largest entry of the vector is positive.
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(3)])
        assert placed == pytest.approx(centred @ (vectors * signs)[:, order], abs=1e-8)
    for g in lone:
        assert [(shares[g, c]["variance"], shares[g, c]["variance_share"]) for c in (1, 2)] == [(0, None)] * 2
        assert all(p["pca1"] == 0 and p["pca2"] == 0 for p in found.points.filter(F.col("reporter") == g).collect())


def test_checkpoints_keep_a_directory_already_set(spark):
    from portolan.plans.session import ensure_checkpoints

    ensure_checkpoints(spark)
    before = spark.sparkContext.getCheckpointDir()
    ensure_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir() == before
    assert segments.settled(spark.range(3)).agg(F.sum("id")).first()[0] == 3
