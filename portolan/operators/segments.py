"""Partner segmentation: k-means, silhouette, density clusters, principal components.

Input is a partner table with an array column ``features`` (see ``features``).
Every measure works for one reporter or for all of them in the same jobs.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.operators.features import (
    BASIC_FEATURES,
    FEATURES,
    partner_features,
    robust_scaled,
    standard_scaled,
    with_feature_array,
)
from portolan.operators import cells
from portolan.operators import kmeans as clustering
from portolan.operators.tiles import over_tiles
from portolan.plans.session import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Parameters of the published segmentation.
SEED = 42
RESTARTS = 10
EPS = 0.5
MIN_POINTS = 3


class KMeansFit(NamedTuple):
    """Labelled points, centres (group, cluster, center) and the sum of squares within clusters (group, k, inertia)."""

    labelled: DataFrame
    centers: DataFrame
    inertia: DataFrame


def _centers(models: DataFrame, group: str) -> DataFrame:
    return models.select(group, F.posexplode("centers").alias("cluster", "center"))


def kmeans(
    points: DataFrame, k: int = 4, seed: int = SEED, restarts: int = RESTARTS, key: str = "partner", group: str = "reporter"
) -> KMeansFit:
    """K-means on ``features`` of every group with at least ``k`` points; the best of several seeded starts."""
    points = settled(points)
    models = clustering.fit(points, [k], seed, restarts, key, group)
    labelled = clustering.assign(points, models, group).withColumn("cluster", F.col("labels")[0]).drop("labels")
    return KMeansFit(labelled, _centers(models, group), models.select(group, "k", "inertia"))


def _label_distances(a, b, distances) -> pd.DataFrame:
    """Distance sums from each point of ``a`` to the clusters present in ``b``."""
    labels_a = np.stack([np.asarray(x) for x in a["labels"]])
    labels_b = np.stack([np.asarray(x) for x in b["labels"]])
    parts = []
    for labelling in range(labels_a.shape[1]):
        for cluster in np.unique(labels_b[:, labelling]):
            members = labels_b[:, labelling] == cluster
            parts.append(
                pd.DataFrame(
                    {
                        "point": a.key,
                        "labelling": labelling,
                        "own": labels_a[:, labelling],
                        "cluster": cluster,
                        "distance": distances[:, members].sum(axis=1),
                        "members": int(members.sum()),
                    }
                )
            )
    return pd.concat(parts)


def silhouettes(points: DataFrame, key: str = "partner", group: str = "reporter") -> DataFrame:
    """Mean Euclidean silhouette of each labelling, per group.

    ``labels`` is an array of cluster numbers, one per labelling.  A point alone
    in its cluster scores 0; so does a labelling with fewer than two clusters.
    """
    points = settled(points)
    sums = over_tiles(
        points, group, key, ["labels"], _label_distances,
        "point bigint, labelling int, own int, cluster int, distance double, members bigint",
    )
    same = F.col("own") == F.col("cluster")
    means = (
        sums.groupBy(group, "point", "labelling", "own", "cluster")
        .agg(F.sum("distance").alias("distance"), F.sum("members").alias("members"))
        .groupBy(group, "point", "labelling")
        .agg(
            F.max(F.when(same, F.try_divide(F.col("distance"), F.col("members") - 1))).alias("inside"),
            F.min(F.when(~same, F.col("distance") / F.col("members"))).alias("nearest"),
        )
    )
    score = F.coalesce(
        F.try_divide(F.col("nearest") - F.col("inside"), F.greatest("nearest", "inside")), F.lit(0.0)
    )
    lone = F.col("inside").isNull() | F.col("nearest").isNull()
    return means.groupBy(group, "labelling").agg(
        F.avg(F.when(lone, F.lit(0.0)).otherwise(score)).alias("silhouette"), F.count("*").alias("points")
    )


class KMeansSweep(NamedTuple):
    """Scores (group, k, inertia, silhouette, chosen) of every k tried; labels and centres of the chosen one; all models."""

    scores: DataFrame
    labelled: DataFrame
    centers: DataFrame
    models: DataFrame


def kmeans_sweep(
    points: DataFrame, max_k: int = 10, seed: int = SEED, restarts: int = RESTARTS, key: str = "partner", group: str = "reporter"
) -> KMeansSweep:
    """K-means of every group for 2 to ``max_k`` clusters, fewer than points; keeps the k with the best silhouette, the lowest on a tie.

    All groups, numbers of clusters and starts are fitted together, and all
    silhouettes come from one pass over the distances. A group of fewer than three
    points has no scores.
    """
    points = settled(points)
    least = 2
    counts = points.groupBy(group).agg(F.count("*").alias("_n"))
    models = clustering.fit(points, range(least, max_k + 1), seed, restarts, key, group)
    models = models.join(counts, group).filter(F.col("k") < F.col("_n")).drop("_n")
    labelled = settled(clustering.assign(points, models, group))
    found = silhouettes(labelled, key, group).select(group, (F.col("labelling") + least).alias("k"), "silhouette")
    best = Window.partitionBy(group).orderBy(F.desc("silhouette"), "k")
    scores = settled(
        models.join(found, [group, "k"]).withColumn("chosen", F.row_number().over(best) == 1).select(group, "k", "inertia", "silhouette", "chosen")
    )
    chosen = scores.filter("chosen").select(group, "k")
    own = F.element_at("labels", F.col("k") - (least - 1))
    return KMeansSweep(
        scores, labelled.join(chosen, group).withColumn("cluster", own).drop("labels", "k"), _centers(models.join(chosen, [group, "k"]), group), models
    )


def cluster_checks(points: DataFrame, models: DataFrame, key: str = "partner", group: str = "reporter") -> DataFrame:
    """What must hold for every model, per group and k.

    ``points`` counts the points, ``misplaced`` those with a nearer centre than
    that of their cluster, ``off_centre`` the clusters whose centre is not the mean
    of their points; ``total_squares`` adds the squares within clusters to those
    between them, the same for every k.
    """
    width = points.select(F.max(F.size("features"))).first()[0]
    labelled = clustering.assign(points, models, group)
    each = labelled.select(group, key, "features", F.posexplode("labels").alias("_i", "cluster"))
    order = Window.partitionBy(group).orderBy("k")
    numbered = models.select(group, "k", "centers", "inertia", (F.row_number().over(order) - 1).alias("_i"))
    each = each.join(numbered, [group, "_i"])

    def squares(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)

    own = squares(F.col("features"), F.element_at("centers", F.col("cluster") + 1))
    least = F.array_min(F.transform("centers", lambda c: squares(F.col("features"), c)))
    per_cluster = (
        each.select(group, "k", "cluster", "features", "inertia", own.alias("_own"), F.element_at("centers", F.col("cluster") + 1).alias("center"), (own > least).alias("_far"))
        .groupBy(group, "k", "cluster", "center", "inertia")
        .agg(
            F.count("*").alias("n"), F.count_if("_far").alias("far"), F.sum("_own").alias("within"),
            F.array(*[F.avg(F.col("features")[i]) for i in range(width)]).alias("mean"),
        )
    )
    off = F.exists(F.arrays_zip(F.col("mean").alias("a"), F.col("center").alias("b")), lambda x: F.abs(x["a"] - x["b"]) > 1e-9 * (1 + F.abs(x["a"])))
    overall = points.groupBy(group).agg(F.array(*[F.avg(F.col("features")[i]) for i in range(width)]).alias("overall"))
    return (
        per_cluster.join(overall, group).groupBy(group, "k", "inertia")
        .agg(
            F.sum("n").alias("points"), F.sum("far").alias("misplaced"), F.count_if(off).alias("off_centre"),
            (F.sum("within") + F.sum(F.col("n") * squares(F.col("center"), F.col("overall")))).alias("total_squares"), F.sum("within").alias("_within"),
        )
        .withColumn("inertia_holds", F.abs(F.col("_within") - F.col("inertia")) <= 1e-9 * (1 + F.col("inertia")))
        .drop("_within")
    )


def _indexed(points: DataFrame, eps: float, key: str, group: str) -> tuple[DataFrame, cells.Index]:
    points = settled(points)
    return points, cells.Index(points, eps, key, group)


def _counted(points: DataFrame, index: cells.Index, min_points: int) -> DataFrame:
    def count(a, b, near) -> cells.Rows:
        return {"point": a.key.astype("int64"), "neighbours": near.sum(axis=1)}

    counts = (
        index.meet(points, [], count, "point bigint, neighbours bigint")
        .groupBy(index.group, F.col("point").alias(index.key))
        .agg(F.sum("neighbours").alias("neighbours"))
    )
    return points.join(counts, [index.group, index.key]).withColumn("is_core", F.col("neighbours") >= min_points)


def density_core(
    points: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS, key: str = "partner", group: str = "reporter"
) -> DataFrame:
    """Adds ``neighbours`` (points within ``eps``, itself included) and ``is_core``."""
    return _counted(*_indexed(points, eps, key, group), min_points)


def _core_links(a, b, near) -> cells.Rows:
    """For points of ``a``, a core point that stands for the core points in reach that hang together here.

    A core point gets the smallest member of its part of these two blocks: such
    stars keep all connections in one row per point. Any other point gets one row
    for each part in reach; parts are at least a radius apart, so these are few.
    """
    core_a, core_b = a["is_core"].astype(bool), b["is_core"].astype(bool)
    both = near & core_a[:, None] & core_b[None, :]
    label_a, label_b = a.key.astype("int64"), b.key.astype("int64")
    none = np.iinfo("int64").max
    while True:
        new_b = np.minimum(label_b, np.where(both, label_a[:, None], none).min(axis=0))
        new_a = np.minimum(label_a, np.where(both, new_b[None, :], none).min(axis=1))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    point, part = np.nonzero(near & ~core_a[:, None] & core_b[None, :])
    border = np.unique(np.stack([a.key.astype("int64")[point], label_b[part]]), axis=1)
    return {
        "point": np.concatenate([a.key.astype("int64")[core_a], border[0]]),
        "root": np.concatenate([label_a[core_a], border[1]]),
        "is_core": np.repeat([True, False], [int(core_a.sum()), border.shape[1]]),
    }


def _components(links: DataFrame, group: str) -> DataFrame:
    """Smallest connected point of every point, by repeated exchange of labels.

    Each round takes the smallest label among linked points and then the label
    of that label, which doubles the distance covered; labels are written to the
    checkpoint folder every round and the loop ends when none changes.
    """
    pairs = settled(
        links.select(group, F.col("point").alias("u"), F.col("root").alias("w"))
        .unionByName(links.select(group, F.col("root").alias("u"), F.col("point").alias("w")))
        .distinct()
    )
    labels = settled(pairs.groupBy(group, "u").agg(F.least(F.col("u"), F.min("w")).alias("label")))
    while True:
        heard = (
            pairs.join(labels.select(group, F.col("u").alias("w"), F.col("label").alias("theirs")), [group, "w"])
            .groupBy(group, "u")
            .agg(F.min("theirs").alias("theirs"))
        )
        nearer = labels.join(heard, [group, "u"]).select(
            group, "u", F.col("label").alias("before"), F.least("label", "theirs").alias("label")
        )
        onward = labels.select(group, F.col("u").alias("label"), F.col("label").alias("next"))
        labels = settled(
            nearer.join(onward, [group, "label"]).select(group, "u", "before", F.least("label", "next").alias("label"))
        )
        if labels.filter(F.col("label") != F.col("before")).isEmpty():
            return labels.select(group, "u", "label")
        labels = labels.select(group, "u", "label")


def density_clusters(
    points: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS, key: str = "partner", group: str = "reporter"
) -> DataFrame:
    """Density clusters numbered from 0 per group; noise is -1.

    Core points within ``eps`` of each other share a cluster.  A border point
    joins the lowest-numbered cluster with a core point in reach.  Clusters are
    numbered by their smallest core key.
    """
    points, index = _indexed(points, eps, key, group)
    cored = settled(_counted(points, index, min_points))
    links = settled(index.meet(cored, ["is_core"], _core_links, "point bigint, root bigint, is_core boolean").distinct())
    components = _components(links.filter("is_core"), group)
    numbers = components.select(group, "label").distinct().withColumn(
        "cluster", F.row_number().over(Window.partitionBy(group).orderBy("label")) - 1
    )
    known = components.join(numbers, [group, "label"]).select(group, F.col("u").alias("root"), "cluster")
    # a core point is the root of a link of its own, so both kinds of points find their cluster by one
    reached = (
        links.join(known, [group, "root"]).groupBy(group, F.col("point").alias(key)).agg(F.min("cluster").alias("cluster"))
    )
    return cored.join(reached, [group, key], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def density_summary(clustered: DataFrame, key: str = "partner", group: str = "reporter") -> DataFrame:
    """Clusters, noise points and silhouette (0 below two clusters) per group.

    Noise takes part in the silhouette as one more cluster.
    """
    counts = clustered.groupBy(group).agg(
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise"),
    )
    scores = silhouettes(clustered.withColumn("labels", F.array("cluster")), key, group)
    return counts.join(scores, group).select(
        group, "n_clusters", "n_noise",
        F.when(F.col("n_clusters") > 1, F.col("silhouette")).otherwise(F.lit(0.0)).alias("silhouette"),
    )


class Components(NamedTuple):
    """Points with ``pca1..n``, and of each group and component its variance and share of the whole."""

    points: DataFrame
    variance: DataFrame


def _axes(covariances: pa.Array) -> pa.Array:
    """Eigenvalues, falling, and eigenvectors of the matrices of many groups; the largest entry of a vector is positive."""
    lists = covariances.flatten().to_numpy().reshape(len(covariances), -1)
    width = math.isqrt(lists.shape[1])
    values, vectors = np.linalg.eigh(lists.reshape(-1, width, width))
    values, vectors = np.maximum(values[:, ::-1], 0), np.swapaxes(vectors[:, :, ::-1], 1, 2)
    top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=2)[:, :, None], axis=2)
    vectors = vectors * np.where(top < 0, -1.0, 1.0)
    return pa.array([{"values": v, "vectors": list(x)} for v, x in zip(values, vectors)], pa.struct({"values": pa.list_(pa.float64()), "vectors": pa.list_(pa.list_(pa.float64()))}))


def principal_components(points: DataFrame, n: int = 2, group: str = "reporter") -> Components:
    """Principal components of ``features`` about their mean, for every group in one job.

    Spark adds up the covariances of all groups in one pass; one row per group goes
    to the solver, whichever the number of its points. A group without variance has
    NULL shares, and zero coordinates.
    """
    width = points.select(F.max(F.size("features"))).first()[0] or 0
    x = [F.col("features")[i] for i in range(width)]
    moments = points.groupBy(group).agg(
        F.array(*[F.avg(c) for c in x]).alias("_mean"),
        F.array(*[F.coalesce(F.covar_samp(x[min(i, j)], x[max(i, j)]), F.lit(0.0)) for i in range(width) for j in range(width)]).alias("_covariance"),
    )
    solve = F.arrow_udf(_axes, "struct<values: array<double>, vectors: array<array<double>>>")
    models = settled(moments.withColumn("_axes", solve("_covariance")).select(group, "_mean", "_axes.values", "_axes.vectors"))

    def place(i: int):
        centred = F.zip_with("features", "_mean", lambda a, m: a - m)
        return F.aggregate(F.zip_with(centred, F.col("vectors")[i], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    shown = min(n, width)
    placed = points.join(models, group).select(*points.columns, *[place(i).alias(f"pca{i + 1}") for i in range(shown)])
    whole = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    variance = models.select(group, whole.alias("_whole"), F.posexplode(F.slice("values", 1, shown)).alias("_i", "variance")).select(
        group, (F.col("_i") + 1).alias("component"), "variance", F.try_divide("variance", "_whole").alias("variance_share")
    )
    return Components(placed, variance)


def component_checks(found: Components, group: str = "reporter") -> DataFrame:
    """What must hold for all components of every group.

    ``total_variance`` and the sums ``power2`` to ``power5`` of powers of the shares
    determine the variances; ``scores_match`` tells whether the coordinates have
    these variances, and no covariance between components.
    """
    names = [c for c in found.points.columns if c.startswith("pca")]
    width = len(names)
    share = F.coalesce("variance_share", F.lit(0.0))
    sums = found.variance.groupBy(group).agg(
        F.sum("variance").alias("total_variance"), *[F.sum(F.pow(share, F.lit(m))).alias(f"power{m}") for m in range(2, 6)],
        F.transform(F.sort_array(F.collect_list(F.struct("component", "variance"))), lambda s: s["variance"]).alias("_variances"),
    )
    covariances = found.points.groupBy(group).agg(
        *[F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(f"_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    )
    match = F.lit(True)
    for i in range(width):
        for j in range(i, width):
            match = match & (F.abs(F.col(f"_{i}_{j}") - (F.col("_variances")[i] if i == j else 0.0)) <= 1e-9 * (1 + F.col("total_variance")))
    return sums.join(covariances, group).withColumn("scores_match", match).select(group, "total_variance", *[f"power{m}" for m in range(2, 6)], "scores_match")


class Segmentation(NamedTuple):
    """All results of a segmentation run."""

    partners: DataFrame
    sweep: DataFrame
    centers: DataFrame
    density: DataFrame
    variance: DataFrame


def basic_segments(flows: DataFrame, countries: DataFrame, focal: int | None = None, k: int = 4, seed: int = SEED) -> Components:
    """Four standardised features, k-means with a fixed k and two components."""
    points = settled(
        with_feature_array(standard_scaled(partner_features(flows, countries, focal), BASIC_FEATURES), BASIC_FEATURES)
    )
    return principal_components(kmeans(points, k, seed).labelled, 2)


def partner_points(
    flows: DataFrame, countries: DataFrame, focal: int | None = None, columns: Sequence[str] = FEATURES
) -> DataFrame:
    """Partner table with robustly scaled features as an array."""
    return with_feature_array(robust_scaled(partner_features(flows, countries, focal), columns), columns)


def partner_segments(
    flows: DataFrame, countries: DataFrame, focal: int | None = None, max_k: int = 10, seed: int = SEED, restarts: int = RESTARTS
) -> Segmentation:
    """Five robustly scaled features, swept k-means, density clusters, three components, for one reporter or all.

    A reporter of fewer than three partners has NULL as cluster of the sweep.
    """
    points = settled(partner_points(flows, countries, focal))
    sweep = kmeans_sweep(points, max_k, seed, restarts)
    dense = settled(density_clusters(points))
    placed = principal_components(points, 3)
    labels = sweep.labelled.select("reporter", "partner", F.col("cluster").alias("kmeans_cluster"))
    noise = dense.select("reporter", "partner", F.col("cluster").alias("dbscan_cluster"))
    partners = placed.points.join(labels, ["reporter", "partner"], "left").join(noise, ["reporter", "partner"])
    return Segmentation(partners, sweep.scores, sweep.centers, density_summary(dense), placed.variance)
