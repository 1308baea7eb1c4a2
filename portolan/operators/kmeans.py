"""K-means of every group, for several numbers of clusters and many starts, in one run of jobs.

The state is a table: one row per group, number of clusters and start, with the
centres as an array. A round deals the points of each group into blocks of bounded
size, joins every block to the state of its group, and sums in each task the points
nearest to each centre; Spark adds the sums of all blocks to the next state. All
groups, numbers of clusters and starts share the round, so the number of jobs
depends on the slowest of them, not on how many there are. The state is written to
the checkpoint folder after each round, and a lost executor costs one round at most.

Starts follow the k-means++ rule: each next centre is a point drawn with probability
proportional to its squared distance from the nearest centre so far. The draw is the
minimum of exponential clocks, one per point, which tasks and Spark take without
looking at all points together. The clocks depend on seed, start and key alone, so
results do not depend on partitions. A start with fewer centres is the beginning of
one with more.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.plans.session import settled

#: Points of a group in one block, on average.
BLOCK = 1024
#: Rounds after which centres that still move are left as they are.
MAX_ROUNDS = 300
#: Centres closer than this, relative to their size, are at one place; inertias closer than this are equal.
SAME = 1e-12

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CENTERS = "array<array<double>>"


def blocks_of(points: DataFrame, key: str, group: str) -> DataFrame:
    """(group, block, keys, features): the points of a group in blocks of about ``BLOCK``."""
    sizes = points.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    return (
        points.join(sizes, group)
        .groupBy(group, F.pmod(F.xxhash64(key), "_blocks").alias("block"))
        .agg(F.collect_list(F.struct(F.col(key).cast("bigint").alias("key"), "features")).alias("rows"))
        .select(group, F.col("rows.key").alias("keys"), F.col("rows.features").alias("features"))
    )


def _matrix(vectors: pa.Scalar) -> np.ndarray:
    """A list of lists of equal length as a matrix."""
    rows = vectors.values
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, by differences: products would lose the digits that tell near centres apart."""
    out = np.zeros((len(points), len(centers)))
    for axis in range(points.shape[1]):
        out += (points[:, axis, None] - centers[None, :, axis]) ** 2
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers from counters."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def clocks(keys: np.ndarray, seed: int, start: int, turn: int) -> np.ndarray:
    """Standard exponential numbers, one per key."""
    salt = np.uint64(0)
    for part in (seed, start, turn):
        salt = _mixed(np.array([salt ^ np.uint64(part & 0xFFFFFFFF)], np.uint64))[0]
    uniform = (_mixed(_mixed(keys.astype(np.int64).view(np.uint64)) ^ salt) >> np.uint64(11)).astype(np.float64)
    return -np.log((uniform + 1) / 2.0**53)


def _draws(seed: int, starts: int, turn: int, group: str):
    """For every start, the point of a block whose clock rings first; a point on a centre never rings before another."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {group: [], "restart": [], "clock": [], "key": [], "center": []}
            for i in range(batch.num_rows):
                keys, points = batch.column("keys")[i].values.to_numpy(), _matrix(batch.column("features")[i])
                held = {s["restart"].as_py(): _matrix(s["centers"]) for s in batch.column("state")[i].values} if turn else {}
                for start in range(starts):
                    clock = clocks(keys, seed, start, turn)
                    if turn:
                        weight = squares(points, held[start]).min(axis=1)
                        clock = np.divide(clock, weight, out=np.full(len(keys), np.inf), where=weight > 0)
                    first = np.lexsort((keys, clock))[0]
                    for name, value in zip(out, (batch.column(group)[i].as_py(), start, float(clock[first]), int(keys[first]), points[first].tolist())):
                        out[name].append(value)
            kinds = [batch.schema.field(group).type, pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return rows


def _with_state(blocks: DataFrame, state: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Every block with the models of its group, whose number is that of the clusters and starts tried."""
    models = state.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("state"))
    return blocks.join(models, group)


def seeded(blocks: DataFrame, most: int, starts: int, seed: int, group: str, kind: str) -> DataFrame:
    """(group, restart, centers): ``most`` centres per start, in the order in which they were drawn."""
    state = None
    for turn in range(most):
        met = blocks if state is None else _with_state(blocks, state, ["restart", "centers"], group)
        drawn = (
            met.mapInArrow(_draws(seed, starts, turn, group), f"{group} {kind}, restart int, clock double, key bigint, center array<double>")
            .groupBy(group, "restart").agg(F.min_by("center", F.struct("clock", "key")).alias("center"))
        )
        one = F.array("center")
        if state is None:
            state = settled(drawn.select(group, "restart", one.alias("centers")))
        else:
            state = settled(state.join(drawn, [group, "restart"]).select(group, "restart", F.concat("centers", one).alias("centers")))
    return state


def _sums(group: str):
    """For every model the number, sum and squared distance of the points of a block nearest to each centre."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {group: [], "k": [], "restart": [], "cluster": [], "n": [], "total": [], "error": []}
            for i in range(batch.num_rows):
                points, of = _matrix(batch.column("features")[i]), batch.column(group)[i].as_py()
                for model in batch.column("state")[i].values:
                    away = squares(points, _matrix(model["centers"]))
                    nearest = away.argmin(axis=1)
                    error = away[np.arange(len(points)), nearest]
                    for cluster in np.unique(nearest).tolist():
                        own = nearest == cluster
                        row = (of, model["k"].as_py(), model["restart"].as_py(), cluster, int(own.sum()), points[own].sum(axis=0).tolist(), float(error[own].sum()))
                        for name, value in zip(out, row):
                            out[name].append(value)
            kinds = [batch.schema.field(group).type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return rows


def _vector_sum(vector: str, width: int) -> Column:
    return F.array(*[F.sum(F.col(vector)[i]) for i in range(width)])


def _round(blocks: DataFrame, state: DataFrame, width: int, group: str, kind: str) -> DataFrame:
    """The state after one more round: centres are the means of their points, a centre without points stays."""
    sums = (
        _with_state(blocks, state, ["k", "restart", "centers"], group)
        .mapInArrow(_sums(group), f"{group} {kind}, k int, restart int, cluster int, n bigint, total array<double>, error double")
        .groupBy(group, "k", "restart", "cluster")
        .agg(F.sum("n").alias("n"), _vector_sum("total", width).alias("total"), F.sum("error").alias("error"))
    )
    center = F.transform("total", lambda x: x / F.col("n"))
    found = sums.groupBy(group, "k", "restart").agg(
        F.map_from_entries(F.collect_list(F.struct("cluster", center))).alias("means"), F.sum("error").alias("inertia")
    )
    centers = F.transform("centers", lambda old, i: F.coalesce(F.try_element_at("means", i.cast("int")), old))
    # sums of the same points may end in other digits when their blocks arrive in another order
    apart = F.exists(F.arrays_zip(F.flatten("centers").alias("a"), F.flatten(F.col("_to")).alias("b")), lambda x: F.abs(x["a"] - x["b"]) > SAME * (1 + F.abs(x["a"])))
    joined = state.select(group, "k", "restart", "centers").join(found, [group, "k", "restart"]).withColumn("_to", centers)
    return joined.select(group, "k", "restart", F.col("_to").alias("centers"), "inertia", apart.alias("moved"))


def fit(
    points: DataFrame, ks: Sequence[int], seed: int, restarts: int, key: str = "partner", group: str = "reporter", max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """The best of ``restarts`` starts for each number of clusters: (group, k, restart, centers, inertia, converged).

    ``points`` (group, key, features) is a written table; keys are whole numbers.
    A number of clusters is tried where the group has that many points. Rounds go
    on until no centre of any model moves, or ``max_rounds``; the inertia is that
    of the last assignment, and the first of equally good starts wins.
    """
    kind = points.schema[group].dataType.simpleString()
    width = points.select(F.max(F.size("features"))).first()[0] or 0
    blocks = settled(blocks_of(points, key, group))
    drawn = seeded(blocks, max(ks), restarts, seed, group, kind)
    counts = points.groupBy(group).agg(F.count("*").alias("_n"))
    moving = (
        drawn.join(counts, group)
        .withColumn("k", F.explode(F.array(*[F.lit(k).cast("int") for k in ks]))).filter(F.col("k") <= F.col("_n"))
        .select(group, "k", "restart", F.slice("centers", F.lit(1), F.col("k")).alias("centers"))
    )
    parts = []
    for turn in range(max_rounds):
        state = settled(_round(blocks, moving, width, group, kind))
        moving = state.filter("moved")
        if turn + 1 == max_rounds or moving.isEmpty():
            parts.append(state)
            break
        parts.append(state.filter("NOT moved"))
    models = Window.partitionBy(group, "k")
    # starts that end in the same clusters differ in the last digits of their sums, by blocks: the first of them is taken
    tied = F.col("inertia") <= F.min("inertia").over(models) * (1 + SAME)
    return settled(
        reduce(DataFrame.unionByName, parts).withColumn("_tied", tied).filter("_tied")
        .withColumn("_place", F.row_number().over(models.orderBy("restart"))).filter("_place = 1")
        .select(group, "k", "restart", "centers", "inertia", (~F.col("moved")).alias("converged"))
    )


def assign(points: DataFrame, models: DataFrame, group: str = "reporter") -> DataFrame:
    """Points with ``labels``: the number of the nearest centre in each model of their group, in order of ``models.k``.

    The lowest of centres at one distance wins. Points of a group without models
    are left out.
    """

    def away(vector: Column, center: Column) -> Column:
        return F.aggregate(F.zip_with(vector, center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    def nearest(model: Column) -> Column:
        found = F.transform(model["centers"], lambda c: away(F.col("features"), c))
        return F.array_position(found, F.array_min(found)).cast("int") - 1

    per_group = models.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("k", "centers"))).alias("_models"))
    return points.join(per_group, group).withColumn("labels", F.transform("_models", nearest)).drop("_models")
