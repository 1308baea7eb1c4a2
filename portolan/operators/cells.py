"""Pairs of points closer than a radius, by a spatial index of cells.

Space is cut into cubes as wide as the radius along the few features that spread
the points most. Points within the radius lie in the same cell or in cells that
touch, so only those meet; a point alone in its region meets nobody. A crowded
cell is dealt into blocks of bounded size and block meets block in tasks of their
own. Each pair of blocks is visited once, for both sides, and a task returns rows
per point, never a row per pair.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Points of a cell that share a block, on average.
BLOCK = 256
#: Features that span the cells: each one more triples the cells that touch.
AXES = 3

# Workers get this module's code with the task and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Column name to array, as many rows in each.
Rows = dict[str, np.ndarray]


class Side:
    """The points of a block: keys, coordinates and further columns as arrays."""

    def __init__(self, rows: pa.StructArray, columns: Sequence[str]):
        self.key = rows.field("_key").to_numpy()
        vectors = rows.field("features")
        self.points = vectors.flatten().to_numpy().reshape(len(rows), -1)
        self._values = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in columns}

    def __getitem__(self, column: str) -> np.ndarray:
        return self._values[column]


def axes_of(points: DataFrame, radius: float, most: int = AXES) -> list[int]:
    """The features whose cells split the points into most parts; one row per feature comes to the driver."""
    found = (
        points.select(F.posexplode("features").alias("i", "x"))
        .groupBy("i").agg(F.approx_count_distinct(F.floor(F.col("x") / radius), 0.05).alias("cells")).collect()
    )
    return sorted(r["i"] for r in sorted(found, key=lambda r: (-r["cells"], r["i"]))[:most])


def _half(axes: int) -> list[tuple[int, ...]]:
    """Steps to the cell itself and to one of each two opposite neighbours."""
    return [s for s in product((-1, 0, 1), repeat=axes) if s >= (0,) * axes]


class Index:
    """Points of every group filed by cell, and the pairs of blocks that may hold close points.

    The index only depends on coordinates, so that several passes over the same
    points with different columns use it again.
    """

    def __init__(self, points: DataFrame, radius: float, key: str, group: str):
        self.radius, self.key, self.group = radius, key, group
        self.axes = axes_of(points, radius)
        self.cells = self.filed(points).groupBy(group, "_cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
        steps = F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in _half(len(self.axes))])
        there = self.cells.select(group, F.col("_cell").alias("_there"), F.col("_blocks").alias("_there_blocks"))
        near = (
            self.cells.withColumn("_step", F.explode(steps))
            .withColumn("_there", F.zip_with("_cell", "_step", lambda a, b: a + b))
            .join(there, [group, "_there"])
        )
        same = F.col("_cell") == F.col("_there")
        tiles = near.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        first = F.when(same, F.col("_block")).otherwise(F.lit(0))
        self.tiles = tiles.withColumn("_there_block", F.explode(F.sequence(first, F.col("_there_blocks") - 1))).select(
            group, "_cell", "_block", "_there", "_there_block"
        )

    def filed(self, points: DataFrame) -> DataFrame:
        """Points with the cell they lie in."""
        return points.withColumn("_cell", F.array(*[F.floor(F.col("features")[i] / self.radius) for i in self.axes]))

    def meet(self, points: DataFrame, columns: Sequence[str], compare: Callable[[Side, Side, np.ndarray], Rows], schema: str) -> DataFrame:
        """Runs ``compare(a, b, near)`` on every pair of blocks in touch, and on the same pair turned round.

        ``near`` tells for each point of ``a`` and of ``b`` whether they lie within
        the radius. ``compare`` returns rows of ``schema`` about points of ``a``; the
        group column is added in front. A block meets itself once.
        """
        group = self.group
        blocks = (
            self.filed(points).join(self.cells, [group, "_cell"])
            .withColumn("_block", F.pmod(F.xxhash64(self.key), F.col("_blocks")).cast("int"))
            .groupBy(group, "_cell", "_block")
            .agg(F.collect_list(F.struct(F.col(self.key).alias("_key"), "features", *columns)).alias("_rows"))
        )
        there = blocks.select(group, F.col("_cell").alias("_there"), F.col("_block").alias("_there_block"), F.col("_rows").alias("_there_rows"))
        same = (F.col("_cell") == F.col("_there")) & (F.col("_block") == F.col("_there_block"))
        met = (
            self.tiles.join(blocks, [group, "_cell", "_block"]).join(there, [group, "_there", "_there_block"])
            .select(group, same.alias("_same"), "_rows", "_there_rows")
        )
        kind = points.schema[group].dataType.simpleString()
        out = StructType.fromDDL(f"{group} {kind}, {schema}")
        return met.mapInArrow(_compared(self.radius, list(columns), compare, group, out.fieldNames()), out)


def _compared(radius: float, columns: list[str], compare, group: str, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, found = [], []
            of, same = batch.column(group).to_pylist(), batch.column("_same").to_pylist()
            left, right = batch.column("_rows"), batch.column("_there_rows")
            for i in range(batch.num_rows):
                a, b = Side(left[i].values, columns), Side(right[i].values, columns)
                squares = ((a.points[:, None, :] - b.points[None, :, :]) ** 2).sum(axis=2)
                near = np.sqrt(squares) <= radius
                turns = [compare(a, b, near)] if same[i] else [compare(a, b, near), compare(b, a, near.T)]
                for rows in turns:
                    found.append(rows)
                    groups += [of[i]] * len(next(iter(rows.values())))
            columns_ = {c: np.concatenate([rows[c] for rows in found]) for c in names[1:]}
            yield pa.RecordBatch.from_arrays([pa.array(groups, batch.schema.field(group).type), *[pa.array(v) for v in columns_.values()]], names)

    return run
