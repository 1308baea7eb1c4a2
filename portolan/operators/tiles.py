"""Distances between all points of a group, block by block.

Some measures need the distance from every point to every other point of the
same reporter.  Points are dealt into blocks of a few hundred rows and every
block meets every block of its group once.  A task compares two blocks in
memory and returns one summary row per point, never a row per pair; blocks have
the same size whatever the shape of the data, so no group or dense region
becomes one large task.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256

# Workers get this module's code with the task and need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Side:
    """One block of a tile: keys, coordinates and further columns as arrays."""

    def __init__(self, rows, columns: Sequence[str]):
        self._values = dict(zip(columns, rows))
        self.key = np.asarray(self["_key"])
        self.points = np.stack([np.asarray(p, dtype=float) for p in self["features"]])

    def __getitem__(self, column: str):
        return self._values[column]


def _blocks(points: DataFrame, group: str, key: str, columns: Sequence[str]) -> DataFrame:
    sizes = points.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("_blocks"))
    rows = F.struct(F.col(key).alias("_key"), *columns)
    return (
        points.join(sizes, group)
        .withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))
        .groupBy(group, "_blocks", "_block")
        .agg(F.collect_list(rows).alias("_rows"))
    )


def over_tiles(
    points: DataFrame,
    group: str,
    key: str,
    columns: Sequence[str],
    compare: Callable[[Side, Side, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Runs ``compare(a, b, distances)`` on every pair of blocks of a group.

    ``points`` has an array column ``features``; ``columns`` are further columns
    to pass along.  ``compare`` returns rows of ``schema`` about the points of
    ``a``; the group column is added in front.
    """
    names = ["_key", "features", *columns]
    blocks = _blocks(points, group, key, names[1:])

    def unpacked(prefix: str):
        return [F.col(f"_rows.{n}").alias(f"{prefix}{n}") for n in names]

    left = blocks.select(group, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"), *unpacked("a_"))
    right = blocks.select(group, F.col("_block").alias("_other"), *unpacked("b_"))
    tiles = left.join(right, [group, "_other"]).drop("_other")
    width = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                a, b = Side(row[1 : 1 + width], names), Side(row[1 + width :], names)
                squares = ((a.points[:, None, :] - b.points[None, :, :]) ** 2).sum(axis=2)
                out = compare(a, b, np.sqrt(squares))
                out.insert(0, group, row[0])
                yield out

    kind = points.schema[group].dataType.simpleString()
    return tiles.mapInPandas(run, f"{group} {kind}, {schema}")
