"""Near-duplicate embeddings by random-hyperplane sign hashing in several tables.

Every table draws its own hyperplanes and puts a vector into the bucket of its
signs. Vectors of a bucket are compared exactly, in blocks of bounded size, so
that a bucket of any size is compared whole by many tasks. A pair that meets in
several tables counts in the first of them. Tasks return one row per vector: its
number of links and the smallest vector it is connected with inside the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import groups, settled
from portolan.llm.graph import components

THRESHOLD = 0.95
#: Chance that two vectors exactly at the threshold meet in at least one table.
RECALL = 0.995
#: Vectors that share a bucket by chance, on average.
PER_BUCKET = 8
#: Vectors in one block of a large bucket.
BLOCK = 1024
SEED = 20_051
#: Largest components that need no scaling: squares and their sums stay within the doubles.
PLAIN = (1e-100, 1e100)


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs per table, tables) for ``n`` vectors: buckets keep their size as the data grow, recall stays."""
    bits = min(30, max(6, round(math.log2(max(n, 1) / PER_BUCKET + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _codes(bits: int, tables: int):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                dims = np.array([len(x) for x in batch.column("embedding")])
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    x = np.array(part.column("embedding").to_pylist(), np.float64)
                    signs = (x @ planes(dim, bits, tables) >= 0).reshape(len(x), tables, bits)
                    codes = (signs * weights).sum(axis=2)
                    picked = np.repeat(np.arange(len(x)), tables)
                    flat = pa.array(codes.astype(np.int32)[picked].reshape(-1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(picked), dim, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))),
                            pa.array(codes.reshape(-1)), part.column("v").take(pa.array(picked)), part.column("n").take(pa.array(picked)),
                            part.column("embedding").take(pa.array(picked)), pa.ListArray.from_arrays(pa.array(np.arange(len(picked) + 1, dtype=np.int32) * tables), flat),
                        ],
                        ["dim", "tab", "code", "v", "n", "embedding", "codes"],
                    )

    return rows


def connected(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position each position is connected with."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, "g", rows=4_000):
            names = part.column("g").to_pylist()
            table, side, low, high = (part.column(c).to_numpy() for c in ("tab", "side", "low", "high"))
            v, n = part.column("v").to_numpy(), part.column("n").to_numpy()
            codes = np.array(part.column("codes").to_pylist())
            vectors = part.column("embedding").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for s, e in zip(cuts, cuts[1:]):
                if e - s < 2:
                    continue
                x = np.array(vectors[s:e], np.float64)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                near = x @ x.T >= threshold
                if low[s] != high[s]:  # two blocks of one bucket: only pairs across
                    near &= side[s:e][:, None] != side[s:e][None, :]
                a, b = np.nonzero(np.triu(near, 1))
                if not len(a):
                    continue
                root = connected(e - s, a, b)
                earlier = (codes[s:e][a, : table[s]] == codes[s:e][b, : table[s]]).any(axis=1)
                a, b = a[~earlier], b[~earlier]
                links = np.bincount(a, weights=n[s + b], minlength=e - s) + np.bincount(b, weights=n[s + a], minlength=e - s)
                used = np.flatnonzero((links > 0) | (root != np.arange(e - s)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[s + used]), pa.array(links[used].astype(np.int64)), pa.array(v[s + root[used]])], ["v", "links", "root"]
                )

    return rows


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """Links every two rows whose cosine, in double precision, is ``threshold`` or more.

    Returns one row per row: vec_id, n_links (other rows linked directly),
    component_id (smallest id reachable by links, its own included) and kept
    (the row's id is its component's). Found links are exact; a pair exactly at
    the threshold is found with probability ``recall``, a closer one with more.

    Rows with equal vectors are linked and compared once. Vectors that are NULL,
    empty, zero or hold NULL or non-finite components link with nothing, nor do
    vectors of different lengths. Finite components of any size count. A NULL id is never the smallest; rows without
    any id in reach have component NULL and count as kept. Rows that share an id
    are separate rows. An empty table gives an empty result; other columns are
    not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # squares of very large or very small components leave the doubles; the length of a vector does not matter
    most = F.aggregate("embedding", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    fit = F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(most > 0, F.lit(False))
    rows = rows.withColumn("most", F.when(fit, most))
    scaled = F.transform("embedding", lambda x: x / F.col("most"))
    rows = rows.withColumn("embedding", F.when(F.col("most").between(*PLAIN), F.col("embedding")).otherwise(scaled))
    rows = rows.withColumn("v", F.when(F.col("most").isNotNull(), F.xxhash64("embedding")))
    distinct = settled(
        rows.filter("v IS NOT NULL").groupBy("v")
        .agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    )
    bits, tables = plan_tables(distinct.count(), threshold, recall)
    coded = distinct.select("v", "n", "embedding").mapInArrow(
        _codes(bits, tables), "dim int, tab int, code long, v long, n long, embedding array<double>, codes array<int>"
    )
    bucket = ["dim", "tab", "code"]
    sizes = coded.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = coded.join(sizes, bucket).withColumn("blocks", blocks).withColumn("side", F.pmod(F.hash("v", F.lit(SEED)), "blocks"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        F.concat_ws("/", *bucket, F.least("side", "other"), F.greatest("side", "other")).alias("g"),
        "tab", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "v", "n", "embedding", "codes",
    )
    found = settled(met.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(threshold), "v long, links long, root long"))
    groups_ = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    member = distinct.select("v", "n", "least").join(links, "v", "left").join(groups_.withColumnRenamed("node", "v"), "v", "left")
    member = member.withColumn("component", F.coalesce("component", "v"))
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = member.join(smallest, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "v").join(facts, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
