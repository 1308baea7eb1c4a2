"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks of equal size. With weight w, the source's
block j (from 1) may not run before slot floor((j - 1) / w) and has to run before
slot ceil(j / w). Of the released blocks the one with the earliest deadline runs,
which on a single lane meets all deadlines: at every slot each source is less
than one block away from its share.

Weights are exact: floats are fractions, and their whole-number ratios give the
windows of every block, so nothing is rounded and no error adds up. One task runs
through the blocks, not the documents, with the sources in a heap and streams the
slots out; every block finds its slot with a join. Documents are never gathered:
they are numbered in their source with counts of hash buckets.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block.
BLOCK = 8
#: Without given weights a source weighs its number of documents to this power.
TEMPER = 0.7
#: Hash buckets that split the numbering of one source.
BUCKETS = 1024
#: Blocks of the schedule in an Arrow batch.
BATCH = 20_000


def whole_ratios(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def release(j: int, share: int, slots: int) -> int:
    """First slot of block ``j`` (from 1)."""
    return (j - 1) * slots // share


def deadline(j: int, share: int, slots: int) -> int:
    """The slot before which block ``j`` has to run."""
    return -(-j * slots // share)


def placed_blocks(ratios: Mapping[str | None, int], blocks: Mapping[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the first ``blocks`` blocks of each source, earliest deadline first."""
    total = sum(ratios.values())
    names = sorted(ratios, key=lambda s: (s is None, s or ""))
    waiting = [(0, i, 1) for i, s in enumerate(names) if blocks[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(j, ratios[names[i]], total), i, j))
        due, i, j = heapq.heappop(ready)
        ratio = ratios[names[i]]
        yield names[i], j, slot, release(j, ratio, total), due
        if j < blocks[names[i]]:
            heapq.heappush(waiting, (release(j + 1, ratio, total), i, j + 1))
        slot += 1


def _numbered(docs: DataFrame, block: int) -> DataFrame:
    """Adds the document's number in its source, in the order of a hash, and the source's block it falls in."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in ("doc_id", "text")])
    rows = docs.withColumn("tie", tie).withColumn("bucket", F.pmod("tie", F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("s", F.xxhash64("source"))
    own = Window.partitionBy("s", "bucket").orderBy("tie", "doc_id")
    small = rows.withColumn("s", F.xxhash64("source"))
    numbered = small.withColumn("within", F.row_number().over(own)).join(counts.select("s", "bucket", "ahead"), ["s", "bucket"])
    return numbered.withColumn("number", F.col("ahead") + F.col("within") - 1).withColumn("block", F.floor(F.col("number") / block))


def mix_exact(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """Place of every row of ``docs`` (doc_id, text, source) in the mixed order.

    Returns doc_id, source, block (of the source, from 0), release, deadline and
    slot of the block, offset (place in the block), and share (of the source in
    all weights). Sorted by slot and offset the sources follow ``weights`` with
    less than one block of deviation at every slot and for any number of sources
    and slots, as long as all have blocks left. Once a source has run out the
    others stay within their windows, so slots can be empty.

    ``weights`` needs a positive number for every source; without it a source
    weighs its number of documents to the power ``TEMPER``. A NULL source is a
    source of its own. No row is dropped or repeated; rows that share everything
    take places of their own, in any order. NULL ids and texts are allowed. An
    empty table gives an empty result. Only the table of sources reaches the
    driver, so their number has to be small against memory, not the documents'.
    The slots are found in one task, in time that grows with the number of blocks.
    """
    rows = docs.select("doc_id", "text", "source")
    return _placed_exact(rows, weights, block).select("doc_id", "source", "block", "release", "deadline", "slot", "offset", "share")


def mixed_order_exact(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs``, sorted into the mixed order of ``mix_exact``."""
    return _in_order(docs, lambda rows: _placed_exact(rows, weights, block))


def _in_order(docs: DataFrame, placed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    names = docs.columns
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    return placed(rows).orderBy("slot", "offset").select(*[F.col("row")[c].alias(c) for c in names])


def source_sizes(docs: DataFrame) -> dict[str | None, int]:
    """Documents of each source."""
    return {r.source: r.n for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}


def source_weights(docs: DataFrame) -> dict[str | None, float]:
    """Default weights of the sources of ``docs``."""
    return {s: float(n) ** TEMPER for s, n in source_sizes(docs).items()}


def _checked(weights: Mapping[str | None, float], present: Iterable[str | None]) -> dict[str | None, float]:
    """The weights of the sources that are present."""
    if missing := [s for s in present if not weights.get(s, 0) > 0]:
        raise ValueError(f"no positive weight for the sources {missing}")
    return {s: weights[s] for s in present}


def _placed_exact(docs: DataFrame, weights: Mapping[str | None, float] | None, block: int) -> DataFrame:
    spark = docs.sparkSession
    sizes = source_sizes(docs.select("source"))
    weights = _checked({s: float(n) ** TEMPER for s, n in sizes.items()} if weights is None else weights, sizes)
    ratios = whole_ratios(weights) if sizes else {}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    total = sum(ratios.values())

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = placed_blocks(ratios, blocks)
            while some := list(islice(found, BATCH)):
                names, numbers, slots, first, due = zip(*some)
                shares = [float(Fraction(ratios[s], total)) for s in names]
                columns = [pa.array(names, pa.string()), pa.array([j - 1 for j in numbers], pa.int64())]
                columns += [pa.array(c, pa.int64()) for c in (slots, first, due)] + [pa.array(shares, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "block", "slot", "release", "deadline", "share"])

    schema = "name string, block long, slot long, release long, deadline long, share double"
    table = spark.range(1, numPartitions=1).mapInArrow(rows, schema).withColumn("s", F.xxhash64("name")).drop("name")
    return _numbered(docs, block).join(table, ["s", "block"]).withColumn("offset", (F.col("number") % block).cast("int"))
