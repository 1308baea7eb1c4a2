"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is a weighted set: its word shingles with their counts. Every shingle
is a Poisson process whose rate is its weight; each arrival draws one register of
the signature, and a register keeps the shingle that arrived first. A shingle
stops as soon as its next arrival is later than every register, so most stop at
the first. Two signatures agree in a register with the probability Jaccard
similarity of the sets. Texts that share a band of registers are candidates;
groups of candidates are verified with the exact similarity, block against block
inside tasks, before anything links. No row per pair leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import LAST, groups, stored
from portolan.llm.graph import components
from portolan.llm.vectors import connected

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 22
ROWS = 6
#: Texts in one block of a large group of candidates.
BLOCK = 512
#: What sums of floating-point numbers may lack.
EPSILON = 1e-9
SEED = 0x5EED
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles, ascending, and their counts. Fewer words than a shingle form one."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64), np.array([1])
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = _mixed(out * _MIX[2] + hashed[i : i + n])
    return np.unique(out, return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The shingle that arrives first in each register (zeros for an empty set)."""
    best = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    if not len(items):
        return owner
    state, at, rate = items ^ np.uint64(SEED), np.zeros(len(items)), weights.astype(np.float64)
    live = items
    while len(live):
        state = _mixed(state + _MIX[2])
        at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        early = at < best.max()
        live, state, at, rate = live[early], state[early], at[early], rate[early]
        if not len(live):
            break
        drawn = (_mixed(state ^ _MIX[0]) % np.uint64(registers)).astype(np.int64)
        order = np.argsort(-at, kind="stable")  # the earliest arrival of a register is written last
        slot, when = drawn[order], at[order]
        wins = when < best[slot]
        best[slot[wins]] = when[wins]
        owner[slot[wins]] = live[order][wins]
    return owner


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted items, weights).

    The sum over common items of 1 / sum(max(x / x_i, y / y_i)); with equal
    weights it is the Jaccard similarity. Items are ordered by the ratio of their
    weights, so that each inner sum is a prefix and a suffix.
    """
    items, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = np.zeros(len(items)), np.zeros(len(items))
    x[place[: len(a[0])]], y[place[len(a[0]) :]] = a[1], b[1]
    if not len(items):
        return 0.0
    with np.errstate(divide="ignore"):
        order = np.argsort(np.where(y > 0, x / np.where(y > 0, y, 1), np.inf), kind="stable")
    x, y = x[order], y[order]
    low_y = np.cumsum(y)  # items whose ratio is not larger count by y
    high_x = x.sum() - np.cumsum(x)
    both = (x > 0) & (y > 0)
    return float((1 / (high_x[both] / x[both] + low_y[both] / y[both])).sum())


def _words(text: str | None) -> list[bytes]:
    """Lower-case words between ASCII white space."""
    return (text or "").lower().encode().split()


def _signed(bands: int, rows: int, size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                items, counts = shingles(_words(text), size)
                owner = signature(items, counts, bands * rows).reshape(bands, rows)
                mixed = np.arange(bands, dtype=np.uint64)
                for i in range(rows):
                    mixed = _mixed(mixed * _MIX[2] + owner[:, i])
                keys.append(mixed.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(keys, pa.list_(pa.int64()))], ["v", "keys"])

    return run


def links_among(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Smallest position that each weighted set is connected with by links of ``threshold`` or more.

    With ``side`` only sets of different sides are compared. Shared weights of
    all pairs come from matrix products over the items that two sets share, some
    items at a time. Where no weight differs from one they give the similarity
    itself; else they bound it from above, and a pair that may reach the
    threshold is computed, unless it is connected already.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(items) for items, _ in sets])
    items, column, holders = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True, return_counts=True)
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    total = np.array([w.sum() for _, w in sets], np.float64)
    unit = np.array([bool((w == 1).all()) for _, w in sets])
    shared = holders[column] > 1
    owner, weight = owner[shared], weight[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    common = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        amounts, marks = np.zeros((n, 4096), np.float32), np.zeros((n, 4096), np.float32)
        amounts[owner[a:b], column[a:b] - low] = weight[a:b]
        marks[owner[a:b], column[a:b] - low] = 1
        common += amounts @ marks.T
    both_unit = unit[:, None] & unit[None, :]
    most = np.minimum(common / total[:, None], (common / total[:, None]).T)
    exact = common / (total[:, None] + total[None, :] - common)
    allowed = np.triu(np.ones((n, n), bool), 1)
    if side is not None:
        allowed &= side[:, None] != side[None, :]
    root = connected(n, *np.nonzero(allowed & both_unit & (exact >= threshold - EPSILON)))
    left = np.argwhere(allowed & ~both_unit & (most >= threshold - EPSILON))
    for i, j in left[np.argsort(-most[left[:, 0], left[:, 1]], kind="stable")].tolist() if len(left) else ():
        if root[i] != root[j] and probability_jaccard(sets[i], sets[j]) >= threshold - EPSILON:
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    return root


def _verified(threshold: float, size: int) -> Callable:
    """Verified connections (v, root) inside every block, or pair of blocks, of a group of candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, "file", rows=200):
            names, v, side, low, high = (part.column(c).to_pylist() for c in ("file", "v", "side", "low", "high"))
            cuts = [0, *(x for x in range(1, len(names)) if names[x] != names[x - 1]), len(names)]
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1:
                    sets = [shingles(_words(t), size) for t in part.column("text").slice(s, e - s).to_pylist()]
                    root = links_among(sets, threshold, np.array(side[s:e]) if low[s] != high[s] else None)
                    a = [(v[s + x], v[s + y]) for x, y in enumerate(root.tolist()) if x != y]
                    if a:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*a)], ["a", "b"])

    return run


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows with ``v``, a hash of the text (NULL if it has no word), and the order of the id."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    worded = text.rlike("[^ \\t-\\r]")
    return docs.select(
        doc_id.alias("doc_id"), text.alias("text"), F.when(worded, F.xxhash64(text)).alias("v"),
        F.coalesce(doc_id, F.lit(LAST)).alias("d"), doc_id.isNull().cast("int").alias("no_id"), *more,
    )


def _winners(source: DataFrame, threshold: float, bands: int, rows: int, size: int) -> DataFrame:
    """For every text hash ``v``: ``top``, the row of its class that stays, as (no_id, d, v)."""
    worded = source.filter("v IS NOT NULL")
    signed = worded.select("v", "text").mapInArrow(_signed(bands, rows, size), "v long, keys array<long>").groupBy("v").agg(F.first("keys").alias("keys"))
    in_band = Window.partitionBy("key")
    star = signed.select("v", F.explode("keys").alias("key")).withColumn("a", F.min("v").over(in_band)).filter("a <> v")
    # Whatever shares a band is in one group, so that every candidate pair is inside a group.
    candidates = stored(components(star.select("a", F.col("v").alias("b"))).select(F.col("node").alias("v"), F.col("component").alias("group")))
    sizes = candidates.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    member = candidates.join(sizes, "group").withColumn("side", F.pmod(F.hash("v"), "blocks"))
    texts = worded.select("v", "text").join(member.hint("merge"), "v").groupBy("v", "group", "blocks", "side").agg(F.first("text").alias("text"))
    spread = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    files = spread.select(F.concat_ws("/", "group", low, high).alias("file"), "v", "side", low.alias("low"), high.alias("high"), "text")
    links = stored(files.repartition("file").sortWithinPartitions("file").mapInArrow(_verified(threshold, size), "a long, b long"))
    classes = components(links).withColumnRenamed("node", "v")
    order = F.min(F.struct("no_id", "d", "v"))
    firsts = worded.groupBy("v").agg(F.min(F.struct("no_id", "d")).alias("own"))
    known = firsts.join(classes, "v", "left").select("v", F.coalesce("component", "v").alias("component"), "own.no_id", "own.d")
    return known.select("v", "component").join(known.groupBy("component").agg(order.alias("top")), "component").select("v", "top")


def near_documents(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Class of every row of ``docs`` (doc_id, text): doc_id, class_id and kept.

    Texts link if the probability Jaccard similarity of their lower-case word
    shingles, weighted by count, is ``threshold`` or more; classes are the
    connected components of the links. ``class_id`` is the smallest doc_id of the
    class; ``kept`` marks the one row of the class that stays, which has that id.

    Rows of equal text are one text. A pair exactly at the threshold shares a band
    with probability 0.998; every candidate pair is compared. NULL and wordless texts link with nothing and stay, each a class of its own;
    a text of fewer words than a shingle is one shingle. A NULL id is never the
    smallest; a class without ids has class_id NULL. Of equal rows with the
    class's id one stays. An empty table gives an empty result; other columns are
    not read.
    """
    source = _keyed(docs)
    facts = source.select("doc_id", "v", "d", "no_id").join(_winners(source, threshold, bands, rows, size), "v", "left")
    turn = F.row_number().over(Window.partitionBy("v", "no_id", "d").orderBy("doc_id"))
    first = (F.col("top.v") == F.col("v")) & (F.col("top.d") == F.col("d")) & (F.col("top.no_id") == F.col("no_id")) & (turn == 1)
    class_id = F.when(F.col("top").isNull(), F.col("doc_id")).when(F.col("top.no_id") == 0, F.col("top.d"))
    return facts.select("doc_id", class_id.alias("class_id"), F.coalesce(first, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that ``near_documents`` marks as kept, with all their columns."""
    names = docs.columns
    source = _keyed(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    tops = _winners(source.drop("row"), threshold, bands, rows, size).select("top.v", "top.d", "top.no_id").distinct()
    turn = F.row_number().over(Window.partitionBy("v", "d", "no_id").orderBy("doc_id"))
    stay = source.drop("text").join(tops, ["v", "d", "no_id"]).withColumn("turn", turn).filter("turn = 1").select("row")
    return stay.unionByName(source.filter("v IS NULL").select("row")).select(*[F.col("row")[c].alias(c) for c in names])
