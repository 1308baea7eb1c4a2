"""Repeated windows of a corpus: candidate search by sliding minima, contexts and removal.

A window is ``length`` consecutive units (bytes or words) of one document. Every
window is represented by the smallest hash among the ``gram``-unit strings inside
it, which depends on the window's content alone: equal windows have equal
representatives. Neighbouring windows mostly share one, so a document shrinks to
a few runs. The text of a run is its *context*. One row per run, (representative,
hash of the context), is grouped by representative: most groups have one row and
are dropped. Where all contexts of a group are equal, its windows are repeats
without a look at the text. Only the others fetch their text, one copy of each
different context, and are searched by the operator's own method. Contexts are
told apart by 64 bits inside the group of a 64-bit representative.

Nothing here depends on how rows are split over tasks, and each step can be
recomputed from its input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import groups, order_id, row_key, stored

ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
#: Units of distinct contexts that one task may search together; a larger group is split by whole windows.
GROUP_UNITS = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * ODD[0]
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in log(width) passes."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


@dataclass(frozen=True)
class Bytes:
    """Windows over the UTF-8 bytes of a text."""

    length: int
    gram: int

    def split(self, text: str | None) -> bytes:
        return (text or "").encode()

    def grams(self, units: bytes) -> np.ndarray:
        n = len(units) - self.gram + 1
        words = np.ndarray((len(units) - 7,), "<u8", units, strides=(1,))
        out = np.zeros(n, np.uint64)
        for i, at in enumerate([*range(0, self.gram - 8, 8), self.gram - 8]):
            out += words[at : at + n] * ODD[i % 4] * np.uint64(2 * i + 1)
        return mixed(out)

    def cut(self, units: bytes, start: int, end: int) -> bytes:
        return units[start:end]


@dataclass(frozen=True)
class Words:
    """Windows over the words of a text: what stands between ASCII white space."""

    length: int
    gram: int

    def split(self, text: str | None) -> list[bytes]:
        return (text or "").encode().split()

    def grams(self, units: list[bytes]) -> np.ndarray:
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units))
        n = len(units) - self.gram + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.gram):
            out = out * ODD[1] + hashed[i : i + n]
        return mixed(out)

    def cut(self, units: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(units[start:end])


Unit = Bytes | Words


def runs(unit: Unit, units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(representative, first window, one after the last window) of each run, and all gram hashes."""
    if len(units) < unit.length:
        return (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64)), np.zeros(0, np.uint64))
    grams = unit.grams(units)
    least = sliding_min(grams, unit.length - unit.gram + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.append(starts[1:], len(least))
    return least[starts].view(np.int64), starts, ends, grams


def _context_hash(context: bytes) -> int:
    return xxhash.xxh3_64_intdigest(context) - 2**63


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _all_runs(unit: Unit, inner: bool) -> Callable:
    """One row per run; with ``inner``, ``again`` tells whether a run can repeat a window of its own."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, cs, sizes, agains, counts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                units = unit.split(text)
                h, start, end, grams = runs(unit, units)
                counts.append(len(h))
                hs.append(h)
                sizes.append(end - start)
                for v, a, b in zip(h.tolist(), start.tolist(), end.tolist()):
                    cs.append(_context_hash(unit.cut(units, a, b - 1 + unit.length)))
                    if inner:
                        near = grams[a : b + unit.length - unit.gram].view(np.int64)
                        agains.append(np.count_nonzero(near == v) > 1)
            times = np.array(counts)
            columns = [
                np.concatenate(hs) if hs else np.zeros(0, np.int64), np.array(cs, np.int64),
                np.repeat(batch.column("k").to_numpy(), times), np.repeat(batch.column("o").to_numpy(), times),
                np.concatenate(sizes).astype(np.int32) if sizes else np.zeros(0, np.int32),
                np.array(agains, bool) if inner else np.zeros(len(cs), bool),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "c", "k", "o", "size", "again"])

    return rows


def _contexts(unit: Unit) -> Callable:
    """Text of the wanted contexts: rows (representative, hash, context, first order, copies, large)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                units = unit.split(text)
                by = {(w["h"], w["c"]): w for w in wanted}
                hs = np.array([w["h"] for w in wanted], np.int64)
                h, start, end, _ = runs(unit, units)
                keep = np.isin(h, hs)
                for v, a, b in zip(h[keep].tolist(), start[keep].tolist(), end[keep].tolist()):
                    context = unit.cut(units, a, b - 1 + unit.length)
                    w = by.pop((v, _context_hash(context)), None)
                    if w:
                        found.append((v, w["c"], context, w["low"], w["n"], w["large"]))
            yield _batch(
                ["h", "c", "context", "o", "n", "large"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()], found
            )

    return rows


def _windows(unit: Unit) -> Callable:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, context, o, n in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "context", "o", "n"))):
                units = context if isinstance(unit, Bytes) else context.split(b" ")
                keys = [xxhash.xxh3_128_digest(unit.cut(units, i, i + unit.length)) for i in range(len(units) - unit.length + 1)]
                yield _batch(
                    ["h", "c", "at", "key", "o", "n"],
                    [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()],
                    [(h, c, i, key, o, n) for i, key in enumerate(keys)],
                )

    return rows


def _searched(search: Callable) -> Callable:
    """Calls ``search`` with the contexts of whole groups: (representatives, hashes, contexts, first orders, copies)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, "h", rows=2_000):
            found = search(*(part.column(x).to_pylist() for x in ("h", "c", "context", "o", "n")))
            yield _batch(["h", "c", "at", "until", "low"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], found)

    return rows


def _removed(unit: Unit) -> Callable:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "found"))):
                units = unit.split(text)
                edge = np.zeros(len(units) + 1, np.int32)
                if found:
                    spans: dict[tuple, list] = {}
                    for f in found:
                        spans.setdefault((f["h"], f["c"]), []).append((f["at"], f["until"]))
                    h, start, end, _ = runs(unit, units)
                    keep = np.isin(h, np.array([v for v, _ in spans], np.int64))
                    for v, a, b in zip(h[keep].tolist(), start[keep].tolist(), end[keep].tolist()):
                        for at, until in spans.get((v, _context_hash(unit.cut(units, a, b - 1 + unit.length))), ()):
                            edge[a + at] += 1
                            edge[a + until - 1 + unit.length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                cuts = [{"start": s, "end": e} for s, e in zip(turns[::2].tolist(), turns[1::2].tolist())]
                ends = [0, *(x for c in cuts for x in (c["start"], c["end"])), len(units)]
                parts = [units[a:b] for a, b in zip(ends[::2], ends[1::2])]
                kept = b"".join(parts) if isinstance(unit, Bytes) else b" ".join(w for p in parts for w in p)
                out.append((doc_id, len(units), cuts, kept))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield _batch(["doc_id", "n_units", "spans", "kept"], [pa.int64(), pa.int64(), span, pa.binary()], out)

    return rows


def remove_repeats(docs: DataFrame, unit: Unit, search: Callable, smaller: bool, group_units: int = GROUP_UNITS) -> DataFrame:
    """Removes what repeated windows cover; see the two operators built on it.

    ``search`` finds, in whole groups of contexts, the windows that count: rows
    (representative, context hash, first window, one after the last, smallest
    order that has them). With ``smaller`` a window counts only against documents
    of a larger order.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().cast("long").alias("k"), order_id().cast("long").alias("o"),
        F.col("text").cast("string").alias("text"),
    )
    seen = source.select("k", "o", "text").mapInArrow(_all_runs(unit, not smaller), "h long, c long, k long, o long, size int, again boolean")
    # A document has hundreds of representatives, so copies of one text spread evenly over the groups.
    group = Window.partitionBy("h").orderBy("k")
    repeated = stored(
        seen.withColumn("before", F.lag("c").over(group)).withColumn("after", F.lead("c").over(group))
        .filter("before IS NOT NULL OR after IS NOT NULL OR again").drop("before", "after")
    )
    whole = Window.partitionBy("h")
    unique = stored(
        repeated.groupBy("h", "c")
        .agg(F.min("o").alias("low"), F.min("k").alias("k"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("again").alias("again"))
        .withColumn("mixed", (F.count(F.lit(1)).over(whole) > 1) | F.max("again").over(whole))
        .withColumn("large", F.sum(F.col("size") + unit.length).over(whole) > group_units)
    )
    fetch = unique.filter("mixed").groupBy("k").agg(F.collect_list(F.struct("h", "c", "low", "n", "large")).alias("wanted"))
    contexts = stored(
        source.join(fetch, "k").select("text", "wanted")
        .mapInArrow(_contexts(unit), "h long, c long, context binary, o long, n long, large boolean")
    )
    alone = unique.filter("NOT mixed AND n > 1").select("h", "c", F.lit(0).alias("at"), F.col("size").alias("until"), "low")
    searched = (
        contexts.filter("NOT large").repartition("h").sortWithinPartitions("h")
        .mapInArrow(_searched(search), "h long, c long, at int, until int, low long")
    )
    found = alone.unionByName(searched).unionByName(_by_window(contexts.filter("large"), unit))
    places = repeated.select("h", "c", "k", "o").distinct().join(found, ["h", "c"])
    if smaller:
        places = places.filter("low < o")
    per_doc = places.groupBy("k", "o").agg(F.collect_list(F.struct("h", "c", "at", "until")).alias("found"))
    return (
        source.join(per_doc, ["k", "o"], "left").select("doc_id", "text", "found")
        .mapInArrow(_removed(unit), "doc_id long, n_units long, spans array<struct<start:long,end:long>>, kept binary")
    )


def _by_window(contexts: DataFrame, unit: Unit) -> DataFrame:
    """The same findings for oversized groups: their windows are counted one by one, keyed by full length."""
    windows = contexts.select("h", "c", "context", "o", "n").mapInArrow(_windows(unit), "h long, c long, at int, key binary, o long, n long")
    counted = windows.groupBy("key").agg(F.min("o").alias("low"), F.sum("n").alias("rows")).filter(F.col("rows") > 1)
    return windows.join(counted, "key").select("h", "c", "at", (F.col("at") + 1).alias("until"), "low")
