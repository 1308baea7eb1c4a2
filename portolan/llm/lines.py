"""Line dedup by a segment-partition edit join.

A line of length l may differ from another in tau(l) characters. It is cut into
tau(l) + 1 segments; a line within that distance holds at least one of them
unchanged. Every line files its segments under (length, segment, text), and every
line asks, for each length its partner may have, for the few substrings that can
be such a segment given its place and both lengths. Files that hold one line only
are dropped; the others fetch their text and are verified in blocks of bounded
size with a banded bit-parallel edit distance. A pair that meets in several files
counts in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import LAST, groups, stored
from portolan.llm.graph import components
from portolan.llm.vectors import connected

#: Differing characters allowed at most ...
TAU = 2
#: ... and one for so many characters of the shorter line; lines below are compared for equality.
CHARS_PER_EDIT = 20
#: Lines in one block of a large file.
BLOCK = 512
#: Cells of the matrix of line pairs that are verified together, unless it is one pair.
PAIR_CHARS = 2_000_000


def tau_of(length: int, tau: int = TAU, per_edit: int = CHARS_PER_EDIT) -> int:
    return min(tau, length // per_edit)


def segment(length: int, i: int, tau: int) -> tuple[int, int]:
    """Start and size of segment ``i`` of tau + 1 segments of nearly equal size, longer ones last."""
    size, rest = divmod(length, tau + 1)
    longer = tau + 1 - rest
    return i * size + max(0, i - longer), size + (i >= longer)


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that have to be asked for.

    ``shift`` is the distance of a substring from the segment's own start. Left of
    the segment at most i edits can have happened, right of it tau - i.
    """
    return [
        (more, i, shift)
        for more in range(tau + 1)
        for i in range(tau + 1)
        for shift in range(-i, i + 1)
        if abs(shift - more) <= tau - i
    ]


def first_meeting(short: str, long: str, tau: int) -> tuple[int, int] | None:
    """The first (segment, shift) in which two lines meet."""
    more = len(long) - len(short)
    for d, i, shift in probes(tau):
        if d == more:
            start, size = segment(len(short), i, tau)
            if start + shift >= 0 and long[start + shift : start + shift + size] == short[start : start + size]:
                return i, shift
    return None


def within(short: list[str], long: list[str], tau: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its tau; ``long`` is not shorter.

    One bit per diagonal of the band and one word per number of edits: bit d of
    word e is set if short[: j + d] and long[:j] are within e edits. A column of
    the matrix is a few word operations, done for all pairs at once.
    """
    n, top = len(short), int(tau.max()) if len(tau) else 0
    width = max(map(len, long), default=0)
    chars = np.full((n, width + 2 * top + 1), -2, np.int32)
    other = np.full((n, width + 1), -1, np.int32)
    for k, (a, b) in enumerate(zip(short, long)):
        chars[k, top : top + len(a)] = np.frombuffer(a.encode("utf-32-le"), np.int32)
        other[k, : len(b)] = np.frombuffer(b.encode("utf-32-le"), np.int32)
    chars, other = chars.T.copy(), other.T.copy()  # a column of all pairs lies together
    kind = np.uint8 if 2 * top + 1 <= 8 else np.int64
    band = kind((1 << (2 * top + 1)) - 1)
    bits = [kind(1 << d) for d in range(2 * top + 1)]
    one = kind(1)
    state = np.zeros((top + 1, n), kind)
    for e in range(top + 1):
        state[e] = sum(1 << (top + d) for d in range(e + 1))
    sizes = np.array([len(b) for b in long], np.int64)
    apart = np.array([len(a) - len(b) for a, b in zip(short, long)], np.int64)
    ends = set(sizes.tolist())
    out = np.zeros(n, bool)
    live = np.arange(n)
    for j in range(width + 1):
        if j in ends:
            at = np.flatnonzero(sizes[live] == j)
            ended = live[at]
            final = state[tau[ended], at].astype(np.int64)
            out[ended] = (final >> (top + apart[ended])) & 1 == 1
        if j % 16 == 15:
            keep = (sizes[live] > j) & (state[top] != 0)
            if keep.sum() < 0.75 * len(live):
                live, state, chars, other = live[keep], state[:, keep], chars[:, keep], other[:, keep]
                if not len(live):
                    break
        match = np.zeros(len(live), kind)
        for d, bit in enumerate(bits):
            match |= (chars[j + d] == other[j]) * bit
        new = np.empty_like(state)
        new[0] = state[0] & match
        for e in range(1, top + 1):
            new[e] = ((state[e] & match) | state[e - 1] | (state[e - 1] >> one) | (new[e - 1] << one)) & band
        state = new
    return out


def _files(tau: int, per_edit: int) -> Column:
    """Array of (key, i, shift, filed) of a column ``line`` with its length ``size``."""
    rows = []
    for t in range(1, tau + 1):
        for more, i, shift in probes(t):
            length = F.col("size") - more
            applies = (F.least(F.lit(tau), F.floor(length / per_edit)) == t) & (length > 0)
            size, longer = F.floor(length / (t + 1)), F.lit(t + 1) - length % (t + 1)
            start = F.lit(i) * size + F.greatest(F.lit(0), F.lit(i) - longer) + shift
            part = F.substr(F.col("line"), (start + 1).cast("int"), (size + (F.lit(i) >= longer).cast("int")).cast("int"))
            key = F.xxhash64(length.cast("int"), F.lit(i), part)
            rows.append(F.when(applies, F.struct(key.alias("key"), F.lit(i).alias("i"), F.lit(shift).alias("shift"), F.lit(more == 0 and shift == 0).alias("filed"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def _verify(tau: int, per_edit: int):
    """Links of whole files: (line, its links counted here, the smallest line it is connected with here)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, "file", rows=4_000):
            ids, place = np.unique(part.column("g").to_numpy(), return_inverse=True)
            firsts = np.zeros(len(ids), np.int64)
            firsts[place[::-1]] = np.arange(len(place))[::-1]
            text = part.column("line").take(pa.array(firsts)).to_pylist()
            a, b = _linked(part, place.tolist(), text, tau, per_edit)
            if len(a):
                links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
                root = connected(len(ids), a, b)
                used = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(links[used]), pa.array(ids[root[used]])], ["g", "links", "root"])

    return run


def _linked(part: pa.Table, place: list[int], text: list[str], tau: int, per_edit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``text`` of the pairs within their distance whose first meeting is in a file of this part."""
    counts = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) & 63, minlength=64) for t in text]).astype(np.int32)
    sizes = [len(t) for t in text]
    files = part.column("file").to_pylist()
    i, shift, filed, side, low, high = (part.column(c).to_pylist() for c in ("i", "shift", "filed", "side", "low", "high"))
    cuts = [0, *(x for x in range(1, len(files)) if files[x] != files[x - 1]), len(files)]
    found: tuple[list, list] = ([], [])

    def settle(x: list, y: list, meeting: list) -> None:
        """Checks pairs by their letters, by their first meeting and then by their distance."""
        allowed = np.array([tau_of(sizes[k], tau, per_edit) for k in x])
        near = np.flatnonzero(np.abs(counts[x] - counts[y]).sum(axis=1) <= 2 * allowed)
        near = [k for k in near.tolist() if first_meeting(text[x[k]], text[y[k]], int(allowed[k])) == meeting[k]]
        near.sort(key=lambda k: sizes[y[k]])  # a matrix is as wide as its longest line
        start = 0
        for n, k in enumerate(near):
            if n + 1 == len(near) or (n + 2 - start) * sizes[y[near[n + 1]]] > PAIR_CHARS:
                own = near[start : n + 1]
                good = within([text[x[k]] for k in own], [text[y[k]] for k in own], allowed[own])
                for k, yes in zip(own, good.tolist()):
                    if yes:
                        found[0].append(x[k])
                        found[1].append(y[k])
                start, held = n + 1, 0

    x, y, meeting = [], [], []
    for s, e in zip(cuts, cuts[1:]):
        across = low[s] != high[s]
        asking = {(place[r], i[r], shift[r], side[r]) for r in range(s, e)}
        for own, where in {(place[r], side[r]) for r in range(s, e) if filed[r]}:
            size, most = sizes[own], sizes[own] + tau_of(sizes[own], tau, per_edit)
            for other, k, moved, there in asking:
                # of equally long lines the one with the smaller hash is the filed one
                if size <= sizes[other] <= most and (sizes[other] > size or own < other) and not (across and where == there):
                    x.append(own)
                    y.append(other)
                    meeting.append((k, moved))
            if len(x) >= 50_000:
                settle(x, y, meeting)
                x, y, meeting = [], [], []
    if x:
        settle(x, y, meeting)
    return np.array(found[0], np.int64), np.array(found[1], np.int64)


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row per line with a word: its document's order and content, its place, its text and the hash of that."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return (
        docs.select(
            doc_id.alias("doc_id"), doc_id.isNull().cast("int").alias("no_id"), F.coalesce(doc_id, F.lit(LAST)).alias("d"),
            F.xxhash64(text).alias("content"), F.posexplode(F.split(text, "\n")).alias("at", "line"),
        )
        .filter(F.col("line").rlike("[^ \\t-\\r]"))
        .withColumn("g", F.xxhash64("line"))
    )


def line_links(docs: DataFrame, tau: int = TAU, per_edit: int = CHARS_PER_EDIT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(g, links) and (g, component) of the line texts that link with others; ``g`` is a line's 64-bit hash."""
    # different lines only, copies combined before the shuffle: a line of every document is filed once
    lines = stored(
        _occurrences(docs).select("line", "g", F.length("line").alias("size")).filter(F.col("size") >= per_edit)
        .groupBy("g").agg(F.first("line").alias("line"), F.first("size").alias("size"))
    )
    filed = lines.select("g", F.inline(_files(tau, per_edit)))
    whole = Window.partitionBy("key")
    met = (
        filed.withColumn("least", F.min("g").over(whole)).withColumn("most", F.max("g").over(whole)).withColumn("any", F.max("filed").over(whole))
        .filter("least <> most AND any").select("key", "g", "i", "shift", "filed").distinct()
    )
    met = stored(met)
    sizes = met.groupBy("key").agg(F.countDistinct("g").alias("n"))
    texts = lines.select("g", "line").join(met.select("g").distinct().hint("merge"), "g")
    blocks = met.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("side", F.pmod(F.hash("g"), "blocks"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    rows = blocks.select(F.concat_ws("/", "key", low, high).alias("file"), "g", "i", "shift", "filed", "side", low.alias("low"), high.alias("high"))
    found = stored(
        rows.join(texts, "g").repartition("file").sortWithinPartitions("file").mapInArrow(_verify(tau, per_edit), "g long, links long, root long")
    )
    links = found.groupBy("g").agg(F.sum("links").alias("links"))
    return links, components(found.select(F.col("g").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "g")


def near_lines(docs: DataFrame, tau: int = TAU, per_edit: int = CHARS_PER_EDIT, block: int = BLOCK) -> DataFrame:
    """Class and links of every line of ``docs`` (doc_id, text) that has a word.

    Lines are what stands between \\n, compared as they are. Two lines link if
    their edit distance in characters is at most ``tau`` and at most one for every
    ``per_edit`` characters of the shorter one; equal lines are one text. Classes
    are the connected components. Returns, per line, doc_id, line_no (from 0),
    n_links (other texts linked directly), class_doc and class_line (the first
    line of the class, by doc_id and line number) and kept (it is that line).

    NULL, empty and wordless texts have no rows. A NULL id comes after all others.
    Rows equal in id and text count as one document: they keep the same lines. An
    empty table gives an empty result; other columns are not read.
    """
    return _judged(docs, tau, per_edit, block).select("doc_id", F.col("at").alias("line_no"), "n_links", "class_doc", "class_line", "kept")


def _judged(docs: DataFrame, tau: int, per_edit: int, block: int) -> DataFrame:
    links, classes = line_links(docs, tau, per_edit, block)
    place = ["no_id", "d", "content", "at"]
    known = classes.join(links, "g", "left")
    lines = _occurrences(docs).select("doc_id", *place, "g").join(known, "g", "left").withColumn("class", F.coalesce("component", "g"))
    first = lines.groupBy("class").agg(F.min(F.struct(*place)).alias("first"))
    class_doc = F.when(F.col("first.no_id") == 0, F.col("first.d"))
    return lines.join(first, "class").select(
        "doc_id", *place, F.coalesce("links", F.lit(0)).alias("n_links"), class_doc.alias("class_doc"), F.col("first.at").alias("class_line"),
        (F.struct(*place) == F.col("first")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, tau: int = TAU, per_edit: int = CHARS_PER_EDIT, block: int = BLOCK) -> DataFrame:
    """``docs`` without the lines that ``near_lines`` does not keep.

    All rows and columns stay; only ``text`` changes, and ``n_chars`` where there
    is one. Lines without a word stay where they are; NULL stays NULL.
    """
    names = docs.columns
    key = ["no_id", "d", "content"]
    gone = _judged(docs, tau, per_edit, block).filter("NOT kept").groupBy(*key).agg(F.collect_set("at").alias("gone"))
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text.alias("text"), doc_id.isNull().cast("int").alias("no_id"),
        F.coalesce(doc_id, F.lit(LAST)).alias("d"), F.xxhash64(text).alias("content"),
    ).join(gone, key, "left")
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i))
    rows = rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    new = {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row")["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in names])
