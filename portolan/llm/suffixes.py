"""Suffix-array dedup of bytes with two-stage suffix sorting.

The candidate contexts of ``repeats`` are laid end to end, a few megabytes at a
time, and sorted in two stages: suffixes smaller than their successor are sorted
directly, the others are induced from them by one scan over the buckets of first
bytes. Suffixes are told apart by their first ``length`` bytes, which is all that
the common prefixes of neighbours are asked for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.repeats import GROUP_UNITS, Bytes, remove_repeats

LENGTH = 400
GRAM = 32
#: Bytes that one suffix array holds, unless a single group is larger.
TEXT_BYTES = 1_000_000


def _words(text: np.ndarray, length: int) -> tuple[np.ndarray, list[int]]:
    """Big-endian eight-byte words at every position, and the offsets that cover ``length`` bytes."""
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    return np.ndarray((len(text) + length,), ">u8", padded, strides=(1,)).astype(np.uint64), [*range(0, length - 8, 8), length - 8]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a byte later."""
    n = len(text)
    differs = np.concatenate((text[:-1] != text[1:], [True]))
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    after = np.concatenate((text, [0]))  # the end counts as smaller than any byte
    return (at < n - 1) & (text[at] < after[np.minimum(at + 1, n)])


def reached(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """True at the positions that inducing the wanted ones goes through: from each up to the next that is sorted directly."""
    at = np.arange(len(wanted))
    sorted_before = np.concatenate(([-1], np.maximum.accumulate(np.where(small, at, -1))[:-1]))
    return np.maximum.accumulate(np.where(wanted, at, -1)) > sorted_before


def direct_sort(positions: np.ndarray, words: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Positions sorted by the bytes at ``offsets``, moving at further words only ties that are not all equal there."""
    order = positions[np.argsort(words[positions], kind="stable")]
    first = words[order]
    tied = np.concatenate(([False], first[1:] == first[:-1]))[: len(order)]
    at = np.flatnonzero(tied)
    for offset in offsets[1:]:
        if not len(at):
            break
        differs = words[order[at] + offset] != words[order[at - 1] + offset]
        if not differs.any():
            continue
        run = np.cumsum(np.concatenate(([False], np.diff(at) > 1)))
        broken = np.zeros(run[-1] + 1, bool)
        broken[run[differs]] = True
        loose = at[broken[run]]
        active = np.zeros(len(order), bool)
        active[loose] = active[loose - 1] = True
        where = np.flatnonzero(active)
        group = np.cumsum(~tied[where])
        key = words[order[where] + offset]
        moved = np.lexsort((key, group))
        order[where] = order[where][moved]
        key, group = key[moved], group[moved]
        tied[where] = np.concatenate(([False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])))
        at = np.flatnonzero(tied)
    return order


def suffix_array(text: np.ndarray, length: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their suffixes' first ``length`` bytes: all, or the ``wanted`` and those they are induced from."""
    n = len(text)
    words, offsets = _words(text, length)
    small = smaller_than_next(text)
    needed = np.ones(n, bool) if wanted is None else reached(wanted, small)
    direct = direct_sort(np.flatnonzero(small & needed), words, offsets)
    induced = needed & ~small
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Hands the larger predecessors of sorted suffixes to their buckets; returns those of this bucket."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        own = text[before]
        ranked = np.argsort(own, kind="stable")
        before, own = before[ranked], own[ranked]
        cuts = np.flatnonzero(np.diff(own)) + 1
        mine = before[:0]
        for part in np.split(before, cuts):
            if len(part):
                if text[part[0]] == byte:
                    mine = part
                else:
                    waiting[text[part[0]]].append(part)
        return mine

    if needed[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    for byte in range(256):
        queue = waiting[byte]
        while queue:
            found = np.concatenate(queue)
            out.append(found)
            again = induce(found, byte)
            queue = [again] if len(again) else []
        sorted_here = direct[bounds[byte] : bounds[byte + 1]]
        if len(sorted_here):
            out.append(sorted_here)
            induce(sorted_here, byte)
    return np.concatenate(out) if out else direct


def neighbours_equal(order: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix has a common prefix of ``length`` bytes with the one before it."""
    words, offsets = _words(text, length)
    equal = np.concatenate(([False], np.ones(len(order) - 1, bool)))
    for offset in reversed(offsets):  # neighbours agree in their first bytes and differ, if at all, further on
        at = np.flatnonzero(equal)
        if not len(at):
            break
        equal[at] = words[order[at] + offset] == words[order[at - 1] + offset]
    return equal


def repeated_windows(contexts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its windows occur again in any of them (a context counts ``counts`` times)."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    window = np.ones(len(text), bool)  # positions whose window ends inside their context
    for e in ends.tolist():
        window[e - length + 1 : e] = False
    order = suffix_array(text, length, window)
    order = order[window[order]]
    same = neighbours_equal(order, text, length)
    repeated = np.zeros(len(text), bool)
    repeated[order] = same | np.append(same[1:], False)
    out = []
    for e, size, count in zip(ends.tolist(), sizes.tolist(), counts):
        out.append(repeated[e - size : e - length + 1] | (count > 1))
    return out


def _search(length: int):
    def found(groups: list, hashes: list, contexts: list, orders: list, counts: list) -> list[tuple]:
        out: list[tuple] = []

        def close(a: int, b: int) -> None:
            for i, flags in zip(range(a, b), repeated_windows(contexts[a:b], counts[a:b], length)):
                turns = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()
                out.extend((groups[i], hashes[i], s, e, 0) for s, e in zip(turns[::2], turns[1::2]))

        start = held = 0
        for i in range(len(groups)):
            if i and groups[i] != groups[i - 1] and held >= TEXT_BYTES:
                close(start, i)
                start, held = i, 0
            held += len(contexts[i])
        if start < len(groups):
            close(start, len(groups))
        return out

    return found


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_units: int = GROUP_UNITS) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts anywhere else.

    ``docs`` needs doc_id and text; other columns are not read. Returns one row
    per row: doc_id, n_units (UTF-8 bytes), spans (removed byte ranges, maximal,
    end exclusive) and kept (the remaining bytes, which need not be valid UTF-8).
    Matches do not cross documents; the same document counts, overlaps too, and
    all occurrences go. Strings are judged on the input. NULL and empty texts
    have no bytes. Repeated rows are separate documents, whatever their ids; a
    NULL id is kept as it is. An empty table gives an empty result.
    """
    return remove_repeats(docs, Bytes(length, gram), _search(length), smaller=False, group_units=group_units)


def digest(result: DataFrame) -> DataFrame:
    """The per-document figures of the registered query."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select(
        "doc_id", F.col("n_units").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
