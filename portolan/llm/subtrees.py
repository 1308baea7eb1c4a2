"""Substring dedup with prefix-partitioned suffix trees over words.

Suffixes of the corpus are split by prefix into groups that fit a task; each
group gets its own subtree. The first split is by the anchor string that
represents a window (``repeats``), prefixes that occur in one document only are
dropped, and a group that is still too large is split by the longest prefix, the
whole window. A subtree is kept as its sorted suffixes and the common prefixes
of neighbours: an internal node is a run of suffixes whose common prefixes reach
its depth. The nodes of depth ``length`` and more are the repeats; each carries
the smallest document order below it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.repeats import GROUP_UNITS, Words, remove_repeats

LENGTH = 13
PREFIX = 5


def deep_nodes(suffixes: np.ndarray) -> np.ndarray:
    """Node of full depth above each suffix, numbered in the order of the sorted suffixes."""
    order = np.lexsort(suffixes.T[::-1])
    ordered = suffixes[order]
    same = ordered[1:] == ordered[:-1]
    common = np.where(same.all(axis=1), suffixes.shape[1], np.argmin(same, axis=1))
    node = np.concatenate(([0], np.cumsum(common < suffixes.shape[1])))
    out = np.empty(len(order), np.int64)
    out[order] = node
    return out


def _search(length: int):
    def found(groups: list, hashes: list, contexts: list, orders: list, counts: list) -> list[tuple]:
        names: dict[bytes, int] = {}
        ids = [np.array([names.setdefault(w, len(names)) for w in c.split(b" ")], np.int32) for c in contexts]
        sizes = np.array([len(x) - length + 1 for x in ids])
        if not len(sizes):
            return []
        suffixes = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, length) for x in ids])
        node = deep_nodes(suffixes)
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, np.repeat(np.array(orders, np.int64), sizes))
        low = least[node]
        out, at = [], 0
        for h, c, order, count, size in zip(groups, hashes, orders, counts, sizes.tolist()):
            own = low[at : at + size]
            at += size
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ends = np.append(starts[1:], size)
            # the first document keeps its text: rows that could not remove anything stay here
            out += [(h, c, a, b, v) for a, b, v in zip(starts.tolist(), ends.tolist(), own[starts].tolist()) if v < order or count > 1]
        return out

    return found


def dedup_substrings(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_units: int = GROUP_UNITS) -> DataFrame:
    """Removes every word covered by ``length`` words that also start in a document with a smaller id.

    ``docs`` needs doc_id and text; other columns are not read. Returns one row
    per row: doc_id, n_units (words), spans (removed word ranges, maximal,
    end exclusive) and kept (the other words joined by one space, UTF-8). Words
    are what stands between ASCII white space, unchanged. Windows are judged on
    the input. NULL and empty texts have no words and keep nothing. Rows that
    share an id do not remove from each other; a NULL id counts as larger than
    all others, and rows with NULL ids do not remove from each other. An empty
    table gives an empty result.
    """
    return remove_repeats(docs, Words(length, prefix), _search(length), smaller=True, group_units=group_units)


def digest(result: DataFrame) -> DataFrame:
    """The per-document figures of the registered query."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", F.col("n_units").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
