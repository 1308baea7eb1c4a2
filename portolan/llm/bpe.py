"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are split into pre-tokens. Every block of documents numbers its distinct
pre-tokens and sends two kinds of rows: each distinct word once, to be encoded in
the place where all blocks' copies of that word meet, and each document as the
numbers of its pre-tokens in order of position. Ids return to the block and the
documents are put together by position. So each distinct word is merged once in
the whole corpus, however often it occurs, and a frequent word travels once per
block. Decoding joins ids with the token-byte table, whose size is the
vocabulary's.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of text in a block, at least one document.
BLOCK_CHARS = 16_000_000
#: Pre-tokens in a document row, at least one document.
CHUNK_TOKENS = 200_000
#: Words whose ids a task keeps at hand.
KNOWN_WORDS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: per line a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _ranges(test: Callable[[str], bool], last: int) -> str:
    """Regular-expression ranges of all characters up to ``last`` that pass ``test``."""
    codes = np.array([c for c in range(last + 1) if test(chr(c))])
    cuts = np.flatnonzero(np.diff(codes) > 1)
    starts, ends = np.concatenate(([0], cuts + 1)), np.append(cuts, len(codes) - 1)
    return "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(codes[starts].tolist(), codes[ends].tolist()))


@cache
def splitter(pattern: str, wide: bool = True) -> re.Pattern:
    """The pattern with its Unicode classes written as ranges, which the standard library matches fast.

    Without ``wide`` the ranges stop at U+FFFF, which is faster and enough for
    texts without characters above.
    """
    last = sys.maxunicode if wide else 0xFFFF
    letters = _ranges(lambda c: unicodedata.category(c)[0] == "L", last)
    numbers = _ranges(lambda c: unicodedata.category(c)[0] == "N", last)
    # The characters with the White_Space property
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    # inside a class first, then on their own
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    for name, chars in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        pattern = pattern.replace(name, chars)
    return re.compile(pattern)


def pre_tokens(text: str, pattern: str) -> list[str]:
    """The matches of the pattern in a text."""
    narrow = len(text.encode("utf-16-le")) == 2 * len(text)
    return splitter(pattern, not narrow).findall(text)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged until none has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    ends = list(range(1, n + 1))  # end of the part that starts at an index
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = ends[start]
        if not alive[start] or middle >= n or ends[middle] != end:
            continue  # one of the parts has been merged since
        alive[middle] = False
        ends[start] = end
        if end < n:
            before[end] = start
            if (r := ranks.get(word[start : ends[end]])) is not None:
                heapq.heappush(heap, (r, start, ends[end]))
        if (left := before[start]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers below 2**28 as groups of seven bits, the last group of a number marked."""
    numbers = numbers.astype(np.uint32)
    width = 1 + (numbers >= 1 << 7).astype(np.int64) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(4):
        has = width > i
        out[ends[has] - 1 - i] = (numbers[has] >> (7 * i)) & 127
    out[ends - 1] |= 128
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of ``pack``."""
    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw & 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    low = raw & 127
    out = np.zeros(len(ends), np.int64)
    for i in range(4):
        at = starts + i
        has = at <= ends
        out[has] = (out[has] << 7) | low[at[has]]
    return out


def _press(*parts: bytes) -> bytes:
    sizes = np.array([len(x) for x in parts], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def _unpress(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64)) + 4 * n
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _row(target: int, block: int, words: bool, ids: list, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([target], pa.int64()), pa.array([block], pa.int64()), pa.array([words]), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
        ["target", "block", "words", "doc_ids", "blob"],
    )


def _blocks(pattern: str, parts: int) -> Callable:
    """Rows of two kinds for every block, each sent to its ``target``.

    A word row holds those distinct words of the block that one of ``parts``
    places encodes, with their numbers, and goes there. A document row holds some
    documents as the numbers of their pre-tokens and goes to the block's place.
    Blocks are named by a hash of their words in order, so that rows of different
    contents never meet; blocks of equal name have equal words and may share them.
    """

    def closed(docs: list[np.ndarray], ids: list, number: dict[str, int]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(docs)
        order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")  # frequent words get short codes
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        names = [w.encode() for w in number]
        words = [names[i] for i in order.tolist()]
        block = xxhash.xxh3_64_intdigest(b"\0".join(words)) - 2**63
        place = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(parts + 1)).tolist()
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                numbers = by_place[a:b]
                own = [words[i] for i in numbers.tolist()]
                sizes = np.array([len(w) for w in own])
                yield _row(part, block, True, [], _press(pack(np.diff(numbers, prepend=0)), pack(sizes), b"".join(own)))
        start = 0
        ends = np.cumsum([len(d) for d in docs])
        for i in range(len(docs)):
            if i + 1 == len(docs) or ends[i] - (ends[start - 1] if start else 0) >= CHUNK_TOKENS:
                some = docs[start : i + 1]
                blob = _press(pack(np.array([len(d) for d in some])), pack(rank[np.concatenate(some)]))
                yield _row(block, block, False, ids[start : i + 1], blob)
                start = i + 1

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, ids, held, number = [], [], 0, defaultdict(count().__next__)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                docs.append(np.array([number[t] for t in pre_tokens(text, pattern)] if text else [], np.int32))
                ids.append(doc_id)
                held += len(text or "")
                if held >= BLOCK_CHARS:
                    yield from closed(docs, ids, number)
                    docs, ids, held, number = [], [], 0, defaultdict(count().__next__)
        if docs:
            yield from closed(docs, ids, number)

    return rows


def _merged(ranks: dict[bytes, int]) -> Callable:
    """Ids of the words that meet here; each distinct word is merged once. Document rows pass."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for target, block, words, doc_ids, blob in zip(*(batch.column(c).to_pylist() for c in ("target", "block", "words", "doc_ids", "blob"))):
                if not words:
                    yield _row(target, block, words, doc_ids, blob)
                    continue
                numbers, sizes, raw = _unpress(blob, 3)
                ends = np.cumsum(unpack(sizes)).tolist()
                counts, out = [], []
                for a, b in zip([0, *ends[:-1]], ends):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN_WORDS:
                            known.clear()  # bounds the memory; a word seen again is merged again
                        ids = known[word] = merge(word, ranks)
                    counts.append(len(ids))
                    out += ids
                yield _row(block, block, True, [], _press(numbers, pack(np.array(counts)), pack(np.array(out))))

    return rows


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one after another."""
    shift = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    return values[np.repeat(starts - shift, sizes) + np.arange(int(sizes.sum()))]


def _assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as ids: the word rows of a block come first, then its document rows."""
    block, pieces, values, starts, sizes = None, [], None, None, None
    for batch in batches:
        for name, words, doc_ids, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "doc_ids", "blob"))):
            if name != block:
                block, pieces, values = name, [], None
            if words:
                pieces.append(blob)
                continue
            if values is None:
                parts = [[unpack(x) for x in _unpress(p, 3)] for p in pieces]
                numbers = np.concatenate([np.cumsum(x[0]) for x in parts] or [np.zeros(0, np.int64)])
                counts = np.concatenate([x[1] for x in parts] or [numbers])
                values = np.concatenate([x[2] for x in parts] or [numbers]).astype(np.int32)
                n = int(numbers.max()) + 1 if len(numbers) else 0
                starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
                starts[numbers], sizes[numbers] = np.cumsum(counts) - counts, counts
            lengths, codes = (unpack(x) for x in _unpress(blob, 2))
            if len(codes) and (codes.max() >= len(sizes) or not sizes[codes].all()):
                raise RuntimeError("the words of a block changed when its documents were read again")
            ids = gather(values, starts[codes], sizes[codes])
            ends = np.concatenate(([0], np.cumsum(sizes[codes])))
            cuts = ends[np.concatenate(([0], np.cumsum(lengths)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))], ["doc_id", "ids"]
            )


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the ids of the whole text, no special tokens.

    Each match of ``pattern`` is encoded separately. NULL and empty texts have no
    ids; NULL and repeated ids stay rows of their own; an empty table gives an
    empty result; other columns are not read. Words are encoded in as many places
    as the session has shuffle partitions. If a lost task is run again and its
    input has changed meanwhile, the job fails instead of mixing both.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row = "target long, block long, words boolean, doc_ids array<long>, blob binary"
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks(pattern, parts), row)
    merged = blocks.repartition("target").mapInArrow(_merged(ranks), row)
    whole = merged.repartition("block").sortWithinPartitions("block", F.col("words").desc())
    return whole.mapInArrow(_assembled, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, decoded) of rows (doc_id, ids): the bytes of the tokens, one after another.

    The token-byte table has one row per vocabulary entry and goes to every task.
    An id outside the vocabulary is an error; NULL ids decode to no bytes.
    """
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array([len(t) for t in tokens])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    table = np.frombuffer(b"".join(tokens), np.uint8)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 500) for a in range(0, whole.num_rows, 500)):
                out = []
                for ids in batch.column("ids"):
                    ids = np.array(ids.as_py() or [], np.int64) if not ids.is_valid else ids.values.to_numpy()
                    if len(ids) and not (sizes[ids] > 0).all():
                        raise ValueError("an id is not in the vocabulary")
                    out.append(gather(table, starts[ids], sizes[ids]).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The per-document figures of the registered query."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
