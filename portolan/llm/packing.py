"""Packing documents into sequences by a decomposition into powers of two.

Each document becomes tokens and is cut into pieces whose lengths are powers of
two: as many of the greatest length as fit, then one for each binary digit of the
rest. Pieces of equal length share a bucket, a folder of the written table, and
every piece is a sequence, so that no sequence crosses documents and none needs
padding. Every document is cut by itself: nothing is shuffled, and no group of
documents can grow too large for a task.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.bpe import gather, pre_tokens
from portolan.plans.session import shared_folder

MAX_TOKENS = 1024
#: Id that closes a document.
END_ID = 0
#: Characters of text that are encoded and cut together, at least one document.
BLOCK_CHARS = 4_000_000
#: Characters of one text that are split into pre-tokens together.
SPAN_CHARS = 1_000_000
#: Words whose ids a task keeps at hand.
KNOWN_WORDS = 500_000
#: Places where no pre-token goes on: a space or line end behind anything that is not white space.
BREAK = re.compile(r"\S(?=[ \n])")

# Bytes that stand for themselves in a byte-level vocabulary; the others follow U+00FF in order.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = dict(zip((b for b in range(256) if b not in PLAIN), range(256, 512)))
LETTERS = np.array([ALPHABET.get(b, b) for b in range(256)], "<u2")


def spelled(words: list[str]) -> list[str]:
    """The words in the letters of a byte-level vocabulary; they are mapped together, parted by a byte that no text has."""
    raw = "\udcff".join(words).encode("utf-8", "surrogateescape")  # the byte 0xFF, which stands for itself
    return LETTERS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le").split("\xff") if words else []


def spans(text: str) -> Iterator[str]:
    """The text in spans of about ``SPAN_CHARS`` that have the same pre-tokens as the whole."""
    start = 0
    while len(text) - start > SPAN_CHARS:
        found = BREAK.search(text, start + SPAN_CHARS)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


@cache
def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(spec)
    found.encode_special_tokens = True  # the strings of special tokens are ordinary text
    return found


class Encoder:
    """Ids of texts; the tokenizer's model sees each distinct pre-token once and its ids are put together by position.

    Pre-tokens are encoded independently, so this equals encoding whole texts.
    Characters that this Python does not know may belong to a class of pre-tokens
    that the tokenizer knows; texts that hold one go to the tokenizer whole.
    """

    def __init__(self, spec: str, pattern: str):
        self.tokenizer, self.pattern = _tokenizer(spec), pattern
        self._forget()

    def _forget(self) -> None:
        self.number = defaultdict(count().__next__)
        self.ids, self.sizes, self.strange = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self) -> None:
        """Ids of the words that have come up since the last call."""
        words = list(self.number)[len(self.sizes) :]
        model, ids, sizes = self.tokenizer.model, [], []
        for word in spelled(words):
            found = model.tokenize(word)
            ids += [token.id for token in found]
            sizes.append(len(found))
        unknown = {c for c in set("".join(words)) if unicodedata.category(c) == "Cn"}
        strange = [not unknown.isdisjoint(w) for w in words] if unknown else [False] * len(words)
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
        self.strange = np.concatenate([self.strange, np.array(strange, bool)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > KNOWN_WORDS:
            self._forget()
        number = self.number
        coded = []
        for text in texts:
            parts = [np.fromiter(map(number.__getitem__, pre_tokens(s, self.pattern)), np.int32) for s in spans(text)]
            coded.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        self._learn()
        starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for text, words in zip(texts, coded):
            if self.strange[words].any():
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32))
            else:
                out.append(gather(self.ids, starts[words], self.sizes[words]))
        return out


def decompose(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of documents of the given lengths: the document of each, and its length, the longest first.

    ``most`` is a power of two; each other piece is one binary digit of what ``most`` leaves.
    """
    whole = lengths // most
    powers = 1 << np.arange(most.bit_length() - 2, -1, -1, dtype=np.int64)  # most / 2 down to 1
    digits = (lengths[:, None] & powers) > 0
    counts = np.concatenate([whole[:, None], digits], axis=1).ravel()
    sizes = np.tile(np.concatenate([[most], powers]), len(lengths))
    document = np.repeat(np.arange(len(lengths)), 1 + len(powers))
    return np.repeat(document, counts), np.repeat(sizes, counts)


def crc32(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """CRC-32 of each piece, its ids as little-endian unsigned 32-bit numbers."""
    raw, cuts = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * ends).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]


PIECE = "doc_id long, start long, doc_tokens long, ids array<int>, crc32 long, length int"


def _pieces(spec, pattern: str, most: int, end_id: int):
    def cut(doc_ids: list, texts: list[str], encoder: Encoder) -> pa.RecordBatch:
        end = np.array([end_id], np.int32)
        coded = encoder.encode(texts)
        lengths = np.array([len(x) + 1 for x in coded], np.int64)
        document, sizes = decompose(lengths, most)
        ends = np.cumsum(sizes)
        first = (np.cumsum(lengths) - lengths)[document]
        ids = np.concatenate([x for c in coded for x in (c, end)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids, pa.int64()).take(pa.array(document)), pa.array(ends - sizes - first), pa.array(lengths[document]),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids)),
                pa.array(crc32(ids, ends)), pa.array(sizes.astype(np.int32)),
            ],
            ["doc_id", "start", "doc_tokens", "ids", "crc32", "length"],
        )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, texts, held = Encoder(spec.value, pattern), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= BLOCK_CHARS:
                    yield cut(ids, texts, encoder)
                    ids, texts, held = [], [], 0
        if ids:
            yield cut(ids, texts, encoder)

    return rows


def pack(
    docs: DataFrame, tokenizer: str, pattern: str = public_tokenizers.PATTERN, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
) -> DataFrame:
    """Packs whole documents into sequences of 1 to ``max_tokens`` tokens, a power of two each, without padding.

    ``tokenizer`` is the file of a byte-level BPE whose pre-tokens are the matches
    of ``pattern``. A document is the ids of its text, without special tokens, and
    ``end_id``. Returns one row per piece: doc_id, start (ids of its document in
    front of it), doc_tokens, ids, crc32 (checksum of the ids, for readers of the
    files), sequence_id, offset (always 0: a sequence is one piece) and length. The pieces are written to ``path``, by default a new
    folder in the shared folder, with one folder per length, and read from there:
    a reader of one length gets batches without padding, and sequence ids, which
    are unique but leave gaps, stay the same however often the table is read.

    NULL and empty texts are the end id alone. NULL, repeated and tied ids stay
    documents of their own; a very long text is split and encoded in spans and cut
    like any other; an empty table gives an empty result; other columns are not read.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("the longest sequence must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())  # as large as the vocabulary
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(spec, pattern, max_tokens, end_id), PIECE).select(
        "doc_id", "start", "doc_tokens", "ids", "crc32", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "length"
    )
    path = path or f"{shared_folder(spark).rstrip('/')}/sequences-{uuid.uuid4().hex}"
    pieces.write.option("compression", "zstd").partitionBy("length").parquet(path)
    return spark.read.schema(pieces.schema).parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """Figures of the registered query."""
    return packed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
