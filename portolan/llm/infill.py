"""Fill-in-middle transformation with word-parallel search for the cuts.

The bytes of a batch of texts are viewed as unsigned 64-bit words. Plain
arithmetic marks every byte that ends a unit, ``bitwise_count`` counts the marks
of a word, and running counts answer how many units end before a byte. The end of
a unit is found the other way round: a search in the running counts gives its
word, and sums of marks inside that word, again one multiplication, give its byte.
No text is split and no unit becomes an object; the strings are put together and
taken apart again by Spark's own functions.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 7
#: Percent of documents that are transformed, and of these the percent in the order suffix, prefix, middle.
RATE = 100
SPM_SHARE = 50

ONES = np.uint64(0x0101010101010101)
LOWS = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGHS = np.uint64(0x8080808080808080)


class Markers(NamedTuple):
    """Strings in front of the parts; none may be found in a transformed text."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Marks:
    """Marked bytes of a buffer: the high bit of each marked byte in an array of words, with counts before each word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes in front of byte ``at``."""
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        below = (np.uint64(1) << shift) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Place of the marked byte in front of which there are ``nth`` others."""
        word = np.searchsorted(self.before, nth, side="right") - 1
        inside = (nth - self.before[word]).astype(np.uint64)
        sums = (self.marks[word] >> np.uint64(7)) * ONES  # byte i: marks in the bytes 0 to i
        # 128 + inside - sum never borrows from the next byte, and keeps its high bit where the sum is not above
        not_yet = ((np.uint64(128) + inside) * ONES - sums) & HIGHS
        return (word << 3) + np.bitwise_count(not_yet)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, with at least one zero word behind them."""
    padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8").astype(np.uint64, copy=False)


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """High bit of every byte equal to ``byte``; exact, without carries between bytes."""
    odd = words ^ (np.uint64(byte) * ONES)
    return ~(((odd & LOWS) + LOWS) | odd | LOWS)


def continuation_bytes(words: np.ndarray) -> np.ndarray:
    """High bit of every UTF-8 byte that does not start a character."""
    return words & ~(words << np.uint64(1)) & HIGHS


def find_cuts(starts: np.ndarray, ends: np.ndarray, data: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit_end: int) -> dict[str, np.ndarray]:
    """Units of every text ``data[start:end]``, and bytes and characters of its prefix and middle."""
    words = words_of(data)
    closing, inner = Marks(equal_bytes(words, unit_end)), Marks(continuation_bytes(words))
    first = closing.rank(starts)
    closed = closing.rank(ends) - first
    filled = ends > starts
    open_end = filled.copy()
    open_end[filled] = data[ends[filled] - 1] != unit_end
    n = closed + open_end

    def end_of(unit: np.ndarray) -> np.ndarray:
        at = np.where(unit == 0, starts, ends)
        inside = (unit > 0) & (unit <= closed)
        at[inside] = closing.select(first[inside] + unit[inside] - 1) + 1
        return at

    a, b = h1 % (n + 1), h2 % (n + 1)
    low, high = end_of(np.minimum(a, b)), end_of(np.maximum(a, b))
    skipped = inner.rank(low)
    return {
        "n": n, "prefix_bytes": low - starts, "middle_bytes": high - low,
        "prefix_chars": low - starts - (skipped - inner.rank(starts)), "middle_chars": high - low - (inner.rank(high) - skipped),
    }


CUTS = "struct<n:bigint,prefix_bytes:bigint,middle_bytes:bigint,prefix_chars:bigint,middle_chars:bigint>"


def _cuts(unit_end: int):
    def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        raw = text.cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        some = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        found = find_cuts(at[:-1] - at[0], at[1:] - at[0], some, h1.to_numpy(), h2.to_numpy(), unit_end)
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in found.values()], list(found))

    return F.arrow_udf(cuts, CUTS)


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE,
    markers: Markers = Markers(), unit_end: str = "\n",
) -> DataFrame:
    """Cuts every whole text at two ends of units and moves its middle behind the rest.

    Returns one row per row: doc_id, n (units; a unit ends with ``unit_end``, one
    ASCII character, or with the text), form (plain, psm or spm), prefix_chars and
    middle_chars (code points, NULL if plain) and output. Cuts and form depend on
    ``seed`` and the id alone, so that rows with one id are drawn alike.

    A NULL text is empty; a NULL id draws as an empty string does. Texts that are
    empty or contain a marker stay plain. Rows are never joined or shuffled, so
    repeated rows and ids stay as they are, a text of any length is cut whole, an
    empty table gives an empty result, and other columns are not read.
    """
    if len(unit_end.encode()) != 1:
        raise ValueError("a unit ends with one ASCII character")
    h1, h2, h3, h4 = draws("_id", seed)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    plain = (F.col("_text") == "") | (h3 % 100 >= rate)
    for marker in markers:
        plain = plain | F.contains("_text", F.lit(marker))
    form = F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    cut = rows.withColumn("_cut", _cuts(ord(unit_end))("_text", h1, h2)).withColumn("form", form)
    raw, low, size = F.col("_text").cast("binary"), F.col("_cut.prefix_bytes").cast("int"), F.col("_cut.middle_bytes").cast("int")
    prefix, middle = F.substring(raw, F.lit(1), low), F.substring(raw, low + 1, size)
    suffix = F.substring(raw, low + size + 1, F.octet_length("_text") - low - size)
    mark = {name: F.lit(text).cast("binary") for name, text in markers._asdict().items()}
    psm = F.concat(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle)
    spm = F.concat(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle)
    moved = F.col("form") != "plain"
    return cut.select(
        F.col("_id").alias("doc_id"), F.col("_cut.n").alias("n"), "form",
        *[F.when(moved, F.col(f"_cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")],
        F.when(~moved, F.col("_text")).when(F.col("form") == "psm", psm.cast("string")).otherwise(spm.cast("string")).alias("output"),
    )


def restored(markers: Markers = Markers()) -> Column:
    """The text that gave ``output`` in ``form``.

    A transformed text holds no marker, and no end of one marker starts another,
    so that the only markers in an output are those put there.
    """

    def split(text: Column, marker: str) -> tuple[Column, Column]:
        return F.substring_index(text, marker, 1), F.substring_index(text, marker, -1)

    def behind(text: Column, marker: str) -> Column:
        return F.substring(text.cast("binary"), F.lit(len(marker.encode()) + 1), F.octet_length(text)).cast("string")

    rest, middle = split(F.col("output"), markers.middle)
    prefix, suffix = split(rest, markers.suffix)
    psm = F.concat(behind(prefix, markers.prefix), middle, suffix)
    suffix, prefix = split(rest, markers.prefix)
    spm = F.concat(prefix, middle, behind(suffix, markers.suffix))
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output"))


def digest(filled: DataFrame) -> DataFrame:
    """Figures of the registered query: hashes of the outputs and of the texts restored from them."""
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    )
