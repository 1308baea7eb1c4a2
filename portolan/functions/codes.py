"""Product code expressions.

Product codes are six digits stored as integers, so a leading zero is missing
from the number.  Two readings of the two-digit chapter are in use and differ
for such codes: ``padded`` restores the zero first, ``raw`` takes the first two
characters as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hs6(k: Column) -> Column:
    """Code as text, zero-padded to six characters and never shortened."""
    text = k.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def _leading(k: Column, digits: int) -> Column:
    # Integer division on the usual range keeps the scan free of string work.
    by_number = F.floor(k / F.lit(10 ** (6 - digits))).cast("int")
    by_text = F.substring(hs6(k), 1, digits).try_cast("int")
    return F.coalesce(F.when(k.between(0, 999_999), by_number).otherwise(by_text), F.lit(0))


def hs2(k: Column, mode: str = "padded") -> Column:
    """Chapter: an integer in ``padded`` mode (0 if unreadable), text in ``raw`` mode."""
    if mode == "padded":
        return _leading(k, 2)
    if mode == "raw":
        return F.substring(k.cast("string"), 1, 2)
    raise ValueError(f"hs2 mode must be 'padded' or 'raw', not {mode!r}")


def hs4(k: Column) -> Column:
    """Heading as an integer, 0 if unreadable."""
    return _leading(k, 4)
