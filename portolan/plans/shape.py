"""Result shapes shared by a query and its SQL twin.

A shape is text like ``"reporter:int value:num4"``.  The same shape casts and
rounds the DataFrame and wraps the SQL, so both return the same names and types
and sums that differ in the last bits compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN = {"int": ("int", "INTEGER"), "long": ("bigint", "BIGINT"), "str": ("string", "VARCHAR"), "bool": ("boolean", "BOOLEAN")}


def _columns(shape: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in shape.split()]


def _places(kind: str) -> int:
    """Decimals of a ``num`` column.

    Chosen so that exact results do not end in a 5 right after the last place: the
    engines differ on such ties.  Large magnitudes take 0, where a tie is exact.
    """
    return int(kind.removeprefix("num") or 6)


def shaped(df: DataFrame, shape: str) -> DataFrame:
    out = []
    for name, kind in _columns(shape):
        c = F.col(name)
        out.append((c.cast(PLAIN[kind][0]) if kind in PLAIN else F.round(c.cast("double"), _places(kind))).alias(name))
    return df.select(*out)


def shaped_sql(body: str, shape: str, ctes: str) -> str:
    out = []
    for name, kind in _columns(shape):
        out.append(
            f"CAST({name} AS {PLAIN[kind][1]}) AS {name}"
            if kind in PLAIN
            else f"round(CAST({name} AS DOUBLE), {_places(kind)}) AS {name}"
        )
    return f"WITH {ctes},\nresult AS (\n{body.strip()}\n)\nSELECT {', '.join(out)}\nFROM result"
