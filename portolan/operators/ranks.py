"""Places of rows in a total order, without bringing the table into one task.

Rows are sorted into ranges, one per task, and written. A row's place is its
position in its range plus the rows of the ranges in front; only the number of
rows of each range comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.plans.session import settled

#: Spark numbers rows by partition above this many bits and position below.
POSITION_BITS = 33


class Ordered(NamedTuple):
    """Rows in order with their ``place``, from 1, and their number."""

    rows: DataFrame
    size: int

    def only(self, condition: Column) -> Ordered:
        """The rows that fulfil a condition, numbered anew; their order needs no second sort."""
        return _numbered(self.rows.filter(condition).drop("place"))

    def median(self, column: str) -> Column:
        """Median of the column the rows are ordered by, either way."""
        middle = ((self.size + 1) // 2, self.size // 2 + 1)
        return self.rows.filter(F.col("place").isin(*middle)).agg(F.avg(F.col(column).cast("double"))).scalar()


def _numbered(rows: DataFrame) -> Ordered:
    at = rows.withColumn("_at", F.monotonically_increasing_id())
    part, inside = F.shiftright("_at", POSITION_BITS), F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    counts = {r["part"]: r["n"] for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offsets = F.array(*[F.lit(n).cast("long") for n in before or [0]])
    return Ordered(at.withColumn("place", F.get(offsets, part.cast("int")) + inside + 1).drop("_at"), total)


def ordered(df: DataFrame, order: Sequence[Column]) -> Ordered:
    """Numbers the rows by ``order``, which should tell any two of them apart. Runs when called."""
    return _numbered(settled(df.orderBy(*order)))
