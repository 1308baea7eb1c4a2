"""Flows seen from their two ends, and ranking within a reporter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = ("direction", "reporter")


def touching(flows: DataFrame, focal: int | None) -> DataFrame:
    """Flows with the focal reporter at either end; all flows without one."""
    if focal is None:
        return flows
    return flows.filter((F.col("i") == focal) | (F.col("j") == focal))


def sides(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Every flow twice: as an export of ``i`` and as an import of ``j``.

    Works on raw flows and on any table already grouped by ``i`` and ``j``; the
    second form is cheaper wherever the partner is part of the key.  A flow from
    the reporter to itself counts in both directions.
    """
    rest = [c for c in flows.columns if c not in ("i", "j")]
    out = touching(flows, focal).select(
        F.expr("stack(2, 'export', i, j, 'import', j, i) AS (direction, reporter, partner)"), *rest
    )
    return out if focal is None else out.filter(F.col("reporter") == focal)


def exports(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Export side only: one scan, no doubling of rows."""
    kept = flows if focal is None else flows.filter(F.col("i") == focal)
    rest = [c for c in flows.columns if c not in ("i", "j")]
    return kept.select(
        F.lit("export").alias("direction"),
        F.col("i").alias("reporter"),
        F.col("j").alias("partner"),
        *rest,
    )


def imports(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Import side only."""
    kept = flows if focal is None else flows.filter(F.col("j") == focal)
    rest = [c for c in flows.columns if c not in ("i", "j")]
    return kept.select(
        F.lit("import").alias("direction"),
        F.col("j").alias("reporter"),
        F.col("i").alias("partner"),
        *rest,
    )


def code_totals(flows: DataFrame, focal: int | None, product: Column) -> DataFrame:
    """Value per partner and per product code: (direction, reporter, dimension, code, v).

    Every flow counts under its partner (``country``) and its ``product`` in one
    pass.  The partial sums are as few as there are codes, where a grouping by
    partner and product together would be about as long as the flows.  Distinct
    counts of partners and products are row counts of this table.
    """
    ends = touching(flows, focal).select("i", "j", product.alias("p"), "v")
    out = ends.select(
        F.stack(
            F.lit(4),
            F.lit("export"), F.col("i"), F.lit("country"), F.col("j"),
            F.lit("export"), F.col("i"), F.lit("product"), F.col("p"),
            F.lit("import"), F.col("j"), F.lit("country"), F.col("i"),
            F.lit("import"), F.col("j"), F.lit("product"), F.col("p"),
        ).alias("direction", "reporter", "dimension", "code"),
        "v",
    )
    kept = out if focal is None else out.filter(F.col("reporter") == focal)
    return kept.groupBy(*SIDE, "dimension", "code").agg(F.sum("v").alias("v"))


def top_per(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of each group with their rank.

    The filter on ``row_number`` lets Spark cut each group before the shuffle, so
    a hot group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
