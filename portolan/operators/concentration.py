"""Concentration of value over partners and chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.codes import hs2
from portolan.functions.labels import concentration_band
from portolan.functions.numeric import total_of
from portolan.operators.directional import SIDE, code_totals

GROUP = (*SIDE, "dimension")


def dimension_values(flows: DataFrame, focal: int | None = None, hs2_mode: str = "padded") -> DataFrame:
    """Value per partner (``country``) and per chapter (``product``) in one long table."""
    chapter = hs2(F.col("k"), hs2_mode).cast("int")
    return code_totals(flows, focal, chapter).select(*GROUP, "code", total_of(F.col("v")).alias("value"))


def concentration(flows: DataFrame, focal: int | None = None, hs2_mode: str = "padded") -> DataFrame:
    """Herfindahl-Hirschman index, Gini coefficient and band per direction and dimension.

    The Gini rank runs over the codes of one reporter and direction, never over
    flows: a window partition holds at most the number of partner codes or of
    two-digit chapters.
    """
    x = F.col("value")
    w = Window.partitionBy(*GROUP).orderBy("value", "code")
    n, s = F.count("*"), F.sum("value")
    return (
        dimension_values(flows, focal, hs2_mode)
        .withColumn("r", F.row_number().over(w))
        .groupBy(*GROUP)
        .agg(
            n.alias("groups"),
            F.try_divide(F.sum(x * x), s * s).alias("hhi"),
            # Running totals of the sorted values add up to sum((n + 1 - r) * x).
            ((n + 1 - 2 * F.try_divide((n + 1) * s - F.sum(F.col("r") * x), s)) / n).alias("gini"),
        )
        .withColumn("band", concentration_band(F.col("hhi")))
    )


def risk_indicators(flows: DataFrame, focal: int | None = None, top: int = 5, hs2_mode: str = "padded") -> DataFrame:
    """Largest and top-five export share by country and chapter, long form."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "code")
    shares = (
        dimension_values(flows, focal, hs2_mode)
        .filter(F.col("direction") == "export")
        .withColumn("r", F.row_number().over(w))
        .groupBy("reporter", "dimension")
        .agg(
            F.try_divide(F.max("value"), F.sum("value")).alias("largest"),
            F.try_divide(F.sum(F.when(F.col("r") <= top, F.col("value"))), F.sum("value")).alias("leading"),
        )
    )
    country = F.col("dimension") == "country"
    # Names of the published indicators.
    return shares.select(
        "reporter",
        F.stack(
            F.lit(2),
            F.when(country, F.lit("Geographic Concentration")).otherwise(F.lit("Product Concentration")),
            F.col("largest"),
            F.when(country, F.lit(f"Top {top} Country Dependence")).otherwise(F.lit(f"Top {top} Product Dependence")),
            F.col("leading"),
        ).alias("category", "value"),
    )
