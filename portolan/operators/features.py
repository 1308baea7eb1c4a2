"""Partner feature tables and exact scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.numeric import smoothed_unit_value, total
from portolan.operators.directional import exports
from portolan.operators.naming import with_partner_name

BASIC_FEATURES = ("total_value", "total_quantity", "product_diversity", "unit_value")
FEATURES = (*BASIC_FEATURES, "market_share")


def partner_features(flows: DataFrame, countries: DataFrame, focal: int | None = None) -> DataFrame:
    """Export totals, diversity, unit value, share and annual average per named partner."""
    per_partner = (
        exports(flows, focal)
        .groupBy("reporter", "partner")
        .agg(
            total("v").alias("total_value"),
            total("q").alias("total_quantity"),
            F.count_distinct("k").alias("product_diversity"),
            F.count_distinct("t").alias("years_active"),
        )
    )
    value = F.col("total_value")
    return (
        with_partner_name(per_partner, countries)
        .withColumns(
            {
                "unit_value": smoothed_unit_value(value, F.col("total_quantity")),
                "market_share": F.try_divide(value, F.sum(value).over(Window.partitionBy("reporter"))),
                "avg_annual_trade": value / F.col("years_active"),
            }
        )
        .select("reporter", "partner", "partner_name", *BASIC_FEATURES, "market_share", "years_active", "avg_annual_trade")
    )


def _scaled(df: DataFrame, columns: Sequence[str], center, spread) -> DataFrame:
    # One row per partner: a window partition is a reporter's partner list.
    w = Window.partitionBy("reporter")

    def scale(name: str) -> Column:
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        s = spread(x, w)
        return (x - center(x, w)) / F.when(s == 0, F.lit(1.0)).otherwise(s)

    return df.withColumns({f"{c}_scaled": scale(c) for c in columns})


def standard_scaled(df: DataFrame, columns: Sequence[str] = BASIC_FEATURES) -> DataFrame:
    """Adds ``<name>_scaled``: mean 0 and population deviation 1 per reporter."""
    return _scaled(df, columns, lambda x, w: F.avg(x).over(w), lambda x, w: F.stddev_pop(x).over(w))


def robust_scaled(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Adds ``<name>_scaled``: median 0 and interquartile range 1 per reporter."""

    def quantile(x, p, w):
        return F.percentile(x, F.lit(p)).over(w)

    return _scaled(
        df, columns, lambda x, w: quantile(x, 0.5, w), lambda x, w: quantile(x, 0.75, w) - quantile(x, 0.25, w)
    )


def with_feature_array(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds the scaled columns as one array, ``features``."""
    return df.withColumn("features", F.array(*[F.col(f"{c}_scaled") for c in columns]))
