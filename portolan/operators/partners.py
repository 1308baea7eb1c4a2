"""Partners: leaders, profiles, balances and fast growers.

Everything here groups by (origin, destination) first, so the doubling into two
directions happens on one row per pair and needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.labels import partner_label
from portolan.functions.numeric import span, total, usd
from portolan.operators.directional import SIDE, sides, top_per, touching
from portolan.operators.naming import with_partner_name
from portolan.schema import EMERGING_MIN_GROWTH_PCT, EMERGING_MIN_VALUE_USD, RECENT_YEARS


def pair_values(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Value per (direction, reporter, partner)."""
    pairs = touching(flows, focal).groupBy("i", "j").agg(total("v").alias("value"))
    return sides(pairs, focal)


def top_partners(flows: DataFrame, countries: DataFrame, n: int = 10, focal: int | None = None) -> DataFrame:
    """Leading named partners by value, per direction."""
    named = with_partner_name(pair_values(flows, focal), countries)
    return top_per(named, SIDE, [F.desc("value"), F.asc("partner")], n).select(
        *SIDE, "rank", "partner", "partner_name", "value"
    )


def partner_profile(
    flows: DataFrame, countries: DataFrame, n: int = 20, focal: int | None = None
) -> DataFrame:
    """Leading partners with product count, first and last year and duration.

    Two grouping steps make the product count a plain count.
    """
    cells = touching(flows, focal).groupBy("i", "j", "k").agg(
        F.sum("v").alias("v"), F.min("t").alias("first_year"), F.max("t").alias("last_year")
    )
    pairs = cells.groupBy("i", "j").agg(
        total("v").alias("total_value"),
        F.count("k").alias("product_count"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
    )
    named = with_partner_name(sides(pairs, focal), countries)
    return top_per(named, SIDE, [F.desc("total_value"), F.asc("partner")], n).select(
        *SIDE, "rank", "partner", "partner_name", "total_value", "product_count", "first_year", "last_year",
        usd(F.col("total_value")).alias("total_value_usd"),
        span(F.col("first_year"), F.col("last_year")).alias("trade_duration"),
    )


def recent_growth(
    flows: DataFrame,
    countries: DataFrame,
    years: Sequence[int] = RECENT_YEARS,
    focal: int | None = None,
) -> DataFrame:
    """Growth from the first to the last active year among ``years``.

    Partners active in fewer than two of the years have no growth and are left
    out; unnamed partners are labelled by their code.
    """
    cells = (
        touching(flows, focal)
        .filter(F.col("t").isin(list(years)))
        .groupBy("i", "j", "t")
        .agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    )
    series = (
        cells.groupBy("i", "j")
        .agg(
            F.count("*").alias("years_active"),
            F.min_by("v", "t").cast("double").alias("first_value"),
            F.max_by("v", "t").cast("double").alias("last_value"),
            total("v").alias("value"),
        )
        .filter(F.col("years_active") >= 2)
    )
    return with_partner_name(sides(series, focal), countries, keep_unnamed=True).select(
        *SIDE,
        "partner",
        partner_label(F.col("partner_name"), F.col("partner")).alias("partner_name"),
        (F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")) * 100).alias("growth_rate"),
        usd(F.col("value")).alias("total_value_usd"),
        "years_active",
    )


def emerging_partners(
    flows: DataFrame,
    countries: DataFrame,
    years: Sequence[int] = RECENT_YEARS,
    n: int = 15,
    focal: int | None = None,
    min_growth_pct: float = EMERGING_MIN_GROWTH_PCT,
    min_value_usd: float = EMERGING_MIN_VALUE_USD,
) -> DataFrame:
    """Fast-growing partners of some size, best first; both limits are strict."""
    fast = recent_growth(flows, countries, years, focal).filter(
        (F.col("growth_rate") > min_growth_pct) & (F.col("total_value_usd") > min_value_usd)
    )
    return top_per(fast, SIDE, [F.desc("growth_rate"), F.asc("partner")], n)


def balance_by_partner(
    flows: DataFrame, countries: DataFrame, n: int = 30, focal: int | None = None
) -> DataFrame:
    """Exports, imports and balance per named partner, largest trade first.

    One conditional aggregation takes the place of an outer join of the two
    directions: a missing side is 0.
    """
    both = (
        pair_values(flows, focal)
        .groupBy("reporter", "partner")
        .agg(
            total(F.when(F.col("direction") == "export", F.col("value"))).alias("exports"),
            total(F.when(F.col("direction") == "import", F.col("value"))).alias("imports"),
        )
    )
    named = with_partner_name(both, countries).withColumns(
        {
            "exports_usd": usd(F.col("exports")),
            "imports_usd": usd(F.col("imports")),
        }
    ).withColumns(
        {
            "trade_balance": F.col("exports_usd") - F.col("imports_usd"),
            "total_trade": F.col("exports_usd") + F.col("imports_usd"),
        }
    )
    return top_per(named, ["reporter"], [F.desc("total_trade"), F.asc("partner")], n).select(
        "reporter", "rank", "partner", "partner_name", "exports", "imports",
        "exports_usd", "imports_usd", "trade_balance", "total_trade",
    )


def balance_extremes(
    flows: DataFrame, countries: DataFrame, n: int = 30, focal: int | None = None
) -> DataFrame:
    """Surplus and deficit counts and the extreme partners of the balance list."""
    listed = balance_by_partner(flows, countries, n, focal)
    balance = F.col("trade_balance")
    # Equal balances go to the partner listed first.
    return listed.groupBy("reporter").agg(
        F.count_if(balance > 0).alias("surplus_partners"),
        F.count_if(balance < 0).alias("deficit_partners"),
        F.min_by("partner_name", F.struct(-balance, "rank")).alias("largest_surplus_partner"),
        F.max("trade_balance").alias("largest_surplus_usd"),
        F.min_by("partner_name", F.struct(balance, "rank")).alias("largest_deficit_partner"),
        F.abs(F.min("trade_balance")).alias("largest_deficit_usd"),
    )
