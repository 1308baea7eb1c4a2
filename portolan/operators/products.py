"""Products: leaders, profiles, chapters and the product-market matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.codes import hs2
from portolan.functions.numeric import even_round, span, total, usd
from portolan.operators.directional import SIDE, exports, sides, top_per, touching
from portolan.operators.naming import with_description, with_partner_name


def top_products(flows: DataFrame, products: DataFrame, n: int = 10, focal: int | None = None) -> DataFrame:
    """Leading described products by value, per direction."""
    values = sides(flows, focal).groupBy(*SIDE, "k").agg(total("v").alias("value"))
    named = with_description(values, products)
    return top_per(named, SIDE, [F.desc("value"), F.asc("k")], n).select(
        *SIDE, "rank", F.col("k").alias("product"), "description", "value"
    )


def product_profile(
    flows: DataFrame, products: DataFrame, n: int = 25, focal: int | None = None
) -> DataFrame:
    """Leading products with partner count, first and last year and span.

    ``partner_count`` counts markets of an export and suppliers of an import.
    """
    cells = touching(flows, focal).groupBy("i", "j", "k").agg(
        F.sum("v").alias("v"), F.min("t").alias("first_year"), F.max("t").alias("last_year")
    )
    values = sides(cells, focal).groupBy(*SIDE, "k").agg(
        total("v").alias("total_value"),
        F.count("partner").alias("partner_count"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
    )
    named = with_description(values, products)
    return top_per(named, SIDE, [F.desc("total_value"), F.asc("k")], n).select(
        *SIDE, "rank", F.col("k").alias("product"), "description", "total_value", "partner_count",
        "first_year", "last_year",
        usd(F.col("total_value")).alias("total_value_usd"),
        span(F.col("first_year"), F.col("last_year")).alias("year_span"),
    )


def trade_intensity(
    flows: DataFrame,
    n: int = 10,
    focal: int | None = None,
    order: str = "code",
    hs2_mode: str = "padded",
) -> DataFrame:
    """Export value, flow count, mean flow and partner count per chapter.

    ``order='code'`` lists the lowest chapter codes, as the published report does
    under the name of top products; ``order='value'`` lists the largest chapters.
    """
    by = {"code": [F.asc("hs2")], "value": [F.desc("value_sum"), F.asc("hs2")]}[order]
    chapters = (
        exports(flows, focal)
        .select("reporter", "partner", hs2(F.col("k"), hs2_mode).alias("hs2"), "v")
        .groupBy("reporter", "hs2")
        .agg(
            F.coalesce(F.sum("v"), F.lit(0)).alias("value_sum"),
            F.count("v").alias("value_count"),
            F.avg(F.col("v").cast("double")).alias("value_mean"),
            F.count_distinct("partner").alias("partners"),
        )
    )
    return top_per(chapters, ["reporter"], by, n).select(
        "reporter", "rank", "hs2",
        even_round(F.col("value_sum")).cast("double").alias("value_sum"),
        "value_count",
        even_round(F.col("value_mean")).alias("value_mean"),
        "partners",
    )


def product_market_matrix(
    flows: DataFrame,
    countries: DataFrame,
    products: DataFrame,
    n_products: int = 10,
    n_markets: int = 15,
    focal: int | None = None,
) -> DataFrame:
    """Export value of the leading products in the leading markets, long form.

    The leaders are chosen over all codes, named or not; cells need both names.
    """
    cells = exports(flows, focal).groupBy("reporter", "partner", "k").agg(F.sum("v").alias("v"))
    best_products = top_per(
        cells.groupBy("reporter", "k").agg(F.sum("v").alias("v")), ["reporter"], [F.desc("v"), F.asc("k")], n_products
    )
    best_markets = top_per(
        cells.groupBy("reporter", "partner").agg(F.sum("v").alias("v")),
        ["reporter"], [F.desc("v"), F.asc("partner")], n_markets,
    )
    kept = cells.join(best_products.select("reporter", "k"), ["reporter", "k"], "left_semi").join(
        best_markets.select("reporter", "partner"), ["reporter", "partner"], "left_semi"
    )
    return with_partner_name(with_description(kept, products), countries).select(
        "reporter",
        F.col("k").alias("product"),
        "description",
        "partner",
        "partner_name",
        usd(F.col("v").cast("double")).alias("value_usd"),
    )


def product_market_pivot(matrix: DataFrame, markets: Sequence[int]) -> DataFrame:
    """Wide form of a matrix: one row per reporter and product, one column per listed market code.

    Cells are the mean over the rows of the matrix, as in the published table, and
    0 where there are none. The list of markets makes the columns known before
    anything runs.
    """
    return (
        matrix.groupBy("reporter", "product", "description")
        .pivot("partner", list(markets))
        .agg(F.avg("value_usd"))
        .na.fill(0.0, [str(m) for m in markets])
    )
