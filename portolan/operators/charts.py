"""Tables behind the charts and printed tables of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions import labels
from portolan.functions.codes import hs2
from portolan.functions.numeric import BILLION, MILLION, total
from portolan.operators import competition, concentration, partners, products, totals
from portolan.operators.directional import SIDE, exports, sides, top_per
from portolan.operators.naming import with_description, with_partner_name
from portolan.schema import RECENT_YEARS


def partner_name_bars(flows: DataFrame, countries: DataFrame, n: int = 8, focal: int | None = None) -> DataFrame:
    """Leading partners by name alone, with a short label."""
    by_name = (
        with_partner_name(partners.pair_values(flows, focal), countries)
        .groupBy(*SIDE, "partner_name")
        .agg(F.sum("value").alias("value"))
    )
    return top_per(by_name, SIDE, [F.desc("value"), F.asc("partner_name")], n).select(
        *SIDE, "rank", labels.shorten(F.col("partner_name"), 20).alias("label"), "value"
    )


def chapter_pie(flows: DataFrame, n: int = 10, focal: int | None = None, hs2_mode: str = "raw") -> DataFrame:
    """Leading chapters with their share of the listed total."""
    chapters = (
        sides(flows, focal)
        .select(*SIDE, hs2(F.col("k"), hs2_mode).alias("hs2"), "v")
        .groupBy(*SIDE, "hs2")
        .agg(total("v").alias("value"))
    )
    top = top_per(chapters, SIDE, [F.desc("value"), F.asc("hs2")], n)
    share = F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy(*SIDE))) * 100
    return top.select(*SIDE, "rank", "hs2", "value", share.alias("share_pct"))


def yearly_lines(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Exports and imports on the union of years."""
    return totals.yearly(flows, focal, "union")


def yearly_lines_billions(flows: DataFrame, focal: int | None = None) -> DataFrame:
    return yearly_lines(flows, focal).select(
        "reporter", "t", (F.col("exports") / MILLION).alias("exports_busd"), (F.col("imports") / MILLION).alias("imports_busd")
    )


def hhi_gauge(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Partner concentration with its band, per direction."""
    return (
        concentration.concentration(flows, focal)
        .filter(F.col("dimension") == "country")
        .select(*SIDE, F.col("hhi").alias("value"), "band")
    )


def product_treemap(
    flows: DataFrame, product_names: DataFrame, n: int = 15, focal: int | None = None, hs2_mode: str = "raw"
) -> DataFrame:
    """Leading (chapter, description) exports with a short label."""
    values = exports(flows, focal).groupBy("reporter", "k").agg(F.sum("v").alias("v"))
    cells = (
        with_description(values, product_names)
        .withColumn("hs2", hs2(F.col("k"), hs2_mode))
        .groupBy("reporter", "hs2", "description")
        .agg(total("v").alias("value"))
    )
    return top_per(cells, ["reporter"], [F.desc("value"), F.asc("hs2"), F.asc("description")], n).select(
        "reporter", "rank", labels.chapter_description(F.col("hs2"), F.col("description")).alias("label"), "value"
    )


def export_map(flows: DataFrame, countries: DataFrame, focal: int | None = None) -> DataFrame:
    """Exports per (three-letter code, name)."""
    pairs = exports(flows, focal).groupBy("reporter", "partner").agg(F.sum("v").alias("v"))
    places = countries.select(
        F.col("country_code").alias("partner"), F.col("country_iso3").alias("iso3"), F.col("country_name").alias("partner_name")
    ).na.drop(subset=["iso3", "partner_name"])
    return pairs.join(places, "partner").groupBy("reporter", "iso3", "partner_name").agg(total("v").alias("value"))


def competitive_bubbles(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Market size, market share and own exports of the leading products."""
    return competition.competitive_position(flows, focal=focal).select(
        "reporter", "product", "world_usd", "market_share", "exports_usd"
    )


def partner_bars(flows: DataFrame, countries: DataFrame, n: int = 10, focal: int | None = None) -> DataFrame:
    """Leading partners in billion USD."""
    return partners.partner_profile(flows, countries, n, focal).select(
        *SIDE, "rank", "partner_name", (F.col("total_value_usd") / BILLION).alias("value_busd")
    )


def emerging_scatter(
    flows: DataFrame, countries: DataFrame, years: Sequence[int] = RECENT_YEARS, focal: int | None = None
) -> DataFrame:
    """Value in million USD against growth of the emerging partners."""
    return partners.emerging_partners(flows, countries, years, focal=focal).select(
        *SIDE, "partner_name", (F.col("total_value_usd") / MILLION).alias("value_musd"), "growth_rate"
    )


def product_bars(flows: DataFrame, product_names: DataFrame, n: int = 10, focal: int | None = None) -> DataFrame:
    """Leading products in billion USD with a short label."""
    return products.product_profile(flows, product_names, n, focal).select(
        *SIDE, "rank", labels.shorten(F.col("description"), 50).alias("label"),
        (F.col("total_value_usd") / BILLION).alias("value_busd"),
    )


def balance_bars(flows: DataFrame, countries: DataFrame, n: int = 15, focal: int | None = None) -> DataFrame:
    """Balance in billion USD of the largest partners with its sign and colour."""
    balance = F.col("trade_balance")
    return partners.balance_by_partner(flows, countries, n, focal).select(
        "reporter", "rank", "partner_name", (balance / BILLION).alias("balance_busd"),
        labels.sign_class(balance).alias("sign"), labels.bar_colour(balance).alias("colour"),
    )


def partner_table(flows: DataFrame, countries: DataFrame, n: int = 10, focal: int | None = None) -> DataFrame:
    """Printed table of partners."""
    return partners.partner_profile(flows, countries, n, focal).select(
        *SIDE, "rank", "partner_name", labels.money(F.col("total_value_usd")).alias("value_text"),
        "product_count", "trade_duration",
    )


def product_table(flows: DataFrame, product_names: DataFrame, n: int = 10, focal: int | None = None) -> DataFrame:
    """Printed table of products."""
    return products.product_profile(flows, product_names, n, focal).select(
        *SIDE, "rank", labels.shorten(F.col("description"), 80).alias("label"),
        labels.money(F.col("total_value_usd")).alias("value_text"), "partner_count",
    )


def emerging_table(
    flows: DataFrame, countries: DataFrame, years: Sequence[int] = RECENT_YEARS, n: int = 10, focal: int | None = None
) -> DataFrame:
    """Printed table of emerging partners."""
    return partners.emerging_partners(flows, countries, years, n, focal).select(
        *SIDE, "rank", "partner_name", labels.percent(F.col("growth_rate")).alias("growth_text"),
        labels.money(F.col("total_value_usd")).alias("value_text"), "years_active",
    )


def balance_headlines(flows: DataFrame, countries: DataFrame, focal: int | None = None) -> DataFrame:
    """Printed extremes of the balance list."""
    return partners.balance_extremes(flows, countries, focal=focal).select(
        "reporter", "surplus_partners", "deficit_partners",
        "largest_surplus_partner", labels.billions(F.col("largest_surplus_usd")).alias("surplus_text"),
        "largest_deficit_partner", labels.billions(F.col("largest_deficit_usd")).alias("deficit_text"),
    )
