"""Labels, bands and printed numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.schema import HHI_HIGH, HHI_MODERATE


def shorten(text: Column, n: int) -> Column:
    """First ``n`` characters and an ellipsis where the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def partner_label(name: Column, code: Column) -> Column:
    """Name, or ``Country_<code>`` where the name is unknown."""
    return F.coalesce(name, F.concat(F.lit("Country_"), code.cast("string")))


def chapter_label(hs2: Column) -> Column:
    return F.concat(F.lit("HS"), hs2.cast("string"))


def chapter_description(hs2: Column, description: Column, n: int = 30) -> Column:
    return F.concat(hs2.cast("string"), F.lit(": "), shorten(description, n))


def concentration_band(hhi: Column) -> Column:
    return (
        F.when(hhi > HHI_HIGH, F.lit("high"))
        .when(hhi > HHI_MODERATE, F.lit("moderate"))
        .otherwise(F.lit("low"))
    )


def sign_class(balance: Column) -> Column:
    return F.when(balance > 0, F.lit("surplus")).when(balance < 0, F.lit("deficit")).otherwise(F.lit("even"))


def bar_colour(balance: Column) -> Column:
    return F.when(balance > 0, F.lit("green")).otherwise(F.lit("red"))


def quadrant(reach: Column, share: Column, mid_reach: Column, mid_share: Column) -> Column:
    """Portfolio quadrant against the medians of reach and share."""
    wide, large = reach > mid_reach, share > mid_share
    # Names of the published quadrants.
    return (
        F.when(wide & large, F.lit("Stars"))
        .when(large, F.lit("Cash Cows"))
        .when(wide, F.lit("Question Marks"))
        .otherwise(F.lit("Dogs"))
    )


def thousands(x: Column) -> Column:
    """``1234567.8`` -> ``1,234,568``."""
    return F.format_number(x, 0)


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), thousands(x))


def billions(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.1f", x / 1e9), F.lit("B"))


def percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", x), F.lit("%"))
