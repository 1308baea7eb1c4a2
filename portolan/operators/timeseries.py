"""Yearly series: balance, openness, growth, robust trend, chapter shares.

All of these read the yearly totals, a handful of rows per reporter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.codes import hs2
from portolan.functions.numeric import MILLION, change_pct, total, usd
from portolan.operators.directional import exports, sides, top_per
from portolan.operators.ranks import ordered
from portolan.operators.totals import yearly
from portolan.plans.session import settled

Z_95 = 1.959963984540054

#: Periods of a series that meet others in one task.
BLOCK = 256
#: Enough for sixteen digits at one degree of freedom, the slowest.
NEWTON_STEPS = 8


def t_critical(df: Column) -> Column:
    """Two-sided 95 % point of Student's t at any whole number of degrees of freedom.

    For an angle ``a`` with ``tan(a) = t / sqrt(df)`` the probability between -t
    and t is a finite sum of powers of ``cos(a)``, with derivative proportional to
    ``cos(a) ** (df - 1)``. Newton's steps on the angle start at the normal point,
    below the root, and the probability is concave there: they never pass it.
    """
    n = df.cast("double")
    odd = n % 2 == 1
    terms = F.when(odd, (n - 1) / 2).otherwise(n / 2).cast("int")
    steps = F.when(terms > 1, F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def series(square: Column) -> Column:
        """1 + the products of the ratios of the series, times powers of ``square``."""

        def longer(s: Column, i: Column) -> Column:
            ratio = F.when(odd, 2.0 * i / (2.0 * i + 1)).otherwise((2.0 * i - 1) / (2.0 * i))
            term = s["term"] * ratio * square
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        found = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), longer)
        return F.when(terms >= 1, found["sum"]).otherwise(0.0)

    def inside(a: Column) -> Column:
        total = series(F.cos(a) * F.cos(a))
        return F.when(odd, 2 / math.pi * (a + F.sin(a) * F.cos(a) * total)).otherwise(F.sin(a) * total)

    slope = F.when(odd, 2 / math.pi * (1 + series(F.lit(1.0)))).otherwise(series(F.lit(1.0)))
    angle = F.aggregate(
        F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.atan(Z_95 / F.sqrt(n)),
        lambda a, _: a + (0.95 - inside(a)) / (slope * F.pow(F.cos(a), n - 1)),
    )
    return F.when(df >= 1, F.tan(angle) * F.sqrt(n))


def balance_openness_of(both: DataFrame) -> DataFrame:
    """Balance and openness (trade over its mean) of yearly exports and imports."""
    trade = F.col("exports") + F.col("imports")
    mean = F.avg(trade).over(Window.partitionBy("reporter"))
    return both.select(
        "reporter", "t", "exports", "imports",
        (F.col("exports") - F.col("imports")).alias("trade_balance"),
        F.coalesce(F.try_divide(trade, mean), F.lit(0.0)).alias("trade_openness"),
    )


def balance_openness(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Balance and openness for years with both directions."""
    return balance_openness_of(yearly(flows, focal, "both"))


def series_of(yearly_values: DataFrame) -> DataFrame:
    """Yearly exports and imports in long form (direction, reporter, t, v)."""
    return yearly_values.select(
        F.stack(F.lit(2), F.lit("export"), F.col("exports"), F.lit("import"), F.col("imports")).alias(
            "direction", "v"
        ),
        "reporter",
        "t",
    ).select("direction", "reporter", "t", "v")


def series(flows: DataFrame, focal: int | None = None, years: str = "both") -> DataFrame:
    """Yearly values in long form (direction, reporter, t, v).

    ``years='both'`` keeps years with exports and imports, ``'own'`` each
    direction's own years.
    """
    if years == "own":
        return sides(flows, focal).groupBy("direction", "reporter", "t").agg(total("v").alias("v"))
    return series_of(yearly(flows, focal, years))


def growth_of(yearly_values: DataFrame) -> DataFrame:
    """Change against the previous listed year in percent; NULL for the first."""
    w = Window.partitionBy("direction", "reporter").orderBy("t")
    return yearly_values.withColumn("growth_pct", change_pct(F.col("v"), F.lag("v").over(w)))


def growth(flows: DataFrame, focal: int | None = None, years: str = "both") -> DataFrame:
    return growth_of(series(flows, focal, years))


def growth_stats_of(yearly_values: DataFrame) -> DataFrame:
    """Mean and deviation of growth and the 95 % interval of its mean."""
    n, mean, std = F.col("n"), F.col("mean"), F.col("std")
    half = t_critical(n - 1) * std / F.sqrt(n)
    return (
        growth_of(yearly_values)
        .groupBy("direction", "reporter")
        .agg(
            F.count("growth_pct").alias("n"),
            F.avg("growth_pct").alias("mean"),
            F.stddev_samp("growth_pct").alias("std"),
        )
        # One growth value says nothing about its spread.
        .select(
            "direction", "reporter", "n",
            F.when(n > 1, mean).alias("mean"),
            F.when(n > 1, std).alias("std"),
            F.when(n > 1, mean - half).alias("ci_low"),
            F.when(n > 1, mean + half).alias("ci_high"),
        )
    )


def growth_stats(flows: DataFrame, focal: int | None = None, years: str = "both") -> DataFrame:
    return growth_stats_of(series(flows, focal, years))


def _slopes(points: DataFrame) -> DataFrame:
    """Slopes between all pairs of periods of a series.

    The periods of a long series are dealt into blocks, and a pair of blocks is a
    join key of its own, so that no series becomes one large task.
    """
    by = ["direction", "reporter"]
    blocked = points.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("t")) - 1) / BLOCK).cast("int"))
    last = blocked.groupBy(*by).agg(F.max("_block").alias("_last"))
    early = blocked.join(last, by).withColumn("_late", F.explode(F.sequence("_block", "_last"))).withColumnRenamed("_block", "_early")
    late = blocked.select(
        *by, F.col("t").alias("t2"), F.col("v").alias("v2"), F.col("_block").alias("_late"), F.explode(F.sequence(F.lit(0), "_block")).alias("_early")
    )
    return (
        early.join(late, [*by, "_early", "_late"]).filter(F.col("t") < F.col("t2"))
        .select(*by, ((F.col("v2") - F.col("v")) / (F.col("t2") - F.col("t"))).alias("slope"))
    )


def trend_of(yearly_values: DataFrame) -> DataFrame:
    """Theil-Sen line: median pairwise slope, intercept and 95 % bounds of the slope.

    All slopes are put in order together, and the wanted ones of each series are
    picked by their place; no series is gathered in one row or one buffer of slopes.
    """
    by = ["direction", "reporter"]
    points = settled(yearly_values.filter(F.col("v").isNotNull()))
    slopes = ordered(_slopes(points), [*map(F.col, by), F.col("slope")]).rows
    # Equal values lower the variance of the slope statistic.
    equal = points.groupBy(*by, "v").agg(F.count("*").cast("double").alias("c"))
    ties = equal.groupBy(*by).agg(F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("ties"))
    middles = points.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile("v", F.lit(0.5)).alias("_v"), F.percentile(F.col("t").cast("double"), F.lit(0.5)).alias("_t")
    )
    spans = slopes.groupBy(*by).agg(F.min("place").alias("_first"), F.count("*").alias("_pairs"))
    n, pairs = F.col("n").cast("double"), F.col("_pairs").cast("double")
    sigma = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18)
    wanted = {
        "low": F.greatest(F.bround((pairs - Z_95 * sigma) / 2, 0) - 1, F.lit(0.0)),
        "high": F.least(F.bround((pairs + Z_95 * sigma) / 2, 0), pairs - 1),
        "mid": F.floor((pairs - 1) / 2),
        "next": F.floor(pairs / 2),
    }
    each = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), (F.col("_first") + at.cast("long")).alias("place")) for role, at in wanted.items()]))
    picks = spans.join(middles, by).join(ties, by).select(*by, "n", "_v", "_t", each.alias("_pick")).select(*by, "n", "_v", "_t", "_pick.*")

    def of(*roles: str) -> Column:
        return F.avg(F.when(F.col("role").isin(*roles), F.col("slope")))

    return (
        picks.join(slopes.select("place", "slope"), "place").groupBy(*by, "n", "_v", "_t")
        .agg(of("mid", "next").alias("slope"), of("low").alias("slope_low"), of("high").alias("slope_high"))
        .select(*by, "n", "slope", (F.col("_v") - F.col("slope") * F.col("_t")).alias("intercept"), "slope_low", "slope_high")
    )


def trend(flows: DataFrame, focal: int | None = None, years: str = "both") -> DataFrame:
    return trend_of(series(flows, focal, years))


def product_lifecycle(flows: DataFrame, focal: int | None = None, hs2_mode: str = "raw") -> DataFrame:
    """Export value in USD per year and chapter, long form."""
    return (
        exports(flows, focal)
        .select("reporter", "t", hs2(F.col("k"), hs2_mode).alias("hs2"), "v")
        .groupBy("reporter", "t", "hs2")
        .agg(usd(total("v")).alias("value_usd"))
    )


def product_lifecycle_wide(
    flows: DataFrame, chapters: Sequence, focal: int | None = None, hs2_mode: str = "raw"
) -> DataFrame:
    """Wide form with one column per listed chapter; missing cells are 0."""
    return (
        product_lifecycle(flows, focal, hs2_mode)
        .groupBy("reporter", "t")
        .pivot("hs2", list(chapters))
        .agg(F.sum("value_usd"))
        .na.fill(0.0)
    )


def export_share_latest(
    flows: DataFrame, n: int = 10, focal: int | None = None, hs2_mode: str = "padded"
) -> DataFrame:
    """Leading chapters by share of the reporter's exports in its latest year."""
    chapters = (
        exports(flows, focal)
        .select("reporter", "t", hs2(F.col("k"), hs2_mode).alias("hs2"), "v")
        .groupBy("reporter", "t", "hs2")
        .agg(total("v").alias("v"))
    )
    mine = Window.partitionBy("reporter")
    shares = (
        chapters.withColumn("latest", F.max("t").over(mine))
        .filter(F.col("t") == F.col("latest"))
        .withColumn("export_share", F.try_divide(F.col("v"), F.sum("v").over(mine)))
    )
    return top_per(shares, ["reporter"], [F.desc("export_share"), F.asc("hs2")], n).select(
        "reporter", "t", "rank", "hs2", "export_share"
    )


def time_panel(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Chart data: values, balance in billions, openness and both growth rates per year."""
    w = Window.partitionBy("reporter").orderBy("t")
    return balance_openness(flows, focal).select(
        "reporter", "t", "exports", "imports",
        (F.col("trade_balance") / MILLION).alias("balance_busd"),
        "trade_openness",
        change_pct(F.col("exports"), F.lag("exports").over(w)).alias("export_growth"),
        change_pct(F.col("imports"), F.lag("imports").over(w)).alias("import_growth"),
    )


def trend_lines(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Chart data: yearly values with the robust trend and the lines of its slope bounds.

    The bound lines turn about the middle point of the series.
    """
    values = series(flows, focal)
    t = F.col("t").cast("double")
    middle = F.percentile(t, F.lit(0.5)).over(Window.partitionBy("direction", "reporter"))
    at_middle = F.col("intercept") + F.col("slope") * F.col("middle")

    def line(slope: str) -> Column:
        return at_middle + F.col(slope) * (t - F.col("middle"))

    return (
        values.withColumn("middle", middle)
        .join(trend_of(values), ["direction", "reporter"])
        .select(
            "direction", "reporter", "t", "v",
            line("slope").alias("trend"), line("slope_low").alias("trend_low"), line("slope_high").alias("trend_high"),
        )
    )
