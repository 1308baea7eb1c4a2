"""Distribution of flow values: moments, quartiles, normality, correlation, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.codes import hs2
from portolan.functions.numeric import jarque_bera, unit_value
from portolan.operators.directional import SIDE, sides
from portolan.operators.quantiles import moments, quantiles_of, summaries

MEASURES = ("v", "q", "unit_value", "hs2")


def value_distribution(flows: DataFrame, focal: int | None = None, scale: float = 1.0) -> DataFrame:
    """Count, mean, deviation, quartiles, skewness, excess kurtosis and Jarque-Bera.

    ``scale=1000`` gives USD.  Skewness and kurtosis are population moments; the
    p-value is the chi-square tail at two degrees of freedom.
    """
    x = F.col("v").cast("double")
    ends = sides(flows, focal).select(*SIDE, (x if scale == 1 else x * float(scale)).alias("x"))
    buckets = summaries(ends, SIDE, "x")
    quartiles = quantiles_of(buckets, ends, SIDE, "x", (0.25, 0.5, 0.75))
    return (
        moments(buckets, SIDE).join(quartiles, list(SIDE))
        .withColumn("jarque_bera", jarque_bera(F.col("records"), F.col("skewness"), F.col("kurtosis")))
        .select(
            *SIDE, "records", "mean", "std", "min",
            F.col("quantiles")[0].alias("p25"),
            F.col("quantiles")[1].alias("p50"),
            F.col("quantiles")[2].alias("p75"),
            "max", "skewness", "kurtosis", "jarque_bera",
            F.exp(-F.col("jarque_bera") / 2).alias("jarque_bera_p"),
        )
    )


def _pearson(a: str, b: str) -> Column:
    """Correlation over complete pairs, NULL where one side does not vary.

    The built-in ``corr`` divides by zero there, which ANSI mode turns into an error.
    """
    if a == b:
        return F.when(F.var_pop(a) > 0, F.lit(1.0))
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def correlations(flows: DataFrame, focal: int | None = None, hs2_mode: str = "padded") -> DataFrame:
    """Pearson matrix of value, quantity, unit value and chapter, long form.

    Each pair uses the rows where both are known.  A measure without variation
    has no correlation.
    """
    v, q, k = F.col("v"), F.col("q"), F.col("k")
    measured = sides(flows, focal).select(
        *SIDE,
        v.cast("double").alias("v"),
        q.alias("q"),
        unit_value(v, q).alias("unit_value"),
        hs2(k, hs2_mode).cast("double").alias("hs2"),
    )
    pairs = [(a, b) for n, a in enumerate(MEASURES) for b in MEASURES[n:]]
    once = measured.groupBy(*SIDE).agg(*[_pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a in MEASURES:
        for b in MEASURES:
            name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
            cells += [F.lit(a), F.lit(b), F.col(f"`{name}`")]
    return once.select(*SIDE, F.stack(F.lit(len(MEASURES) ** 2), *cells).alias("x", "y", "r"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from minimum to maximum; the last bin includes the maximum."""
    x = F.col(column).cast("double")
    edge = df.agg(F.struct(F.min(x).alias("low"), ((F.max(x) - F.min(x)) / bins).alias("width"))).scalar()
    low, width = edge["low"], edge["width"]
    binned = F.least(F.coalesce(F.floor(F.try_divide(x - low, width)), F.lit(0)), F.lit(bins - 1))
    return (
        df.filter(x.isNotNull())
        .select(binned.cast("int").alias("bin"), low.alias("low"), width.alias("width"))
        .groupBy("bin", "low", "width")
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_from"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_to"),
            "n",
        )
    )
