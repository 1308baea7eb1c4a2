"""Moments and exact quantiles of raw values in two reads, without gathering them.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer, which fails when a single reporter owns a large part of the
flows.  Here a first read counts the values in logarithmic buckets, each with its
ends and central moments. Buckets add up to the moments of a group, and tell which
of them hold a wanted rank. A second read takes the values of these few buckets,
each distinct one once with its count, and writes them; equal slices of a bucket
are counted there, and only the values of the slices that hold a wanted rank are
put in order. All counts combine before a shuffle, and a bucket or slice that holds
many values is spread over tasks by its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.plans.session import settled, written

BUCKETS_PER_OCTAVE = 64
SLICES = 1024


def _log_bucket(x: Column) -> Column:
    """Integer that never decreases as ``x`` grows; about 1 % relative width."""
    size = F.floor(F.log1p(F.abs(x)) * (BUCKETS_PER_OCTAVE / 0.6931471805599453))
    return F.when(x < 0, -size - 1).otherwise(size)


def _slice(x: Column, low: Column, high: Column) -> Column:
    """Position of ``x`` between ``low`` and ``high`` as an integer 0..SLICES."""
    return F.coalesce(F.when(high > low, F.floor((x - low) / (high - low) * SLICES)), F.lit(0))


def _located(parts: DataFrame, inside: Sequence[str], order: str, wanted: Column) -> DataFrame:
    """One row per wanted 0-based rank with the part that holds it; ``n`` counts values."""
    upto = F.sum("n").over(Window.partitionBy(*inside).orderBy(order))
    return (
        parts.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("n"))
        .withColumn("rank", F.explode(wanted))
        .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    )


def summaries(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per group and bucket of values: n, low, high, and mean and central power sums m2 to m4.

    This is the only pass over all values; its result is as long as there are
    buckets, and is written.
    """
    by = list(by)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, value)])
    n, m2 = F.col("n"), F.col("m2")
    return written(
        df.filter(known)
        .select(*by, F.col(value).cast("double").alias("x"))
        .groupBy(*by, _log_bucket(F.col("x")).alias("bucket"))
        .agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"),
            F.var_pop("x").alias("_variance"), F.skewness("x").alias("_skewness"), F.kurtosis("x").alias("_kurtosis"),
        )
        .withColumn("m2", n * F.col("_variance"))
        .withColumns(
            {
                # a bucket of equal values has neither
                "m3": F.coalesce(F.col("_skewness"), F.lit(0.0)) * m2 * F.sqrt(F.col("_variance")),
                "m4": F.coalesce((F.col("_kurtosis") + 3) * m2 * F.col("_variance"), F.lit(0.0)),
            }
        )
        .select(*by, "bucket", "n", "low", "high", "mean", "m2", "m3", "m4")
    )


def moments(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """records, mean, std, min, max, skewness and kurtosis of every group from its buckets."""
    by = list(by)
    whole = buckets.groupBy(*by).agg(
        F.sum("n").alias("records"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"), F.min("low").alias("min"), F.max("high").alias("max")
    )
    n, m2, m3, m4 = (F.col(c) for c in ("n", "m2", "m3", "m4"))
    d = F.col("mean") - F.col("_mean")
    merged = buckets.join(whole, by).groupBy(*by, "records", "min", "max", F.col("_mean").alias("mean")).agg(
        F.sum(m2 + n * d * d).alias("_2"),
        F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("_3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("_4"),
    )
    size = F.col("records")
    return merged.select(
        *by, "records", "mean", F.sqrt(F.try_divide("_2", size - 1)).alias("std"), "min", "max",
        F.try_divide(F.sqrt(size) * F.col("_3"), F.pow("_2", F.lit(1.5))).alias("skewness"),
        (F.try_divide(size * F.col("_4"), F.col("_2") * F.col("_2")) - 3).alias("kurtosis"),
    )


def quantiles_of(buckets: DataFrame, df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles per group: ``by`` columns and ``quantiles`` array, from ``summaries`` of the same values.

    The read of the located buckets runs when this is called.
    """
    by = list(by)
    positions = [F.lit(float(p)) * (F.col("size") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in positions for f in (F.floor, F.ceil)]))
    inner = F.collect_set(F.col("rank") - F.col("before"))

    counted = buckets.select(*by, "bucket", "n", "low", "high").withColumn("size", F.sum("n").over(Window.partitionBy(*by)))
    in_bucket = written(
        _located(counted, by, "bucket", ranks)
        .groupBy(*by, "bucket", "low", "high", "size", F.col("before").alias("base"))
        .agg(inner.alias("ranks"))
    )
    # a few buckets per group: the planner knows the size of the written table and picks the join by it
    values = df.select(*by, F.col(value).cast("double").alias("x")).withColumn("bucket", _log_bucket(F.col("x")))
    inside = settled(
        values.join(in_bucket.select(*by, "bucket", "low", "high"), [*by, "bucket"])
        .groupBy(*by, "bucket", _slice(F.col("x"), F.col("low"), F.col("high")).alias("slice"), "x").agg(F.count("*").alias("n"))
    )
    slices = inside.groupBy(*by, "bucket", "slice").agg(F.sum("n").alias("n")).join(in_bucket, [*by, "bucket"])
    in_slice = (
        _located(slices, [*by, "bucket"], "slice", F.col("ranks"))
        .groupBy(*by, "bucket", "slice", "size", (F.col("base") + F.col("before")).alias("base"))
        .agg(inner.alias("ranks"))
    )
    ordered = inside.join(in_slice, [*by, "bucket", "slice"])
    found = _located(ordered, [*by, "base"], "x", F.col("ranks")).groupBy(*by).agg(
        F.map_from_entries(F.collect_set(F.struct(F.col("base") + F.col("rank"), "x"))).alias("at"),
        F.max("size").alias("size"),
    )

    def interpolated(p: Column) -> Column:
        low = F.element_at("at", F.floor(p).cast("bigint"))
        high = F.element_at("at", F.ceil(p).cast("bigint"))
        return low + (high - low) * (p - F.floor(p))

    return found.select(*by, F.array(*[interpolated(p) for p in positions]).alias("quantiles"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles per group: ``by`` columns and ``quantiles`` array."""
    return quantiles_of(summaries(df, by, value), df, by, value, probabilities)
