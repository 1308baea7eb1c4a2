"""Checks on the input tables and profiles of their gaps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.codes import hs6
from portolan.schema import FLOW_COLUMNS, NULL_ALERT_PCT


class QualityError(ValueError):
    """A table does not meet a requirement."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise QualityError(f"missing columns: {', '.join(gone)}")
    return df


def require_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    other = [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]
    if other:
        raise QualityError(f"not numeric: {', '.join(other)}")
    return df


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """Raises on an empty table; reads at most one row."""
    if df.isEmpty():
        raise QualityError(f"table {name} is empty")
    return df


def null_profile(
    df: DataFrame, columns: Sequence[str] = FLOW_COLUMNS, alert_pct: float = NULL_ALERT_PCT
) -> DataFrame:
    """Share of missing cells per column, flagged above ``alert_pct``."""
    gaps = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in columns])
    return gaps.unpivot([], list(columns), "column_name", "null_pct").withColumn(
        "flagged", F.col("null_pct") > alert_pct
    )


def code_counts(flows: DataFrame) -> DataFrame:
    """Flow rows per code and role: ``(role, code, records)``, one scan for all roles."""
    return (
        flows.select(
            F.stack(
                F.lit(3),
                F.lit("exporter"), F.col("i").cast("string"),
                F.lit("importer"), F.col("j").cast("string"),
                F.lit("product"), hs6(F.col("k")),
            ).alias("role", "code")
        )
        .groupBy("role", "code")
        .agg(F.count("*").alias("records"))
    )


def _known_codes(countries: DataFrame, products: DataFrame) -> DataFrame:
    """Named codes of both dimensions by role."""
    partner = countries.filter(F.col("country_name").isNotNull()).select(
        F.explode(F.array(F.lit("exporter"), F.lit("importer"))).alias("role"),
        F.col("country_code").cast("string").alias("code"),
    )
    product = products.filter(F.col("description").isNotNull()).select(F.lit("product").alias("role"), "code")
    return partner.unionByName(product)


def unmatched_references(flows: DataFrame, countries: DataFrame, products: DataFrame) -> DataFrame:
    """Flow rows whose exporter, importer or product has no name, one row per role.

    The flows shrink to code counts before they meet the dimensions.
    """
    counts = code_counts(flows)
    lost = counts.join(_known_codes(countries, products), ["role", "code"], "left_anti")
    tagged = counts.select("role", "records", F.lit(0).cast("bigint").alias("unmatched")).unionByName(
        lost.select("role", F.lit(0).cast("bigint").alias("records"), F.col("records").alias("unmatched"))
    )
    return tagged.groupBy("role").agg(
        F.sum("records").alias("records"), F.sum("unmatched").alias("unmatched_records")
    )


def duplicate_keys(dimension: DataFrame, key: str) -> DataFrame:
    """Dimension keys that occur more than once."""
    return dimension.groupBy(key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def merge_growth(flows: DataFrame, countries: DataFrame, products: DataFrame) -> DataFrame:
    """Row count before and after joining the dimensions.

    A row joins as many times as the product of the copies of its three keys, so
    only repeated dimension keys matter and only those are joined back.
    """
    twice = duplicate_keys(countries, "country_code")
    origin = twice.select(F.col("country_code").alias("i"), F.col("copies").alias("_ci"))
    destination = twice.select(F.col("country_code").alias("j"), F.col("copies").alias("_cj"))
    product = duplicate_keys(products, "code").select(F.col("code").alias("_hs6"), F.col("copies").alias("_ck"))
    one = F.lit(1).cast("bigint")
    copies = F.coalesce("_ci", one) * F.coalesce("_cj", one) * F.coalesce("_ck", one)
    return (
        flows.groupBy("i", "j", "k")
        .agg(F.count("*").alias("n"))
        .withColumn("_hs6", hs6(F.col("k")))
        .join(origin, "i", "left")
        .join(destination, "j", "left")
        .join(product, "_hs6", "left")
        .agg(
            F.sum("n").alias("rows_before"),
            F.sum(F.col("n") * copies).alias("rows_after"),
        )
        .withColumn("rows_added", F.col("rows_after") - F.col("rows_before"))
    )
