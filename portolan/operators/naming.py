"""Attaching names after aggregation.

Names hang on codes, so an analysis groups by code first and joins the few
grouped rows, not the flows, to the dimension.  No broadcast is forced: the
optimizer broadcasts a dimension when its size is under the session's threshold
and otherwise shuffles the grouped rows.  Dimension keys are taken as unique;
``quality.duplicate_keys`` lists the ones that are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.functions.codes import hs6


def with_partner_name(df: DataFrame, countries: DataFrame, keep_unnamed: bool = False) -> DataFrame:
    """Adds ``partner_name``.  Groups keyed by a name lose their unnamed rows."""
    names = countries.select(
        F.col("country_code").alias("partner"), F.col("country_name").alias("partner_name")
    )
    if keep_unnamed:
        return df.join(names, "partner", "left")
    return df.join(names.filter(F.col("partner_name").isNotNull()), "partner")


def with_description(df: DataFrame, products: DataFrame, keep_unnamed: bool = False) -> DataFrame:
    """Adds ``description`` by the padded code of ``k``."""
    names = products.select(F.col("code").alias("_hs6"), "description")
    keyed = df.withColumn("_hs6", hs6(F.col("k")))
    if keep_unnamed:
        return keyed.join(names, "_hs6", "left").drop("_hs6")
    return keyed.join(names.filter(F.col("description").isNotNull()), "_hs6").drop("_hs6")
