"""Table schemas, required columns and default thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

FLOW = T.StructType(
    [
        T.StructField("t", T.IntegerType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("q", T.DoubleType()),
    ]
)

COUNTRY = T.StructType(
    [
        T.StructField("country_code", T.IntegerType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("country_iso2", T.StringType()),
        T.StructField("country_iso3", T.StringType()),
    ]
)

# The code stays text: read as a number it would lose its leading zero.
PRODUCT = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

FLOW_COLUMNS = ("t", "i", "j", "k", "v", "q")
COUNTRY_COLUMNS = ("country_code", "country_name", "country_iso3")
PRODUCT_COLUMNS = ("code", "description")

# Thresholds and list lengths of the published analyses.
MIN_FLOW_VALUE = 1000
NULL_ALERT_PCT = 50
HHI_HIGH = 0.25
HHI_MODERATE = 0.15
RECENT_YEARS = (2020, 2021, 2022, 2023)
EMERGING_MIN_GROWTH_PCT = 20
EMERGING_MIN_VALUE_USD = 1_000_000
