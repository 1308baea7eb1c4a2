"""The flow model over order-line star tables.

A line item becomes a flow from the supplier's nation to the customer's nation
in the year of the order.  Brand, size and type make up a six-digit product
code; the tax rate marks unknown (NULL) and zero quantities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.codes import hs6
from portolan.sources.readers import TradeData

# The last two digits of the product code, any other type is 6.
TYPE_DIGITS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5}
OTHER_TYPE = 6

# Declared columns: no job has to read file footers to find the types.  Keys are
# read at their widest; the order date is inferred, as files differ in its kind.
COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double",
    "customer": "c_custkey bigint, c_nationkey bigint",
    "supplier": "s_suppkey bigint, s_nationkey bigint",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size bigint",
    "nation": "n_nationkey bigint, n_name string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(COLUMNS[name]) if name in COLUMNS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(
        *[F.when(F.col("p_type") == name, F.lit(digit)) for name, digit in TYPE_DIGITS.items()], F.lit(OTHER_TYPE)
    )
    brand = F.expr("CAST(substr(p_brand, 7) AS INT)")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", (brand * 10000 + F.col("p_size") * 100 + kind).cast("int").alias("k"), "p_brand", "p_type", "p_size"
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow rows (t, i, j, k, v, q), lazily joined.

    Orders meet customers before line items meet orders, so the line items, the
    largest table, are shuffled by order key only once; supplier and part are
    broadcast by the optimizer while they are under the session's threshold.
    Parts come last: a filter on both ends of a flow then runs before they do.
    """
    dated = (
        _table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("t"))
        .join(
            _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("j")),
            "o_custkey",
        )
        .select(F.col("o_orderkey").alias("l_orderkey"), "t", "j")
    )
    sellers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("i"))
    goods = _parts(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "k")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    quantity = F.when(F.col("l_tax") == 0.0, F.lit(None)).when(F.col("l_tax") == 0.01, F.lit(0.0)).otherwise(F.col("l_quantity"))
    return (
        _table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey", "l_suppkey", "l_partkey", value.cast("decimal(18,4)").alias("v"), quantity.alias("q")
        )
        .join(sellers, "l_suppkey")
        .join(dated, "l_orderkey")
        .join(goods, "l_partkey")
        .select("t", "i", "j", "k", "v", "q")
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("n_nationkey").cast("int")
    return (
        _table(spark, sf_dir, "nation")
        .select(
            code.alias("country_code"),
            F.col("n_name").alias("country_name"),
            F.concat(F.lit("N"), F.lpad(code.cast("string"), 2, "0")).alias("country_iso3"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _parts(spark, sf_dir)
        .select(
            hs6(F.col("k")).alias("code"),
            F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("description"),
        )
        .distinct()
    )


def trade_data(spark: SparkSession, sf_dir: str) -> TradeData:
    return TradeData(flows(spark, sf_dir), countries(spark, sf_dir), products(spark, sf_dir))
