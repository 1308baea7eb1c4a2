"""Standing of a reporter's leading export products against other exporters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.numeric import share, usd
from portolan.operators.directional import exports, top_per


def leading_products(flows: DataFrame, n: int = 20, focal: int | None = None) -> DataFrame:
    """The reporter's largest export products (reporter, k, own)."""
    own = exports(flows, focal).groupBy("reporter", "k").agg(F.sum("v").alias("own"))
    return top_per(own, ["reporter"], [F.desc("own"), F.asc("k")], n, rank="place")


def _exporter_values(flows: DataFrame, chosen: DataFrame, focal: int | None) -> DataFrame:
    """Value per (product, exporter); for one reporter only of the chosen products.

    The flows shrink to these pairs before they meet the chosen list.
    """
    if focal is not None:
        return flows.groupBy("k", "i").agg(F.sum("v").alias("v")).join(chosen.select("k"), "k", "left_semi")
    return flows.groupBy("k", "i").agg(F.sum("v").alias("v"))


def competitive_position(
    flows: DataFrame, n: int = 20, rivals: int = 5, focal: int | None = None
) -> DataFrame:
    """World share and main rivals of the leading export products, values in USD.

    The ``rivals`` column is an array of (exporter, value_usd), best first.  A
    product keeps one more leader than needed, since the reporter itself may be
    among them.
    """
    chosen = leading_products(flows, n, focal)
    # A product has one row per exporter here.
    world = Window.partitionBy("k")
    standing = Window.partitionBy("k").orderBy(F.desc("v"), F.asc("i"))
    products = (
        _exporter_values(flows, chosen, focal)
        .withColumns({"r": F.row_number().over(standing), "world": F.sum("v").over(world)})
        .groupBy("k")
        .agg(
            F.max("world").alias("world"),
            F.array_sort(
                F.collect_list(
                    F.when(
                        F.col("r") <= rivals + 1,
                        F.struct("r", F.col("i").alias("exporter"), usd(F.col("v").cast("double")).alias("value_usd")),
                    )
                )
            ).alias("leaders"),
        )
    )
    others = F.slice(F.filter("leaders", lambda x: x["exporter"] != F.col("reporter")), 1, rivals)
    own, everyone = usd(F.col("own").cast("double")), usd(F.col("world").cast("double"))
    return chosen.join(products, "k").select(
        "reporter",
        "place",
        F.col("k").alias("product"),
        own.alias("exports_usd"),
        everyone.alias("world_usd"),
        share(own, everyone).alias("market_share"),
        F.transform(others, lambda x: F.struct(x["exporter"].alias("exporter"), x["value_usd"].alias("value_usd"))).alias(
            "rivals"
        ),
    )


def competitive_rivals(flows: DataFrame, n: int = 20, rivals: int = 5, focal: int | None = None) -> DataFrame:
    """The rivals of ``competitive_position`` as rows."""
    return (
        competitive_position(flows, n, rivals, focal)
        .select("reporter", "product", F.posexplode("rivals"))
        .select(
            "reporter", "product", (F.col("pos") + 1).alias("rival_rank"),
            F.col("col.exporter").alias("rival"), F.col("col.value_usd").alias("rival_usd"),
        )
    )


def competitive_rank(
    flows: DataFrame, n: int = 20, field: int = 10, focal: int | None = None
) -> DataFrame:
    """Rank among the ``field`` largest exporters and share of that field.

    A product in which the reporter does not reach the field is left out.
    """
    chosen = leading_products(flows, n, focal)
    inside = Window.partitionBy("k")
    leaders = top_per(
        _exporter_values(flows, chosen, focal), ["k"], [F.desc("v"), F.asc("i")], field, rank="exporter_rank"
    ).withColumns({"leader": F.max("v").over(inside), "field": F.sum("v").over(inside)})
    mine = leaders.withColumnRenamed("i", "reporter")
    return mine.join(chosen.select("reporter", "k"), ["reporter", "k"], "left_semi").select(
        "reporter",
        F.col("k").alias("product"),
        "exporter_rank",
        F.col("v").cast("double").alias("value"),
        F.col("leader").cast("double").alias("leader_value"),
        share(F.col("v").cast("double"), F.col("field").cast("double")).alias("field_share"),
    )
