"""Node and link tables of the export flow diagram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.codes import hs2
from portolan.functions.labels import chapter_label, partner_label
from portolan.functions.numeric import total
from portolan.operators.directional import exports, top_per
from portolan.operators.naming import with_partner_name


def leading_flows(
    flows: DataFrame, countries: DataFrame, n: int = 50, focal: int | None = None, hs2_mode: str = "padded"
) -> DataFrame:
    """The largest (chapter, partner) export flows."""
    cells = (
        exports(flows, focal)
        .select("reporter", "partner", hs2(F.col("k"), hs2_mode).alias("hs2"), "v")
        .groupBy("reporter", "hs2", "partner")
        .agg(total("v").alias("value"))
    )
    named = with_partner_name(cells, countries)
    return top_per(named, ["reporter"], [F.desc("value"), F.asc("hs2"), F.asc("partner")], n)


def flow_nodes(
    flows: DataFrame, countries: DataFrame, n: int = 50, focal: int | None = None, hs2_mode: str = "padded"
) -> DataFrame:
    """Nodes with dense ids from 0: the reporter, then chapters, then partners.

    Chapters and partners are numbered in the order in which the flow list, from
    the largest flow down, first mentions them.
    """
    return _nodes(leading_flows(flows, countries, n, focal, hs2_mode), countries)


def _nodes(top: DataFrame, countries: DataFrame) -> DataFrame:
    seen = (
        top.select(
            "reporter",
            "rank",
            F.stack(
                F.lit(2),
                F.lit(1), chapter_label(F.col("hs2")),
                F.lit(2), F.col("partner_name"),
            ).alias("layer", "label"),
        )
        .groupBy("reporter", "layer", "label")
        .agg(F.min("rank").alias("first_rank"))
    )
    name = countries.select(F.col("country_code").alias("reporter"), "country_name")
    roots = (
        top.select("reporter")
        .distinct()
        .join(name, "reporter", "left")
        .select(
            "reporter",
            F.lit(0).alias("layer"),
            partner_label(F.col("country_name"), F.col("reporter")).alias("label"),
            F.lit(0).alias("first_rank"),
        )
    )
    order = Window.partitionBy("reporter").orderBy("layer", "first_rank")
    return roots.unionByName(seen).select(
        "reporter", (F.row_number().over(order) - 1).alias("node_id"), "layer", "label"
    )


def flow_links(
    flows: DataFrame, countries: DataFrame, n: int = 50, focal: int | None = None, hs2_mode: str = "padded"
) -> DataFrame:
    """Links reporter -> chapter and chapter -> partner, two per listed flow.

    The first hops of a chapter are not merged: each listed flow has its own.
    """
    top = leading_flows(flows, countries, n, focal, hs2_mode)
    nodes = _nodes(top, countries)
    chapter = nodes.filter(F.col("layer") == 1).select("reporter", F.col("label").alias("chapter"), F.col("node_id").alias("chapter_id"))
    partner = nodes.filter(F.col("layer") == 2).select("reporter", F.col("label").alias("partner_name"), F.col("node_id").alias("partner_id"))
    return (
        top.withColumn("chapter", chapter_label(F.col("hs2")))
        .join(chapter, ["reporter", "chapter"])
        .join(partner, ["reporter", "partner_name"])
        .select(
            "reporter",
            "rank",
            F.stack(
                F.lit(2),
                F.lit(1), F.lit(0), F.col("chapter_id"),
                F.lit(2), F.col("chapter_id"), F.col("partner_id"),
            ).alias("hop", "source", "target"),
            "value",
        )
    )
