"""Product complexity, diversity, market penetration and open opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.codes import hs2
from portolan.functions.labels import quadrant
from portolan.functions.numeric import share, total
from portolan.operators.directional import exports, top_per
from portolan.operators.distribution import histogram
from portolan.operators.ranks import Ordered, ordered


def product_ubiquity(flows: DataFrame) -> DataFrame:
    """Exporters per product over all flows, and the inverse as complexity score."""
    return (
        flows.groupBy(F.col("k").alias("product"))
        .agg(F.count_distinct("i").alias("ubiquity"))
        .withColumn("complexity_score", 1 / F.col("ubiquity"))
    )


def exporter_products(flows: DataFrame) -> DataFrame:
    """One row per (exporter, product) with value, flow count and product ubiquity.

    After the grouping a product's ubiquity is its number of rows, counted in a
    window of at most one row per exporter: no second scan and no join back.
    """
    return (
        flows.groupBy(F.col("i").alias("reporter"), "k")
        .agg(F.sum("v").alias("v"), F.count("*").alias("records"))
        .withColumn("ubiquity", F.count("*").over(Window.partitionBy("k")))
        .withColumn("complexity_score", 1 / F.col("ubiquity"))
    )


def export_complexity(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Value-weighted complexity of exports and the spread of the score over flows.

    Every flow counts once, so the per-product rows carry their flow count as
    weight.  Scores are inverses of exporter counts: few distinct values exist.
    """
    rows = exporter_products(flows)
    if focal is not None:
        rows = rows.filter(F.col("reporter") == focal)
    c, w = F.col("complexity_score"), F.col("records")
    n = F.sum("records")
    quartiles = F.percentile("complexity_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), w)
    variance = F.try_divide(F.sum(w * c * c) - F.sum(w * c) * F.sum(w * c) / n, n - 1)
    return (
        rows.groupBy("reporter")
        .agg(
            share(F.sum(F.col("v").cast("double") * c), total("v")).alias("avg_export_complexity"),
            n.alias("records"),
            (F.sum(w * c) / n).alias("mean"),
            F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
            F.min("complexity_score").alias("min"),
            quartiles.alias("quartiles"),
            F.max("complexity_score").alias("max"),
        )
        .select(
            "reporter", "avg_export_complexity", "records", "mean", "std", "min",
            F.col("quartiles")[0].alias("p25"),
            F.col("quartiles")[1].alias("p50"),
            F.col("quartiles")[2].alias("p75"),
            "max",
        )
    )


def complexity_histogram(flows: DataFrame, bins: int = 20) -> DataFrame:
    """Products per complexity bin."""
    return histogram(product_ubiquity(flows), "complexity_score", bins)


def economic_complexity(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Products exported, the mean over exporters and the share of exporters below."""
    diversity = flows.groupBy(F.col("i").alias("reporter")).agg(F.count_distinct("k").alias("diversity"))
    placed = ordered(diversity, [F.asc("diversity"), F.asc("reporter")])
    ladder = placed.rows.groupBy("diversity").agg((F.min("place") - 1).alias("below"))
    mean = placed.rows.agg(F.avg("diversity")).scalar()
    mine = placed.rows if focal is None else placed.rows.filter(F.col("reporter") == focal)
    return mine.select("reporter", "diversity").join(ladder, "diversity").select(
        "reporter",
        "diversity",
        mean.alias("mean_diversity"),
        (F.col("below") / F.lit(placed.size) * 100).alias("diversity_percentile"),
    )


def market_penetration(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Markets a reporter reaches with a product against all markets of the product."""
    # Without a focal reporter both counts can start from the distinct triples.
    source = flows if focal is not None else flows.select("i", "j", "k").distinct()
    reached = (
        exports(source, focal).groupBy("reporter", "k").agg(F.count_distinct("partner").alias("markets"))
    )
    everywhere = source.groupBy("k").agg(F.count_distinct("j").alias("total_markets"))
    return reached.join(everywhere, "k").select(
        "reporter",
        F.col("k").alias("product"),
        "markets",
        "total_markets",
        (F.col("markets") / F.col("total_markets")).alias("penetration_rate"),
    )


def mean_penetration(flows: DataFrame, focal: int | None = None) -> DataFrame:
    return (
        market_penetration(flows, focal)
        .groupBy("reporter")
        .agg(F.avg("penetration_rate").alias("avg_penetration_rate"), F.count("*").alias("products"))
    )


def product_metrics(flows: DataFrame) -> DataFrame:
    """World value, exporters, importers and complexity of each product.

    The two distinct counts repeat each row before the partial aggregation, which
    then holds (product, exporter) and (product, importer) pairs.  Grouping by all
    three first would shuffle nearly every flow.
    """
    return (
        flows.groupBy(F.col("k").alias("product"))
        .agg(
            total("v").alias("global_value"),
            F.count_distinct("i").alias("num_exporters"),
            F.count_distinct("j").alias("num_importers"),
        )
        .withColumn("complexity", 1 / F.col("num_exporters"))
    )


def _ranked_candidates(flows: DataFrame) -> Ordered:
    """Products above both medians with their place by world value.

    The products are sorted once: the median value, and the places of the products
    above both medians, follow from it. A product's complexity only depends on its
    number of exporters, so that the other median needs one row per such number.
    """
    by_value = ordered(product_metrics(flows), [F.desc("global_value"), F.asc("product")])
    levels = by_value.rows.groupBy("complexity").agg(F.count("*").alias("n"))
    complexity = levels.agg(F.percentile("complexity", F.lit(0.5), F.col("n"))).scalar()
    return by_value.only((F.col("complexity") > complexity) & (F.col("global_value") > by_value.median("global_value")))


def opportunity_candidates(flows: DataFrame) -> DataFrame:
    """Products above both the median complexity and the median world value of all products."""
    return _ranked_candidates(flows).rows.drop("place")


def _not_exported(candidates: DataFrame, flows: DataFrame, focal: int) -> DataFrame:
    mine = flows.filter(F.col("i") == focal).select(F.col("k").alias("product")).distinct()
    return candidates.join(mine, "product", "left_anti").withColumn("reporter", F.lit(focal))


def product_opportunities(flows: DataFrame, n: int = 20, focal: int | None = None) -> DataFrame:
    """Leading candidate products that a reporter does not export yet.

    For all reporters the missing (reporter, product) pairs are never spelled
    out: a reporter that exports ``m`` candidates finds its first ``n`` open ones
    among the first ``n + m``, so only that many ranks are looked at.
    """
    ranked = _ranked_candidates(flows).rows
    columns = ["reporter", "rank", "product", "global_value", "num_exporters", "num_importers", "complexity"]
    if focal is not None:
        return top_per(_not_exported(ranked, flows, focal), ["reporter"], [F.asc("place")], n).select(*columns)
    held = (
        flows.select(F.col("i").alias("reporter"), F.col("k").alias("product"))
        .distinct()
        .join(ranked.select("product", "place"), "product", "left")
    )
    reach = held.groupBy("reporter").agg(F.count("place").alias("held"))
    open_places = reach.select("reporter", F.explode(F.sequence(F.lit(1), F.col("held") + n)).alias("place")).join(
        held.select("reporter", F.col("place").cast("bigint").alias("place")), ["reporter", "place"], "left_anti"
    )
    first = top_per(open_places, ["reporter"], [F.asc("place")], n)
    return first.join(ranked, "place").select(*columns)


def opportunity_counts(flows: DataFrame, n: int = 20, focal: int | None = None) -> DataFrame:
    """Number of opportunities, as listed (never above ``n``) and uncut."""
    found = _ranked_candidates(flows)
    candidates = found.rows.select("product")
    if focal is not None:
        counts = _not_exported(candidates, flows, focal).agg(F.lit(focal).alias("reporter"), F.count("*").alias("uncut_count"))
    else:
        held = (
            flows.select(F.col("i").alias("reporter"), F.col("k").alias("product"))
            .distinct()
            .join(candidates.withColumn("is_candidate", F.lit(1)), "product", "left")
            .groupBy("reporter")
            .agg(F.count("is_candidate").alias("held"))
        )
        counts = held.select("reporter", (F.lit(found.size) - F.col("held")).alias("uncut_count"))
    return counts.select(
        "reporter",
        F.least(F.col("uncut_count"), F.lit(n).cast("bigint")).alias("opportunity_count"),
        "uncut_count",
    )


def portfolio_matrix(flows: DataFrame, focal: int | None = None, hs2_mode: str = "padded") -> DataFrame:
    """Chart data: reach, share, product count and quadrant of each export chapter."""
    chapters = (
        exports(flows, focal)
        .select("reporter", "partner", "k", hs2(F.col("k"), hs2_mode).alias("hs2"), "v")
        .groupBy("reporter", "hs2")
        .agg(
            total("v").alias("value"),
            F.count_distinct("partner").alias("market_reach"),
            F.count_distinct("k").alias("products"),
        )
    )
    # A reporter has at most a hundred chapters.
    mine = Window.partitionBy("reporter")
    return (
        chapters.withColumn("market_share", F.try_divide(F.col("value"), F.sum("value").over(mine)))
        .withColumns(
            {
                "median_reach": F.percentile("market_reach", F.lit(0.5)).over(mine),
                "median_share": F.percentile("market_share", F.lit(0.5)).over(mine),
            }
        )
        .withColumn(
            "quadrant",
            quadrant(F.col("market_reach"), F.col("market_share"), F.col("median_reach"), F.col("median_share")),
        )
    )
