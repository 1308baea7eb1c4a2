"""The four reports as named result tables.

Each function returns a dictionary of DataFrames.  A table runs when it is read or
written; the segmentation, the quantile search and shared yearly totals run their
first passes when the report is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.operators import (
    charts,
    competition,
    complexity,
    concentration,
    distribution,
    flowgraph,
    partners,
    products,
    segments,
    timeseries,
    totals,
)
from portolan.plans.session import settled, written
from portolan.schema import RECENT_YEARS
from portolan.sinks import result_document, write_sections, write_tables
from portolan.sources.readers import TradeData, prepared_flows

Tables = dict[str, DataFrame]


def basic_report(data: TradeData, focal: int | None = None) -> Tables:
    """Totals, leading partners and products, yearly trends, summary and their charts."""
    f, c, p = data
    return {
        "overview": totals.data_overview(f),
        "trade_direction": totals.trade_direction(f, focal),
        "top_partners": partners.top_partners(f, c, focal=focal),
        "top_products": products.top_products(f, p, focal=focal),
        "yearly_trends": totals.yearly_trends(f, focal),
        "summary": totals.summary_report(f, c, focal),
        "direction_bars": totals.direction_totals(f, focal),
        "partner_bars": charts.partner_name_bars(f, c, focal=focal),
        "chapter_pie": charts.chapter_pie(f, focal=focal),
        "yearly_lines": charts.yearly_lines(f, focal),
    }


def deep_report(data: TradeData, focal: int) -> Tables:
    """Statistics in USD, complexity, partner clusters, growth, lifecycle and competition."""
    f, c, p = data
    clusters = segments.basic_segments(f, c, focal)
    return {
        "value_distribution": distribution.value_distribution(f, focal, scale=1000),
        "concentration": concentration.concentration(f, focal, hs2_mode="raw"),
        "export_complexity": complexity.export_complexity(f, focal),
        "product_complexity": complexity.product_ubiquity(f),
        "market_penetration": complexity.market_penetration(f, focal),
        "partner_clusters": clusters.points,
        "partner_variance": clusters.variance,
        "growth": timeseries.growth(f, focal, years="own"),
        "product_lifecycle": timeseries.product_lifecycle(f, focal),
        "competitive_position": competition.competitive_position(f, focal=focal),
        "complexity_histogram": complexity.complexity_histogram(f),
        "product_treemap": charts.product_treemap(f, p, focal=focal),
        "export_map": charts.export_map(f, c, focal),
        "competitive_bubbles": charts.competitive_bubbles(f, focal),
    }


def flow_cube(flows: DataFrame) -> DataFrame:
    """Value and quantity per (t, i, j, k), written once for the analyses that only add flows up.

    Sums over it and distinct counts of its codes equal those over the flows;
    counts and spreads of flows do not.
    """
    return written(flows.groupBy("t", "i", "j", "k").agg(F.sum("v").alias("v"), F.sum("q").alias("q")))


def stored_flows(data: TradeData) -> TradeData:
    """The same data with its flows written once as files.

    For reports over flows that are a view: each section about single flows would
    otherwise join the tables behind the view again.
    """
    return data._replace(flows=written(data.flows))


def statistics_sections(data: TradeData, focal: int | None = None, cube: DataFrame | None = None) -> Tables:
    """The statistical and complexity results that carry a reporter.

    Sections about sums read one stored cube; only those about single flows read
    the flows. The cube, unless given, and the yearly totals are computed when this
    is called.
    """
    f = data.flows
    cube = flow_cube(f) if cube is None else cube
    years = settled(totals.yearly_counts(cube, focal))
    both = totals.on_years(years, "both")
    series = timeseries.series_of(both)
    return {
        "metadata": totals.run_metadata(f, focal),
        "summary_statistics": totals.summary_kpis(cube, focal),
        "value_distribution": distribution.value_distribution(f, focal),
        "concentration": concentration.concentration(cube, focal),
        "correlations": distribution.correlations(f, focal),
        "yearly": totals.on_years(years, "union"),
        "balance_openness": timeseries.balance_openness_of(both),
        "growth_stats": timeseries.growth_stats_of(series),
        "trend": timeseries.trend_of(series),
        "export_share_latest": timeseries.export_share_latest(cube, focal=focal),
        "trade_intensity": products.trade_intensity(f, focal=focal),
        "export_complexity": complexity.export_complexity(f, focal),
        "economic_complexity": complexity.economic_complexity(cube, focal),
        "market_penetration": complexity.mean_penetration(cube, focal),
        "opportunity_counts": complexity.opportunity_counts(cube, focal=focal),
        "product_opportunities": complexity.product_opportunities(cube, focal=focal),
    }


def result_sections(data: TradeData, focal: int | None = None) -> Tables:
    """All results: the statistics, every product's penetration and ubiquity, and the segmentation.

    ``product_complexity`` is about the world and has no reporter.
    """
    cube = flow_cube(data.flows)
    found = segments.partner_segments(cube, data.countries, focal)
    return {
        **statistics_sections(data, focal, cube),
        "product_penetration": complexity.market_penetration(cube, focal),
        "product_complexity": complexity.product_ubiquity(cube),
        "partner_segments": found.partners,
        "kmeans_scores": found.sweep,
        "kmeans_centers": found.centers,
        "density_summary": found.density,
        "component_variance": found.variance,
    }


def write_results(data: TradeData, folder: str, focal: int | None = None) -> DataFrame:
    """Writes all results below ``folder`` and returns the manifest read back from them.

    Lists of any length are section tables, in a folder per reporter; the document
    of a reporter (``documents``) holds its metadata and key figures and names the
    sections with their rows, so that it stays small.
    """
    return write_sections(result_sections(data, focal), folder, inline=("metadata", "summary_statistics"))


def enhanced_report(data: TradeData, focal: int) -> Tables:
    """All statistics, segmentation and charts; pass flows that went through ``clean``."""
    f, c, _ = data
    found = segments.partner_segments(f, c, focal)
    return {
        **statistics_sections(data, focal),
        "partner_segments": found.partners,
        "kmeans_scores": found.sweep,
        "kmeans_centers": found.centers,
        "density_summary": found.density,
        "component_variance": found.variance,
        "yearly_billions": charts.yearly_lines_billions(f, focal),
        "hhi_gauge": charts.hhi_gauge(f, focal),
        "flow_nodes": flowgraph.flow_nodes(f, c, focal=focal),
        "flow_links": flowgraph.flow_links(f, c, focal=focal),
        "portfolio_matrix": complexity.portfolio_matrix(f, focal),
        "export_map": charts.export_map(f, c, focal),
        "time_panel": timeseries.time_panel(f, focal),
        "trend_lines": timeseries.trend_lines(f, focal),
        "competitive_rank": competition.competitive_rank(f, focal=focal),
        "risk_indicators": concentration.risk_indicators(f, focal),
    }


def partner_report(data: TradeData, focal: int | None = None, years: Sequence[int] = RECENT_YEARS) -> Tables:
    """Partner and product profiles, emerging partners and partner balances."""
    f, c, p = data
    return {
        "partner_profile": partners.partner_profile(f, c, focal=focal),
        "emerging_partners": partners.emerging_partners(f, c, years, focal=focal),
        "product_profile": products.product_profile(f, p, focal=focal),
        "balance_by_partner": partners.balance_by_partner(f, c, focal=focal),
        "balance_headlines": charts.balance_headlines(f, c, focal),
        "product_market_matrix": products.product_market_matrix(f, c, p, focal=focal),
        "partner_bars": charts.partner_bars(f, c, focal=focal),
        "emerging_scatter": charts.emerging_scatter(f, c, years, focal),
        "product_bars": charts.product_bars(f, p, focal=focal),
        "balance_bars": charts.balance_bars(f, c, focal=focal),
        "partner_table": charts.partner_table(f, c, focal=focal),
        "product_table": charts.product_table(f, p, focal=focal),
        "emerging_table": charts.emerging_table(f, c, years, focal=focal),
    }


def json_results(data: TradeData, focal: int | None = None) -> DataFrame:
    """The statistics as one JSON document per reporter."""
    return result_document(statistics_sections(data, focal))


def export_tables(data: TradeData, focal: int, folder: str, fmt: str = "parquet") -> list[str]:
    """Writes the reporter's exports, imports, partner clusters and summary metrics."""
    rows = prepared_flows(data, focal)
    return write_tables(
        {
            "exports": rows.filter(F.col("i") == focal),
            "imports": rows.filter(F.col("j") == focal),
            "clustering": segments.partner_segments(data.flows, data.countries, focal).partners,
            "summary": totals.summary_metrics(data.flows, focal),
        },
        folder,
        fmt,
    )
