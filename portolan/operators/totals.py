"""Totals per reporter and per year, headline figures and run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.numeric import coverage_pct, total, total_if
from portolan.operators.directional import SIDE, code_totals, exports, sides
from portolan.operators.naming import with_partner_name


def is_export() -> Column:
    return F.col("direction") == "export"


def is_import() -> Column:
    return F.col("direction") == "import"


def trade_direction(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Records and value of both directions and the balance, one row per reporter."""
    return (
        sides(flows, focal)
        .groupBy("reporter")
        .agg(
            F.count_if(is_export()).alias("export_records"),
            F.count_if(is_import()).alias("import_records"),
            total_if(is_export(), "v").alias("export_value"),
            total_if(is_import(), "v").alias("import_value"),
        )
        .withColumn("balance", F.col("export_value") - F.col("import_value"))
    )


def yearly_counts(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Exports, imports and their record counts per year, from one aggregation."""
    return (
        sides(flows, focal)
        .groupBy("reporter", "t")
        .agg(
            total_if(is_export(), "v").alias("exports"),
            total_if(is_import(), "v").alias("imports"),
            F.count_if(is_export()).alias("export_records"),
            F.count_if(is_import()).alias("import_records"),
        )
    )


def on_years(counts: DataFrame, years: str) -> DataFrame:
    """Picks the year axis: ``export`` keeps years with exports, ``union`` years with
    either direction, ``both`` years with both.
    """
    keep = {
        "export": F.col("export_records") > 0,
        "union": F.lit(True),
        "both": (F.col("export_records") > 0) & (F.col("import_records") > 0),
    }[years]
    return counts.filter(keep).drop("export_records", "import_records")


def yearly(flows: DataFrame, focal: int | None = None, years: str = "union") -> DataFrame:
    """Exports and imports per year on the chosen year axis."""
    return on_years(yearly_counts(flows, focal), years)


def yearly_trends(flows: DataFrame, focal: int | None = None, years: str = "export") -> DataFrame:
    """Exports, imports and balance per year."""
    return yearly(flows, focal, years).withColumn("balance", F.col("exports") - F.col("imports"))


def summary_report(flows: DataFrame, countries: DataFrame, focal: int | None = None) -> DataFrame:
    """Headline figures, one row per reporter.

    The value per partner and per product code is computed once; totals, distinct
    counts and the leading partner all read that table.
    """
    codes = code_totals(flows, focal, F.col("k"))
    by_partner = F.col("dimension") == "country"
    counts = codes.groupBy(*SIDE).agg(
        total(F.when(by_partner, F.col("v"))).alias("value"),
        F.count_if(~by_partner).alias("n_products"),
        F.count_if(by_partner).alias("n_partners"),
    )
    # The partner is keyed by its name alone; equal sums go to the first name.
    leaders = (
        with_partner_name(codes.filter(by_partner).withColumnRenamed("code", "partner"), countries)
        .groupBy(*SIDE, "partner_name")
        .agg(total("v").alias("value"))
        .groupBy(*SIDE)
        .agg(F.min_by("partner_name", F.struct(-F.col("value"), "partner_name")).alias("top_partner"))
    )
    both = counts.join(leaders, list(SIDE), "left")

    def pick(side, name, default=None):
        c = F.max(F.when(side, F.col(name)))
        return c if default is None else F.coalesce(c, F.lit(default))

    return (
        both.groupBy("reporter")
        .agg(
            pick(is_export(), "value", 0.0).alias("total_exports"),
            pick(is_import(), "value", 0.0).alias("total_imports"),
            pick(is_export(), "top_partner").alias("top_export_partner"),
            pick(is_import(), "top_partner").alias("top_import_partner"),
            pick(is_export(), "n_products", 0).alias("export_products"),
            pick(is_import(), "n_products", 0).alias("import_products"),
            pick(is_export(), "n_partners", 0).alias("export_countries"),
            pick(is_import(), "n_partners", 0).alias("import_countries"),
        )
        .withColumns(
            {
                "balance": F.col("total_exports") - F.col("total_imports"),
                "coverage_pct": coverage_pct(F.col("total_exports"), F.col("total_imports")),
            }
        )
    )


def summary_kpis(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Totals, balance, export markets and export products."""
    by_partner = F.col("dimension") == "country"
    return (
        code_totals(flows, focal, F.col("k"))
        .groupBy("reporter")
        .agg(
            total_if(is_export() & by_partner, "v").alias("total_exports"),
            total_if(is_import() & by_partner, "v").alias("total_imports"),
            F.count_if(is_export() & by_partner).alias("export_markets"),
            F.count_if(is_export() & ~by_partner).alias("export_products"),
        )
        .withColumn("trade_balance", F.col("total_exports") - F.col("total_imports"))
    )


def summary_metrics(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """The headline figures as a tall table (reporter, metric, value)."""
    kpis = summary_kpis(flows, focal)
    cells = []
    # Names of the published metrics.
    for label, name in (
        ("Total Exports", "total_exports"),
        ("Total Imports", "total_imports"),
        ("Trade Balance", "trade_balance"),
        ("Export Markets", "export_markets"),
        ("Export Products", "export_products"),
    ):
        cells += [F.lit(label), F.col(name).cast("double")]
    return kpis.select("reporter", F.stack(F.lit(5), *cells).alias("metric", "value"))


def run_metadata(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Row counts: all flows given, and each reporter's exports and imports."""
    everything = flows.agg(F.count("*").alias("total_records"))
    per_reporter = (
        sides(flows, focal)
        .groupBy("reporter")
        .agg(F.count_if(is_export()).alias("export_records"), F.count_if(is_import()).alias("import_records"))
    )
    return per_reporter.withColumn("total_records", everything.scalar())


def data_overview(flows: DataFrame) -> DataFrame:
    """Columns, year range, total value and quantity and row count of the whole table."""
    return flows.agg(
        F.lit(",".join(flows.columns)).alias("columns"),
        F.min("t").alias("first_year"),
        F.max("t").alias("last_year"),
        total("v").alias("total_value"),
        total("q").alias("total_quantity"),
        F.count("*").alias("records"),
    )


def direction_totals(flows: DataFrame, focal: int | None = None) -> DataFrame:
    """Bar data: value per direction."""
    return sides(flows, focal).groupBy(*SIDE).agg(total("v").alias("value"))
