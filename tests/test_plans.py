"""What the physical plans must and must not contain."""

import re

import pytest

from portolan.operators import charts, competition, complexity, concentration, distribution, flowgraph
from portolan.operators import partners, products as goods, quality, timeseries, totals
from portolan.sources import star

PLANS = {
    "trade_direction": (lambda f, c, p, x: totals.trade_direction(f, x), "i,j,v"),
    "summary_report": (lambda f, c, p, x: totals.summary_report(f, c, x), "i,j,k,v"),
    "yearly": (lambda f, c, p, x: totals.yearly(f, x), "t,i,j,v"),
    "top_partners": (lambda f, c, p, x: partners.top_partners(f, c, 10, x), "i,j,v"),
    "top_products": (lambda f, c, p, x: goods.top_products(f, p, 10, x), "i,j,k,v"),
    "partner_profile": (lambda f, c, p, x: partners.partner_profile(f, c, 20, x), "t,i,j,k,v"),
    "balance_by_partner": (lambda f, c, p, x: partners.balance_by_partner(f, c, 30, x), "i,j,v"),
    "concentration": (lambda f, c, p, x: concentration.concentration(f, x), "i,j,k,v"),
    "correlations": (lambda f, c, p, x: distribution.correlations(f, x), "i,j,k,v,q"),
    "series": (lambda f, c, p, x: timeseries.series(f, x), "t,i,j,v"),
    "emerging_partners": (lambda f, c, p, x: partners.emerging_partners(f, c, focal=x), "t,i,j,v"),
}
WORLD = {
    "competitive_position": lambda f, c, p, x: competition.competitive_position(f, focal=x),
    "competitive_rank": lambda f, c, p, x: competition.competitive_rank(f, focal=x),
    "market_penetration": lambda f, c, p, x: complexity.market_penetration(f, x),
    "product_opportunities": lambda f, c, p, x: complexity.product_opportunities(f, 20, x),
    "economic_complexity": lambda f, c, p, x: complexity.economic_complexity(f, x),
    "export_complexity": lambda f, c, p, x: complexity.export_complexity(f, x),
    "flow_links": lambda f, c, p, x: flowgraph.flow_links(f, c, focal=x),
    "product_market_matrix": lambda f, c, p, x: goods.product_market_matrix(f, c, p, focal=x),
    "treemap": lambda f, c, p, x: charts.product_treemap(f, p, focal=x),
    "unmatched": lambda f, c, p, x: quality.unmatched_references(f, c, p),
    "merge_growth": lambda f, c, p, x: quality.merge_growth(f, c, p),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    spark.sql("SELECT 2020 t, 1 i, 2 j, 10100 k, 1D v, 1D q").write.parquet(str(folder / "f"))
    spark.sql("SELECT 1 country_code, 'A' country_name, 'A' country_iso3").write.parquet(str(folder / "c"))
    spark.sql("SELECT '010100' code, 'x' description").write.parquet(str(folder / "p"))
    return [spark.read.parquet(str(folder / n)) for n in "fcp"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("focal", [50, None])
@pytest.mark.parametrize("name", [*PLANS, *WORLD])
def test_no_pairwise_joins(tables, name, focal):
    build = PLANS[name][0] if name in PLANS else WORLD[name]
    text = plan(build(*tables, focal))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", PLANS)
def test_reporter_and_columns_reach_the_scan(tables, name):
    build, columns = PLANS[name]
    text = plan(build(*tables, 50))
    scans = [s for s in re.findall(r"FileScan parquet [^\n]*", text) if re.search(r"\bi#", s)]
    assert scans
    for scan in scans:
        assert "Or(EqualTo(i,50),EqualTo(j,50))" in scan
        read = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
        assert set(re.findall(r"(\w+):", read)) <= set(columns.split(","))


def test_years_reach_the_scan(tables):
    text = plan(partners.emerging_partners(tables[0], tables[1], (2020, 2023), focal=50))
    assert "In(t, [2020,2023])" in text


def test_one_scan_serves_both_directions(tables):
    for name in ("trade_direction", "yearly", "top_partners", "concentration", "balance_by_partner"):
        text = plan(PLANS[name][0](*tables, 50)).split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan parquet \[[^\]]*\bi#", text)) == 1, name


def test_top_lists_are_cut_before_the_shuffle(tables):
    for build in (PLANS["top_partners"][0], PLANS["top_products"][0]):
        assert "WindowGroupLimit" in plan(build(*tables, None))


def test_reporter_filter_runs_before_parts_join(spark, sf_dir):
    """In the flow view over the star tables the filter on both ends is part of a join below that of parts."""
    text = star.flows(spark, sf_dir).filter("i = 18 OR j = 18").groupBy("k").count()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.split("\n") if "Join Inner" in line]  # the outermost first
    assert "l_partkey" in joins[0] and "18) OR" in joins[1] and "18) OR" not in joins[0]
