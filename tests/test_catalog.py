import math
import os

import pytest

import __spark_entry__ as entry_module
from portolan.plans import catalog

duckdb = pytest.importorskip("duckdb")

QUERIES = catalog.queries()
SQL = catalog.oracle_sql()
# The same builders and SQL without the reporter filter run at a larger scale
# outside the unit tests; these stand for them here.
WHOLE = {
    "top_partners_all_reporters", "concentration_all_reporters", "value_distribution_all_reporters",
    "trend_all_reporters", "product_opportunities_all_reporters", "opportunity_counts_all_reporters",
    "competitive_rank_all_reporters", "density_clusters_all_reporters", "emerging_partners_all_reporters",
}
CHECKED = [n for n in SQL if not n.endswith("_all_reporters") or n in WHOLE]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def canonical(table):
    names = sorted(table.column_names)
    cells = zip(*[table.column(n).to_pylist() for n in names])
    return names, sorted([tuple(r) for r in cells], key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    names, got = canonical(QUERIES[name](spark, sf_dir).toArrow())
    sql_names, expected = canonical(duck.sql(SQL[name]).to_arrow_table())
    assert names == sql_names
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)), (a, b)


def test_entry_runs(spark, sf_dir):
    assert entry_module.entry(spark).count() > 0


def test_entry_lists_every_analysis():
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("code", [0, 24])
def test_partners_of_every_nation_count(spark, sf_dir, code):
    """Named partners add up to the totals of the reporter; no nation is left out."""
    totals = {r["reporter"]: r for r in QUERIES["trade_direction_all_reporters"](spark, sf_dir).collect()}
    rows = [r for r in QUERIES["balance_by_partner_all_reporters"](spark, sf_dir).collect()]
    assert any(r["partner"] == code for r in rows) and any(r["reporter"] == code for r in rows)
    for reporter, total in totals.items():
        own = [r for r in rows if r["reporter"] == reporter]
        assert math.isclose(sum(r["exports"] for r in own), total["export_value"], rel_tol=1e-9)
        assert math.isclose(sum(r["imports"] for r in own), total["import_value"], rel_tol=1e-9)


def test_every_twin_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert {n for n in QUERIES if n not in SQL} == {
        "kmeans_sweep", "kmeans_centers", "basic_segments", "partner_segments", "component_variance",
    }
