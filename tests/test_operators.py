import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.operators import (
    competition,
    complexity,
    concentration,
    directional,
    distribution,
    flowgraph,
    partners,
    products as goods,
    quantiles,
    ranks,
    timeseries,
    totals,
)
from portolan.operators.quantiles import exact_quantiles
from portolan.plans import catalog
from tests import golden


def test_self_flow_counts_twice(flows, as_rows):
    df = flows([(2020, 50, 50, 1, 5, 1), (2020, 50, 842, 1, 7, 1)])
    assert directional.sides(df).count() == 4
    (got,) = as_rows(totals.trade_direction(df, 50))
    assert (got["export_records"], got["import_records"], got["balance"]) == (2, 1, 7.0)


def test_sides_equal_exports_and_imports(flows):
    df = flows([(2020, a, b, 1, a + b, 1) for a in range(4) for b in range(4)])
    apart = directional.exports(df).unionByName(directional.imports(df))
    assert directional.sides(df).select(*apart.columns).exceptAll(apart).isEmpty()
    assert directional.sides(df).count() == 2 * df.count()


def test_ties_go_to_the_lower_code_and_unnamed_partners_drop(flows, countries, as_rows):
    df = flows([(2020, 50, 9, 1, 5, 1), (2020, 50, 4, 1, 5, 1), (2020, 50, 7, 1, 99, 1)])
    got = as_rows(partners.top_partners(df, countries([(9, "N", "N"), (4, "F", "F")]), 1, 50), "direction")
    assert [(r["direction"], r["partner"]) for r in got] == [("export", 4)]


def test_year_axes(flows, as_rows):
    df = flows([(2020, 50, 1, 1, 5, 1), (2021, 1, 50, 1, 6, 1), (2022, 50, 1, 1, 7, 1), (2022, 1, 50, 1, 8, 1)])
    years = lambda how: [r["t"] for r in as_rows(totals.yearly(df, 50, how), "t")]
    assert years("export") == [2020, 2022] and years("union") == [2020, 2021, 2022] and years("both") == [2022]
    assert [r["balance"] for r in as_rows(totals.yearly_trends(df, 50), "t")] == [5.0, -1.0]


def test_summary_of_a_reporter_without_imports(flows, countries, as_rows):
    df = flows([(2020, 50, 1, 1, 5, 1), (2020, 50, 2, 2, 5, 1)])
    (got,) = as_rows(totals.summary_report(df, countries([(1, "B", "B"), (2, "A", "A")]), 50))
    # Equal sums: the first name leads.
    assert got["top_export_partner"] == "A" and got["top_import_partner"] is None
    assert got["coverage_pct"] is None and got["import_products"] == 0


def test_missing_values_sum_to_zero(flows, as_rows):
    df = flows([(2020, 50, 1, 1, None, 1)])
    (got,) = as_rows(totals.trade_direction(df, 50))
    assert (got["export_records"], got["export_value"]) == (1, 0.0)


def test_concentration_edges(flows, as_rows):
    even = flows([(2020, 50, j, 10100, 10, 1) for j in (1, 2, 3, 4)])
    got = {r["dimension"]: r for r in as_rows(concentration.concentration(even, 50))}
    assert got["country"]["hhi"] == 0.25 and abs(got["country"]["gini"]) < 1e-12
    assert got["product"]["hhi"] == 1.0
    one_sided = flows([(2020, 50, j, 10100, v, 1) for j, v in ((1, 0), (2, 0), (3, 0), (4, 1))])
    got = {r["dimension"]: r for r in as_rows(concentration.concentration(one_sided, 50))}
    assert got["country"]["gini"] == 0.75 and got["country"]["band"] == "high"


def test_scale_invariance(flows, as_rows):
    r = random.Random(1)
    base = [(2000 + r.randrange(5), r.randrange(5), r.randrange(5), r.randrange(10000, 990000), r.random() * 100, 1) for _ in range(300)]
    a = concentration.concentration(flows(base))
    b = concentration.concentration(flows([(*x[:4], x[4] * 1000, x[5]) for x in base]))
    keys = ("direction", "reporter", "dimension")
    for x, y in zip(as_rows(a, *keys), as_rows(b, *keys)):
        assert math.isclose(x["hhi"], y["hhi"]) and math.isclose(x["gini"], y["gini"], abs_tol=1e-9)
        assert 1 / x["groups"] - 1e-9 <= x["hhi"] <= 1 and -1e-9 <= x["gini"] < 1


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [5.0] * 50,
        [1.0, 2.0],
        [-4.0, -3.5, 0.0, 0.0, 2.25, 1e9],
        [float(i) for i in range(2000)],
        # One octave holds nearly everything, in tiny steps.
        [1000 + i * 1e-6 for i in range(5000)] + [1e-9, 1e12],
        [random.Random(3).lognormvariate(3, 4) for _ in range(3000)],
    ],
)
def test_exact_quantiles_against_sorting(spark, values, as_rows):
    probabilities = (0.0, 0.25, 0.5, 0.9, 1.0)
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "g string, x double")
    got = {r["g"]: r["quantiles"] for r in as_rows(exact_quantiles(df, ["g"], "x", probabilities))}
    ordered = sorted(values)
    for p, q in zip(probabilities, got["a"]):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert math.isclose(q, low + (high - low) * (at - math.floor(at)), rel_tol=1e-12, abs_tol=1e-12)
    assert got["b"] == [7.0] * 5


def test_distribution_in_usd(flows, as_rows):
    values = [1.0, 2.0, 4.0, 8.0, 100.0]
    (got,) = as_rows(distribution.value_distribution(flows([(2020, 50, 1, 1, v, 1) for v in values] + [(2020, 50, 1, 1, None, 1)]), 50, 1000))
    assert got["records"] == 5 and got["p50"] == 4000.0 and got["mean"] == 23000.0
    assert math.isclose(got["std"], statistics.stdev(values) * 1000)


@pytest.mark.parametrize("direction", ["export", "import"])
def test_published_normality(spark, direction):
    from portolan.functions.numeric import jarque_bera

    n, skew, kurt, expected = golden.NORMALITY[direction]
    df = spark.createDataFrame([(n, skew, kurt)], "n bigint, s double, k double")
    assert math.isclose(df.select(jarque_bera(F.col("n"), F.col("s"), F.col("k"))).first()[0], expected, rel_tol=1e-9)


def test_correlation_uses_complete_pairs(flows, as_rows):
    df = flows([(2020, 50, 1, 10100, 1, 2), (2020, 50, 1, 10100, 2, 4), (2020, 50, 1, 10100, 3, 6), (2020, 50, 1, 10100, 50, None)])
    got = {(r["x"], r["y"]): r["r"] for r in as_rows(distribution.correlations(df, 50))}
    assert len(got) == 16 and math.isclose(got["v", "q"], 1.0) and got["v", "q"] == got["q", "v"]
    assert got["hs2", "v"] is None and math.isclose(got["v", "v"], 1.0)


def yearly_flows(flows):
    out = []
    for t, e, m in golden.YEARLY:
        out += [(t, 50, 842, 610910, e, 1), (t, 842, 50, 520100, m, 1)]
    return flows(out)


def test_published_balance_and_openness(flows, as_rows):
    for r in as_rows(timeseries.balance_openness(yearly_flows(flows), 50)):
        balance, openness = golden.BALANCE_OPENNESS[r["t"]]
        assert math.isclose(r["trade_balance"], balance, rel_tol=1e-9)
        assert math.isclose(r["trade_openness"], openness, rel_tol=1e-9)


def test_growth_of_the_published_series(flows, as_rows):
    df = yearly_flows(flows)
    for r in as_rows(timeseries.growth_stats(df, 50)):
        got = (r["n"], r["mean"], r["std"], r["ci_low"], r["ci_high"])
        assert got == pytest.approx(golden.GROWTH[r["direction"]], abs=1e-6)
    first = [r for r in as_rows(timeseries.growth(df, 50), "t") if r["t"] == 1995]
    assert [r["growth_pct"] for r in first] == [None, None]


def test_trend_of_the_published_series(flows, as_rows):
    for r in as_rows(timeseries.trend(yearly_flows(flows), 50)):
        slope, intercept, low, high = golden.TREND[r["direction"]]
        assert r["slope"] == pytest.approx(slope, abs=1e-3) and r["intercept"] == pytest.approx(intercept, abs=1)
        assert (r["slope_low"], r["slope_high"]) == pytest.approx((low, high), abs=1e-3)


def test_trend_and_growth_of_short_series(flows, as_rows):
    one = flows([(2020, 50, 1, 1, 5, 1), (2020, 1, 50, 1, 5, 1)])
    assert as_rows(timeseries.trend(one, 50)) == []
    assert all(r["n"] == 0 and r["mean"] is None for r in as_rows(timeseries.growth_stats(one, 50)))
    two = flows([(t, 50, 1, 1, v, 1) for t, v in ((2020, 5), (2023, 11))])
    (got,) = as_rows(timeseries.trend(two, 50, "own"))
    assert got["slope"] == 2.0
    (stats,) = as_rows(timeseries.growth_stats(two, 50, "own"))
    assert stats["n"] == 1 and stats["std"] is None


def test_growth_compares_listed_years_and_survives_zero(flows, as_rows):
    df = flows([(2018, 50, 1, 1, 0, 1), (2020, 50, 1, 1, 4, 1), (2023, 50, 1, 1, 6, 1)])
    assert [r["growth_pct"] for r in as_rows(timeseries.growth(df, 50, "own"), "t")] == [None, None, 50.0]


def inside_t(t, df, steps=20_000):
    """Probability between -t and t by Simpson's rule over the angle of the distribution."""
    peak = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    end = math.atan(t / math.sqrt(df))
    y = np.cos(np.linspace(0, end, steps + 1)) ** (df - 1)
    return 2 * peak * end / steps / 3 * (y[0] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum() + y[-1])


def test_t_points_at_any_degrees_of_freedom(spark):
    degrees = [*range(1, 34), 40, 119, 120, 1000, 2501]
    df = spark.createDataFrame([(d,) for d in [*degrees, 0, -3]], "d long")
    got = [r[0] for r in df.select(timeseries.t_critical(F.col("d"))).collect()]
    assert got[len(degrees):] == [None, None]
    assert got[:30] == pytest.approx(catalog.T_95, abs=1e-8)
    assert [inside_t(t, d) for t, d in zip(got, degrees)] == pytest.approx([0.95] * len(degrees), abs=1e-11)
    assert [got[degrees.index(d)] for d in (31, 40, 120)] == pytest.approx([2.0395134464, 2.0210753903, 1.9799304051], abs=1e-8)


@pytest.mark.parametrize("n, block", [(2500, 256), (7, 2), (2, 256)])
def test_trend_of_a_long_series(spark, as_rows, monkeypatch, n, block):
    monkeypatch.setattr(timeseries, "BLOCK", block)
    r = np.random.default_rng(n)
    t, v = np.arange(n) * 2 - 700, np.round(np.arange(n) * 0.3 + r.normal(size=n) * 40, 1)
    rows = [("export", 7, int(a), float(b)) for a, b in zip(t, v)] + [("import", 7, 1, 5.0), ("import", 8, 1, 5.0), ("import", 8, 3, 4.0), ("import", 9, 3, None)]
    got = {(x["direction"], x["reporter"]): x for x in as_rows(timeseries.trend_of(spark.createDataFrame(rows, "direction string, reporter int, t int, v double")))}
    assert set(got) == {("export", 7), ("import", 8)}
    i, j = np.triu_indices(n, 1)
    slopes = np.sort((v[j] - v[i]) / (t[j] - t[i]))
    c = np.unique(v, return_counts=True)[1].astype(float)
    sigma = math.sqrt((n * (n - 1.0) * (2 * n + 5) - (c * (c - 1) * (2 * c + 5)).sum()) / 18)
    low, high = (max(round((len(slopes) - 1.959963984540054 * sigma) / 2) - 1, 0), min(round((len(slopes) + 1.959963984540054 * sigma) / 2), len(slopes) - 1))
    mine = got["export", 7]
    assert (mine["n"], mine["slope"], mine["slope_low"], mine["slope_high"]) == pytest.approx((n, np.median(slopes), slopes[low], slopes[high]))
    assert mine["intercept"] == pytest.approx(np.median(v) - np.median(slopes) * np.median(t))


def test_places_without_one_task(spark):
    r = np.random.default_rng(1)
    values = [(int(k), float(x)) for k, x in enumerate(r.integers(0, 50, 997))]
    df = spark.createDataFrame(values, "k int, x double").repartition(13)
    found = ranks.ordered(df, [F.desc("x"), F.asc("k")])
    order = sorted(values, key=lambda p: (-p[1], p[0]))
    assert found.size == 997
    assert [(p["k"], p["place"]) for p in found.rows.orderBy("place").collect()] == [(k, i + 1) for i, (k, _) in enumerate(order)]
    odd = found.only(F.col("k") % 2 == 1)
    assert [(p["k"], p["place"]) for p in odd.rows.orderBy("place").collect()] == [(k, i + 1) for i, k in enumerate(k for k, _ in order if k % 2)]
    for o in (found, odd, odd.only(F.col("k") < 9), odd.only(F.col("k") < 4)):
        xs = [p["x"] for p in o.rows.collect()]
        assert df.select(o.median("x")).first()[0] == pytest.approx(float(np.median(xs)))
    empty = found.only(F.lit(False))
    assert empty.size == 0 and empty.rows.collect() == [] and df.select(empty.median("x")).first()[0] is None


def test_ranks_need_no_window_over_everything(spark, flows):
    r = random.Random(5)
    df = flows([(2020, r.randrange(6), r.randrange(6), r.randrange(10000, 10040), r.random() * 100, 1) for _ in range(200)])
    for found in (
        complexity.product_opportunities(df), complexity.product_opportunities(df, focal=3), complexity.opportunity_counts(df),
        complexity.economic_complexity(df), complexity.economic_complexity(df, 3),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        # a window whose first column is its order, unless every task only sends its first n rows
        assert not re.search(r"windowspecdefinition\(\S+ (ASC|DESC)", plan) or "TakeOrderedAndProject" in plan


def test_lifecycle_forms(flows, as_rows):
    df = flows([(2020, 50, 1, 30420, 5, 1), (2021, 50, 1, 610910, 6, 1)])
    assert {(r["t"], r["hs2"]): r["value_usd"] for r in as_rows(timeseries.product_lifecycle(df, 50))} == {(2020, "30"): 5000.0, (2021, "61"): 6000.0}
    wide = as_rows(timeseries.product_lifecycle_wide(df, ["30", "61"], 50), "t")
    assert [(r["30"], r["61"]) for r in wide] == [(5000.0, 0.0), (0.0, 6000.0)]


def test_share_of_latest_year(flows, as_rows):
    df = flows([(2020, 50, 1, 10000, 99, 1), (2021, 50, 1, 20000, 1, 1), (2021, 50, 1, 30000, 3, 1)])
    assert [(r["hs2"], r["export_share"]) for r in as_rows(timeseries.export_share_latest(df, focal=50), "rank")] == [(3, 0.75), (2, 0.25)]


def test_intensity_orders(flows, as_rows):
    df = flows([(2020, 50, j, k, v, 1) for j, k, v in ((1, 10000, 1.005), (2, 20000, 9), (3, 20000, 8))])
    assert [r["hs2"] for r in as_rows(goods.trade_intensity(df, 1, 50))] == [1]
    (got,) = as_rows(goods.trade_intensity(df, 1, 50, order="value"))
    assert (got["hs2"], got["value_sum"], got["value_count"], got["value_mean"], got["partners"]) == (2, 17.0, 2, 8.5, 2)


def test_emerging_partners(flows, countries, as_rows):
    df = flows(
        [
            (2020, 50, 1, 1, 1000, 1), (2023, 50, 1, 1, 1300, 1),  # +30 %
            (2020, 50, 2, 1, 1000, 1), (2023, 50, 2, 1, 1200, 1),  # exactly +20 %: out
            (2021, 50, 3, 1, 9000, 1),  # one year only: out
            (2020, 50, 4, 1, 0, 1), (2023, 50, 4, 1, 5000, 1),  # growth from zero: out
            (2020, 50, 5, 1, 1, 1), (2023, 50, 5, 1, 9, 1),  # too small: out
            (2019, 50, 1, 1, 9999, 1),  # outside the years
        ]
    )
    (got,) = as_rows(partners.emerging_partners(df, countries([(2, "B", "B")]), focal=50))
    assert got["partner_name"] == "Country_1" and got["growth_rate"] == pytest.approx(30)
    assert got["total_value_usd"] == 2_300_000 and got["years_active"] == 2


def test_partner_balance_keeps_one_sided_partners(flows, countries, as_rows):
    df = flows([(2020, 50, 1, 1, 5, 1), (2020, 2, 50, 1, 7, 1), (2020, 3, 50, 1, 99, 1)])
    names = countries([(1, "A", "A"), (2, "B", "B")])
    got = as_rows(partners.balance_by_partner(df, names, focal=50), "rank")
    assert [(r["partner"], r["exports"], r["imports"]) for r in got] == [(2, 0.0, 7.0), (1, 5.0, 0.0)]
    (ends,) = as_rows(partners.balance_extremes(df, names, focal=50))
    assert (ends["surplus_partners"], ends["deficit_partners"]) == (1, 1)
    assert (ends["largest_surplus_partner"], ends["largest_deficit_usd"]) == ("A", 7000.0)


def test_complexity_and_penetration(flows, as_rows):
    df = flows([(2020, 50, 1, 7, 30, 1), (2020, 50, 1, 8, 10, 1), (2020, 60, 2, 7, 1, 1), (2021, 60, 50, 7, 1, 1)])
    (got,) = as_rows(complexity.export_complexity(df, 50))
    assert got["avg_export_complexity"] == pytest.approx((30 * 0.5 + 10 * 1) / 40) and got["records"] == 2
    reach = {r["product"]: r["penetration_rate"] for r in as_rows(complexity.market_penetration(df, 50))}
    assert reach == {7: pytest.approx(1 / 3), 8: 1.0}
    (eci,) = as_rows(complexity.economic_complexity(df, 50))
    assert (eci["diversity"], eci["mean_diversity"], eci["diversity_percentile"]) == (2, 1.5, 50.0)


def test_opportunities_one_reporter_and_all(flows, as_rows):
    r = random.Random(5)
    rows = []
    for k in range(1, 61):
        for i in r.sample(range(1, 9), r.randint(1, 6)):
            rows.append((2020, i, r.randint(1, 8), k, r.randint(1, 1000), 1))
    df = flows(rows)
    whole = as_rows(complexity.product_opportunities(df, 3), "reporter", "rank")
    counts = {x["reporter"]: x for x in as_rows(complexity.opportunity_counts(df, 3))}
    assert whole
    for focal in range(1, 9):
        alone = as_rows(complexity.product_opportunities(df, 3, focal), "rank")
        assert alone == [x for x in whole if x["reporter"] == focal]
        (c,) = as_rows(complexity.opportunity_counts(df, 3, focal))
        assert c == counts[focal] and c["opportunity_count"] == len(alone) <= c["uncut_count"]
        mine = {x[3] for x in rows if x[1] == focal}
        assert not mine & {x["product"] for x in alone}


def test_competition(flows, as_rows):
    df = flows([(2020, i, 99, 7, v, 1) for i, v in ((50, 10), (1, 40), (2, 30), (3, 20))] + [(2020, 4, 99, 8, 5, 1)])
    (got,) = as_rows(competition.competitive_position(df, rivals=2, focal=50))
    assert got["market_share"] == 0.1 and [x["exporter"] for x in got["rivals"]] == [1, 2]
    (rank,) = as_rows(competition.competitive_rank(df, focal=50))
    assert (rank["exporter_rank"], rank["leader_value"], rank["field_share"]) == (4, 40.0, 0.1)
    # Outside the field the product is left out, inside it the share is of the field only.
    assert as_rows(competition.competitive_rank(df, field=3, focal=50)) == []
    (first,) = as_rows(competition.competitive_rank(df, field=2, focal=1))
    assert first["field_share"] == pytest.approx(40 / 70)


def test_flow_graph_ids(flows, countries, as_rows):
    df = flows([(2020, 50, 1, 10000, 5, 1), (2020, 50, 2, 10000, 9, 1), (2020, 50, 1, 20000, 7, 1)])
    names = countries([(1, "A", "A"), (2, "B", "B"), (50, "Home", "HOM")])
    nodes = [r["label"] for r in as_rows(flowgraph.flow_nodes(df, names, focal=50), "node_id")]
    assert nodes == ["Home", "HS1", "HS2", "B", "A"]
    links = as_rows(flowgraph.flow_links(df, names, focal=50), "rank", "hop")
    assert [(r["source"], r["target"], r["value"]) for r in links] == [
        (0, 1, 9.0), (1, 3, 9.0), (0, 2, 7.0), (2, 4, 7.0), (0, 1, 5.0), (1, 4, 5.0),
    ]


def test_product_market_pivot(flows, countries, products, as_rows):
    df = flows([(2020, 50, 1, 10100, 5, 1), (2020, 50, 2, 20200, 9, 1), (2020, 51, 2, 20200, 7, 1)])
    matrix = goods.product_market_matrix(df, countries([(1, "A", "A"), (2, "B", "B")]), products([("010100", "x"), ("020200", "y")]))
    wide = as_rows(goods.product_market_pivot(matrix, [1, 2, 3]), "reporter", "product")
    assert [(r["reporter"], r["product"], r["1"], r["2"], r["3"]) for r in wide] == [(50, 10100, 5000.0, 0.0, 0.0), (50, 20200, 0.0, 9000.0, 0.0), (51, 20200, 0.0, 7000.0, 0.0)]


def test_histogram_covers_everything(spark, as_rows):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 10, 10)] + [(None,)], "x double")
    got = as_rows(distribution.histogram(df, "x", 5), "bin")
    assert sum(r["n"] for r in got) == 6 and got[-1]["bin"] == 4 and got[-1]["n"] == 2
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["n"] for r in as_rows(distribution.histogram(flat, "x", 5))] == [2]


def test_moments_from_buckets(spark, as_rows):
    """Moments of groups whose values lie far from zero, spread over signs, or are all one value."""
    r = np.random.default_rng(8)
    groups = {1: r.lognormal(3, 2, 4000), 2: r.normal(0, 1, 500), 3: 1e9 + r.normal(size=300), 4: np.full(7, 3.5), 5: np.array([2.0]), 6: np.array([-1.0, 1.0, 0.0, 0.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [(1, None), (7, None)], "g int, x double").repartition(9)
    got = {m["g"]: m for m in as_rows(quantiles.moments(quantiles.summaries(df, ["g"], "x"), ["g"]))}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        d = xs - xs.mean()
        m2, m3, m4 = ((d**p).mean() for p in (2, 3, 4))
        assert (got[g]["records"], got[g]["min"], got[g]["max"]) == (len(xs), xs.min(), xs.max())
        assert got[g]["mean"] == pytest.approx(xs.mean(), rel=1e-12)
        assert got[g]["std"] == (pytest.approx(xs.std(ddof=1), rel=1e-6) if len(xs) > 1 else None)
        assert got[g]["skewness"] == (pytest.approx(m3 / m2**1.5, rel=1e-5, abs=1e-6) if m2 else None)
        assert got[g]["kurtosis"] == (pytest.approx(m4 / m2**2 - 3, rel=1e-5, abs=1e-6) if m2 else None)


def test_quantiles_read_values_twice(spark, flows, tmp_path):
    """Once for the buckets and once for the located ones; what follows reads written tables."""
    path = str(tmp_path / "flows")
    flows([(2020, i % 5, i % 7, 10000 + i, i * 1.5, 1) for i in range(300)]).write.parquet(path)
    df = spark.read.parquet(path)
    plan = distribution.value_distribution(df)._jdf.queryExecution().executedPlan().toString()
    assert path not in plan


@pytest.mark.parametrize("focal", [None, 3])
def test_one_value_may_hold_most_rows(spark, as_rows, focal):
    df = spark.createDataFrame([(2020, 3, 1, 10000, v, 1.0) for v in [5.0] * 5000 + [1.0, 2.0, 9.0]], "t int, i int, j int, k int, v double, q double")
    row = next(r for r in as_rows(distribution.value_distribution(df, focal)) if r["direction"] == "export")
    assert (row["records"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (5003, 1.0, 5.0, 5.0, 5.0, 9.0)
