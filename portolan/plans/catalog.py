"""The registered queries: each analysis over the star tables with its SQL twin.

Every entry runs over the whole tables.  Entries marked for both scopes are
registered twice: under their name for the focal reporter and with the suffix
``_all_reporters`` for every reporter in one job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.operators import (
    charts,
    competition,
    complexity,
    concentration,
    distribution,
    features,
    flowgraph,
    partners,
    products,
    quality,
    segments,
    timeseries,
    totals,
)
from portolan.plans import reports
from portolan.plans.session import shared_folder
from portolan.plans.shape import shaped, shaped_sql
from portolan.sources import readers, star
from portolan.sources.readers import TradeData

FOCAL = 18
YEARS = (1997, 1998, 1999, 2000)
# Every two-digit code, so that no chapter is left out.
CHAPTERS = tuple(range(100))
# Left out of the dimension by the two queries about codes without a name.
UNLISTED = 24

Build = Callable[[TradeData, "int | None"], DataFrame]


class Query(NamedTuple):
    build: Build
    shape: str
    sql: str | None = None
    both: bool = True


FLOWS_SQL = """flows AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS t, s_nationkey AS i, c_nationkey AS j,
         CAST(substr(p_brand, 7) AS INTEGER) * 10000 + p_size * 100
           + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                         WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS k,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS v,
         CASE WHEN l_tax = 0.0 THEN NULL WHEN l_tax = 0.01 THEN 0.0 ELSE l_quantity END AS q
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
)"""

DIMENSIONS_SQL = """countries AS (
  SELECT n_nationkey AS country_code, n_name AS country_name,
         'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country_iso3
  FROM nation
),
products AS (
  SELECT DISTINCT
         lpad(CAST(CAST(substr(p_brand, 7) AS INTEGER) * 10000 + p_size * 100
           + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                         WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS VARCHAR), 6, '0') AS code,
         p_brand || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) AS description
  FROM part
)"""


def _ctes(focal: int | None) -> str:
    where = "" if focal is None else f"WHERE reporter = {focal}"
    return f"""{FLOWS_SQL},
{DIMENSIONS_SQL},
every AS (
  SELECT 'export' AS direction, i AS reporter, j AS partner, t, k, v, q FROM flows
  UNION ALL
  SELECT 'import' AS direction, j AS reporter, i AS partner, t, k, v, q FROM flows
),
d AS (
  SELECT *, CAST(substr(lpad(CAST(k AS VARCHAR), 6, '0'), 1, 2) AS INTEGER) AS hs2,
         substr(CAST(k AS VARCHAR), 1, 2) AS hs2_raw, lpad(CAST(k AS VARCHAR), 6, '0') AS hs6,
         CASE WHEN q > 0 THEN CAST(v AS DOUBLE) / q END AS unit_value
  FROM every {where}
),
x AS (SELECT * FROM d WHERE direction = 'export'),
both_years AS (
  SELECT reporter, t,
         CAST(sum(CASE WHEN direction = 'export' THEN v ELSE 0 END) AS DOUBLE) AS exports,
         CAST(sum(CASE WHEN direction = 'import' THEN v ELSE 0 END) AS DOUBLE) AS imports
  FROM d GROUP BY reporter, t HAVING count(DISTINCT direction) = 2
),
series AS (
  SELECT reporter, 'export' AS direction, t, exports AS v FROM both_years
  UNION ALL
  SELECT reporter, 'import' AS direction, t, imports AS v FROM both_years
),
growth AS (
  SELECT direction, reporter, t, v,
         (v / lag(v) OVER (PARTITION BY direction, reporter ORDER BY t) - 1) * 100 AS growth_pct
  FROM series
)"""


def _ranked(inner: str, by: str, order: str, n: int, rank: str = "rank") -> str:
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS {rank} FROM ({inner}) s
) r WHERE {rank} <= {n}"""


SIDE = "direction, reporter"

TOP_PARTNERS = """SELECT direction, reporter, partner, country_name AS partner_name, CAST(sum(v) AS DOUBLE) AS value
FROM d JOIN countries ON partner = country_code GROUP BY ALL"""

TOP_PRODUCTS = """SELECT direction, reporter, k AS product, description, CAST(sum(v) AS DOUBLE) AS value
FROM d JOIN products ON hs6 = code GROUP BY ALL"""

PARTNER_PROFILE = _ranked(
    """SELECT direction, reporter, partner, country_name AS partner_name, CAST(sum(v) AS DOUBLE) AS total_value,
  count(DISTINCT k) AS product_count, min(t) AS first_year, max(t) AS last_year,
  CAST(sum(v) AS DOUBLE) * 1000 AS total_value_usd, max(t) - min(t) + 1 AS trade_duration
FROM d JOIN countries ON partner = country_code GROUP BY direction, reporter, partner, country_name""",
    SIDE, "total_value DESC, partner", 20,
)

PRODUCT_PROFILE = _ranked(
    """SELECT direction, reporter, k AS product, description, CAST(sum(v) AS DOUBLE) AS total_value,
  count(DISTINCT partner) AS partner_count, min(t) AS first_year, max(t) AS last_year,
  CAST(sum(v) AS DOUBLE) * 1000 AS total_value_usd, max(t) - min(t) + 1 AS year_span
FROM d JOIN products ON hs6 = code GROUP BY direction, reporter, k, description""",
    SIDE, "total_value DESC, product", 25,
)

EMERGING = _ranked(
    f"""SELECT direction, reporter, partner, coalesce(country_name, 'Country_' || CAST(partner AS VARCHAR)) AS partner_name,
  (last_value - first_value) / first_value * 100 AS growth_rate, value * 1000 AS total_value_usd, years_active
FROM (
  SELECT direction, reporter, partner, count(*) AS years_active, CAST(sum(v) AS DOUBLE) AS value,
         CAST(max(CASE WHEN up = 1 THEN v END) AS DOUBLE) AS first_value,
         CAST(max(CASE WHEN down = 1 THEN v END) AS DOUBLE) AS last_value
  FROM (
    SELECT *, row_number() OVER (PARTITION BY direction, reporter, partner ORDER BY t) AS up,
           row_number() OVER (PARTITION BY direction, reporter, partner ORDER BY t DESC) AS down
    FROM (SELECT direction, reporter, partner, t, sum(v) AS v FROM d
          WHERE t IN {YEARS} GROUP BY ALL) y
  ) o GROUP BY direction, reporter, partner HAVING count(*) >= 2
) g LEFT JOIN countries ON partner = country_code
WHERE (last_value - first_value) / first_value * 100 > 20 AND value * 1000 > 1000000""",
    SIDE, "growth_rate DESC, partner", 15,
)

BALANCE = _ranked(
    """SELECT *, exports * 1000 AS exports_usd, imports * 1000 AS imports_usd,
  exports * 1000 - imports * 1000 AS trade_balance, exports * 1000 + imports * 1000 AS total_trade
FROM (
  SELECT coalesce(e.reporter, m.reporter) AS reporter, coalesce(e.partner, m.partner) AS partner,
         coalesce(e.partner_name, m.partner_name) AS partner_name,
         coalesce(e.value, 0) AS exports, coalesce(m.value, 0) AS imports
  FROM (SELECT * FROM named WHERE direction = 'export') e
  FULL OUTER JOIN (SELECT * FROM named WHERE direction = 'import') m
    ON e.reporter = m.reporter AND e.partner = m.partner AND e.partner_name = m.partner_name
) b""".replace("named", f"({TOP_PARTNERS}) named"),
    "reporter", "total_trade DESC, partner", 30,
)

BALANCE_EXTREMES = f"""SELECT reporter, count(*) FILTER (WHERE trade_balance > 0) AS surplus_partners,
  count(*) FILTER (WHERE trade_balance < 0) AS deficit_partners,
  max(CASE WHEN up = 1 THEN partner_name END) AS largest_surplus_partner, max(trade_balance) AS largest_surplus_usd,
  max(CASE WHEN down = 1 THEN partner_name END) AS largest_deficit_partner, abs(min(trade_balance)) AS largest_deficit_usd
FROM (SELECT *, row_number() OVER (PARTITION BY reporter ORDER BY trade_balance DESC, rank) AS up,
             row_number() OVER (PARTITION BY reporter ORDER BY trade_balance, rank) AS down FROM ({BALANCE}) b) o
GROUP BY reporter"""

DIMENSION_VALUES = """SELECT direction, reporter, 'country' AS dimension, CAST(partner AS VARCHAR) AS code, CAST(sum(v) AS DOUBLE) AS value
FROM d GROUP BY ALL
UNION ALL
SELECT direction, reporter, 'product' AS dimension, CAST(hs2 AS VARCHAR) AS code, CAST(sum(v) AS DOUBLE) AS value
FROM d GROUP BY ALL"""

CONCENTRATION = f"""SELECT direction, reporter, dimension, n AS groups, hhi, gini,
  CASE WHEN hhi > 0.25 THEN 'high' WHEN hhi > 0.15 THEN 'moderate' ELSE 'low' END AS band
FROM (
  SELECT direction, reporter, dimension, count(*) AS n, sum(share * share) AS hhi,
         (count(*) + 1 - 2 * sum(running) / max(running)) / count(*) AS gini
  FROM (
    SELECT *, value / sum(value) OVER (PARTITION BY direction, reporter, dimension) AS share,
           sum(value) OVER (PARTITION BY direction, reporter, dimension ORDER BY value, code
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
    FROM ({DIMENSION_VALUES}) s
  ) w GROUP BY direction, reporter, dimension
) c"""

DISTRIBUTION = """SELECT *, exp(-jarque_bera / 2) AS jarque_bera_p FROM (
  SELECT *, records / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4) AS jarque_bera FROM (
    SELECT direction, reporter, count(*) AS records, max(mu) AS mean, stddev_samp(y) AS std, min(y) AS min,
           quantile_cont(y, 0.25) AS p25, quantile_cont(y, 0.5) AS p50, quantile_cont(y, 0.75) AS p75, max(y) AS max,
           avg(power(y - mu, 3)) / power(avg(power(y - mu, 2)), 1.5) AS skewness,
           avg(power(y - mu, 4)) / power(avg(power(y - mu, 2)), 2) - 3 AS kurtosis
    FROM (SELECT direction, reporter, y, avg(y) OVER (PARTITION BY direction, reporter) AS mu
          FROM (SELECT direction, reporter, CAST(v AS DOUBLE) AS y FROM d) a) b
    GROUP BY direction, reporter
  ) m
) j"""


def _correlations_sql() -> str:
    columns = {"v": "CAST(v AS DOUBLE)", "q": "q", "unit_value": "unit_value", "hs2": "CAST(hs2 AS DOUBLE)"}
    parts = [
        f"SELECT direction, reporter, '{a}' AS x, '{b}' AS y, corr({ea}, {eb}) AS r FROM d GROUP BY direction, reporter"
        for a, ea in columns.items()
        for b, eb in columns.items()
    ]
    return "\nUNION ALL\n".join(parts)


# Fixed values of the SQL twins: two-sided 95 % points of Student's t for 1 to 30 degrees of freedom, and of the normal.
T_95 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851,
    2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830,
    2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040,
    2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.068657610, 2.063898562,
    2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
)
Z_95 = 1.959963984540054


def _t_table_sql() -> str:
    return "CASE n - 1 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(T_95, 1)) + " END"


GROWTH_STATS = f"""SELECT direction, reporter, n, mean, std,
  mean - ({_t_table_sql()}) * std / sqrt(n) AS ci_low, mean + ({_t_table_sql()}) * std / sqrt(n) AS ci_high
FROM (SELECT direction, reporter, count(growth_pct) AS n, avg(growth_pct) AS mean, stddev_samp(growth_pct) AS std
      FROM growth GROUP BY direction, reporter) g"""

TREND = f"""SELECT p.direction, p.reporter, p.n, s.slope, p.mid_v - s.slope * p.mid_t AS intercept, lo.slope AS slope_low, hi.slope AS slope_high
FROM (
  SELECT direction, reporter, count(*) AS n, quantile_cont(v, 0.5) AS mid_v, quantile_cont(CAST(t AS DOUBLE), 0.5) AS mid_t
  FROM series GROUP BY direction, reporter
) p
JOIN (
  SELECT direction, reporter, quantile_cont(slope, 0.5) AS slope, count(*) AS pairs FROM slopes GROUP BY direction, reporter
) s ON p.direction = s.direction AND p.reporter = s.reporter
JOIN (SELECT direction, reporter, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (
  SELECT direction, reporter, v, CAST(count(*) AS DOUBLE) AS c FROM series GROUP BY direction, reporter, v) e
  GROUP BY direction, reporter) k ON p.direction = k.direction AND p.reporter = k.reporter
JOIN numbered lo ON p.direction = lo.direction AND p.reporter = lo.reporter AND lo.at =
  greatest(round_even((pairs - {Z_95} * sqrt((n * (n - 1.0) * (2 * n + 5) - ties) / 18)) / 2, 0) - 1, 0)
JOIN numbered hi ON p.direction = hi.direction AND p.reporter = hi.reporter AND hi.at =
  least(round_even((pairs + {Z_95} * sqrt((n * (n - 1.0) * (2 * n + 5) - ties) / 18)) / 2, 0), pairs - 1)""".replace(
    "numbered", "(SELECT *, row_number() OVER (PARTITION BY direction, reporter ORDER BY slope) - 1 AS at FROM slopes)"
).replace(
    "slopes",
    "(SELECT a.direction, a.reporter, (b.v - a.v) / (b.t - a.t) AS slope FROM series a JOIN series b "
    "ON a.direction = b.direction AND a.reporter = b.reporter AND a.t < b.t) slopes",
)

UBIQUITY = "SELECT k AS product, count(DISTINCT i) AS ubiquity, 1.0 / count(DISTINCT i) AS complexity_score FROM flows GROUP BY k"

PRODUCT_METRICS = """SELECT k AS product, CAST(sum(v) AS DOUBLE) AS global_value, count(DISTINCT i) AS num_exporters,
  count(DISTINCT j) AS num_importers, 1.0 / count(DISTINCT i) AS complexity FROM flows GROUP BY k"""

OPEN_PRODUCTS = f"""SELECT r.reporter, c.* FROM (SELECT DISTINCT reporter FROM x) r
CROSS JOIN (
  SELECT * FROM ({PRODUCT_METRICS}) m
  WHERE complexity > (SELECT quantile_cont(complexity, 0.5) FROM ({PRODUCT_METRICS}) a)
    AND global_value > (SELECT quantile_cont(global_value, 0.5) FROM ({PRODUCT_METRICS}) b)
) c
WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.reporter = r.reporter AND x.k = c.product)"""

LEADING_PRODUCTS = _ranked(
    "SELECT reporter, k, CAST(sum(v) AS DOUBLE) AS own FROM x GROUP BY reporter, k", "reporter", "own DESC, k", 20, "place"
)

EXPORTERS = "SELECT k, i, CAST(sum(v) AS DOUBLE) AS v FROM flows GROUP BY k, i"

PORTFOLIO = """SELECT reporter, hs2, value, market_reach, products, market_share, median_reach, median_share,
  CASE WHEN market_reach > median_reach AND market_share > median_share THEN 'Stars'
       WHEN market_share > median_share THEN 'Cash Cows'
       WHEN market_reach > median_reach THEN 'Question Marks' ELSE 'Dogs' END AS quadrant
FROM (
  SELECT *, quantile_cont(market_reach, 0.5) OVER (PARTITION BY reporter) AS median_reach,
         quantile_cont(market_share, 0.5) OVER (PARTITION BY reporter) AS median_share
  FROM (
    SELECT *, value / sum(value) OVER (PARTITION BY reporter) AS market_share
    FROM (SELECT reporter, hs2, CAST(sum(v) AS DOUBLE) AS value, count(DISTINCT partner) AS market_reach,
                 count(DISTINCT k) AS products FROM x GROUP BY reporter, hs2) a
  ) b
) c"""

LEADING_FLOWS = _ranked(
    """SELECT reporter, hs2, partner, country_name AS partner_name, CAST(sum(v) AS DOUBLE) AS value
FROM x JOIN countries ON partner = country_code GROUP BY reporter, hs2, partner, country_name""",
    "reporter", "value DESC, hs2, partner", 50,
)

NODES = f"""SELECT reporter, row_number() OVER (PARTITION BY reporter ORDER BY layer, first_rank) - 1 AS node_id, layer, label
FROM (
  SELECT DISTINCT reporter, 0 AS layer, coalesce(country_name, 'Country_' || CAST(reporter AS VARCHAR)) AS label, 0 AS first_rank
  FROM x LEFT JOIN countries ON reporter = country_code
  UNION ALL
  SELECT reporter, 1, 'HS' || CAST(hs2 AS VARCHAR), min(rank) FROM ({LEADING_FLOWS}) a GROUP BY reporter, hs2
  UNION ALL
  SELECT reporter, 2, partner_name, min(rank) FROM ({LEADING_FLOWS}) b GROUP BY reporter, partner_name
) n"""

LINKS = f"""SELECT f.reporter, f.rank, h.hop, CASE WHEN h.hop = 1 THEN 0 ELSE c.node_id END AS source,
  CASE WHEN h.hop = 1 THEN c.node_id ELSE p.node_id END AS target, f.value
FROM ({LEADING_FLOWS}) f
JOIN ({NODES}) c ON c.reporter = f.reporter AND c.layer = 1 AND c.label = 'HS' || CAST(f.hs2 AS VARCHAR)
JOIN ({NODES}) p ON p.reporter = f.reporter AND p.layer = 2 AND p.label = f.partner_name
CROSS JOIN (VALUES (1), (2)) h(hop)"""

KPIS = """SELECT reporter, CAST(sum(CASE WHEN direction = 'export' THEN v ELSE 0 END) AS DOUBLE) AS total_exports,
  CAST(sum(CASE WHEN direction = 'import' THEN v ELSE 0 END) AS DOUBLE) AS total_imports,
  CAST(sum(CASE WHEN direction = 'export' THEN v ELSE -v END) AS DOUBLE) AS trade_balance,
  count(DISTINCT CASE WHEN direction = 'export' THEN partner END) AS export_markets,
  count(DISTINCT CASE WHEN direction = 'export' THEN k END) AS export_products
FROM d GROUP BY reporter"""

BY_NAME = """SELECT direction, reporter, country_name AS partner_name, CAST(sum(v) AS DOUBLE) AS value
FROM d JOIN countries ON partner = country_code GROUP BY direction, reporter, country_name"""

SUMMARY_REPORT = f"""SELECT s.*, s.total_exports - s.total_imports AS balance,
  s.total_exports / nullif(s.total_imports, 0) * 100 AS coverage_pct,
  e.partner_name AS top_export_partner, m.partner_name AS top_import_partner
FROM (
  SELECT reporter, CAST(sum(CASE WHEN direction = 'export' THEN v ELSE 0 END) AS DOUBLE) AS total_exports,
    CAST(sum(CASE WHEN direction = 'import' THEN v ELSE 0 END) AS DOUBLE) AS total_imports,
    count(DISTINCT CASE WHEN direction = 'export' THEN k END) AS export_products,
    count(DISTINCT CASE WHEN direction = 'import' THEN k END) AS import_products,
    count(DISTINCT CASE WHEN direction = 'export' THEN partner END) AS export_countries,
    count(DISTINCT CASE WHEN direction = 'import' THEN partner END) AS import_countries
  FROM d GROUP BY reporter
) s
LEFT JOIN ({_ranked(BY_NAME, SIDE, 'value DESC, partner_name', 1)}) e ON e.reporter = s.reporter AND e.direction = 'export'
LEFT JOIN ({_ranked(BY_NAME, SIDE, 'value DESC, partner_name', 1)}) m ON m.reporter = s.reporter AND m.direction = 'import'"""

YEARLY = """SELECT reporter, t, CAST(sum(CASE WHEN direction = 'export' THEN v ELSE 0 END) AS DOUBLE) AS exports,
  CAST(sum(CASE WHEN direction = 'import' THEN v ELSE 0 END) AS DOUBLE) AS imports,
  CAST(sum(CASE WHEN direction = 'export' THEN v ELSE -v END) AS DOUBLE) AS balance
FROM d GROUP BY reporter, t"""


def _thousands_sql(x: str) -> str:
    return f"'$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def _lifecycle_wide_sql() -> str:
    cells = ", ".join(
        f"CAST(sum(CASE WHEN hs2 = {c} THEN v ELSE 0 END) AS DOUBLE) * 1000 AS c{c}" for c in CHAPTERS
    )
    return f"SELECT reporter, t, {cells} FROM x GROUP BY reporter, t"


def _lifecycle_wide(data: TradeData, focal: int | None) -> DataFrame:
    wide = timeseries.product_lifecycle_wide(data.flows, CHAPTERS, focal, "padded")
    return wide.select("reporter", "t", *[F.col(str(c)).alias(f"c{c}") for c in CHAPTERS])


def _doubled_countries(data: TradeData) -> DataFrame:
    """The country table with every fifth code listed twice."""
    return data.countries.unionByName(data.countries.filter(F.col("country_code") % 5 == 0))


def _partial_countries(data: TradeData) -> DataFrame:
    """The country table without one code, as published tables lack some."""
    return data.countries.filter(F.col("country_code") != UNLISTED)


PARTIAL_SQL = f"(SELECT * FROM countries WHERE country_code <> {UNLISTED})"


MARKETS = tuple(range(25))

MATRIX = f"""SELECT x.reporter, x.k AS product, description, x.partner, country_name AS partner_name, CAST(sum(x.v) AS DOUBLE) * 1000 AS value_usd
FROM x JOIN products ON hs6 = code JOIN countries ON x.partner = country_code
JOIN ({_ranked('SELECT reporter, k, sum(v) AS s FROM x GROUP BY reporter, k', 'reporter', 's DESC, k', 10)}) a
  ON a.reporter = x.reporter AND a.k = x.k
JOIN ({_ranked('SELECT reporter, partner, sum(v) AS s FROM x GROUP BY reporter, partner', 'reporter', 's DESC, partner', 15)}) b
  ON b.reporter = x.reporter AND b.partner = x.partner
GROUP BY x.reporter, x.k, description, x.partner, country_name"""


def _market_pivot(data: TradeData, focal: int | None) -> DataFrame:
    wide = products.product_market_pivot(products.product_market_matrix(data.flows, data.countries, data.products, focal=focal), MARKETS)
    return wide.select("reporter", "product", "description", *[F.col(str(m)).alias(f"m{m}") for m in MARKETS])


ANALYSES: dict[str, Query] = {
    "trade_direction": Query(
        lambda d, f: totals.trade_direction(d.flows, f),
        "reporter:int export_records:long import_records:long export_value:num4 import_value:num4 balance:num4",
        """SELECT reporter, count(*) FILTER (WHERE direction = 'export') AS export_records,
  count(*) FILTER (WHERE direction = 'import') AS import_records,
  CAST(sum(CASE WHEN direction = 'export' THEN v ELSE 0 END) AS DOUBLE) AS export_value,
  CAST(sum(CASE WHEN direction = 'import' THEN v ELSE 0 END) AS DOUBLE) AS import_value,
  CAST(sum(CASE WHEN direction = 'export' THEN v ELSE -v END) AS DOUBLE) AS balance
FROM d GROUP BY reporter""",
    ),
    "top_partners": Query(
        lambda d, f: partners.top_partners(d.flows, d.countries, 10, f),
        "direction:str reporter:int rank:int partner:int partner_name:str value:num4",
        _ranked(TOP_PARTNERS, SIDE, "value DESC, partner", 10),
    ),
    "top_products": Query(
        lambda d, f: products.top_products(d.flows, d.products, 10, f),
        "direction:str reporter:int rank:int product:int description:str value:num4",
        _ranked(TOP_PRODUCTS, SIDE, "value DESC, product", 10),
    ),
    "yearly_trends": Query(
        lambda d, f: totals.yearly_trends(d.flows, f),
        "reporter:int t:int exports:num4 imports:num4 balance:num4",
        YEARLY + " HAVING count(*) FILTER (WHERE direction = 'export') > 0",
    ),
    "summary_report": Query(
        lambda d, f: totals.summary_report(d.flows, d.countries, f),
        "reporter:int total_exports:num4 total_imports:num4 balance:num4 coverage_pct:num top_export_partner:str "
        "top_import_partner:str export_products:long import_products:long export_countries:long import_countries:long",
        SUMMARY_REPORT,
    ),
    "value_distribution": Query(
        lambda d, f: distribution.value_distribution(d.flows, f),
        "direction:str reporter:int records:long mean:num std:num min:num p25:num p50:num p75:num max:num "
        "skewness:num kurtosis:num jarque_bera:num4 jarque_bera_p:num",
        DISTRIBUTION,
    ),
    "concentration": Query(
        lambda d, f: concentration.concentration(d.flows, f),
        "direction:str reporter:int dimension:str groups:long hhi:num gini:num band:str",
        CONCENTRATION,
    ),
    "correlations": Query(
        lambda d, f: distribution.correlations(d.flows, f),
        "direction:str reporter:int x:str y:str r:num",
        _correlations_sql(),
    ),
    "balance_openness": Query(
        lambda d, f: timeseries.balance_openness(d.flows, f),
        "reporter:int t:int exports:num4 imports:num4 trade_balance:num4 trade_openness:num",
        """SELECT *, exports - imports AS trade_balance,
  (exports + imports) / avg(exports + imports) OVER (PARTITION BY reporter) AS trade_openness FROM both_years""",
    ),
    "growth": Query(
        lambda d, f: timeseries.growth(d.flows, f),
        "direction:str reporter:int t:int v:num4 growth_pct:num",
        "SELECT * FROM growth",
    ),
    "growth_stats": Query(
        lambda d, f: timeseries.growth_stats(d.flows, f),
        "direction:str reporter:int n:long mean:num std:num ci_low:num ci_high:num",
        GROWTH_STATS,
    ),
    "trend": Query(
        lambda d, f: timeseries.trend(d.flows, f),
        "direction:str reporter:int n:long slope:num intercept:num0 slope_low:num slope_high:num",
        TREND,
    ),
    "product_lifecycle": Query(
        lambda d, f: timeseries.product_lifecycle(d.flows, f),
        "reporter:int t:int hs2:str value_usd:num2",
        "SELECT reporter, t, hs2_raw AS hs2, CAST(sum(v) AS DOUBLE) * 1000 AS value_usd FROM x GROUP BY reporter, t, hs2_raw",
    ),
    "product_lifecycle_wide": Query(
        _lifecycle_wide, "reporter:int t:int " + " ".join(f"c{c}:num2" for c in CHAPTERS), _lifecycle_wide_sql()
    ),
    "export_share_latest": Query(
        lambda d, f: timeseries.export_share_latest(d.flows, 10, f),
        "reporter:int t:int rank:int hs2:int export_share:num",
        _ranked(
            """SELECT reporter, t, hs2, v / sum(v) OVER (PARTITION BY reporter, t) AS export_share
FROM (SELECT reporter, t, hs2, CAST(sum(v) AS DOUBLE) AS v, max(t) OVER (PARTITION BY reporter) AS latest
      FROM x GROUP BY reporter, t, hs2) a WHERE t = latest""",
            "reporter", "export_share DESC, hs2", 10,
        ),
    ),
    "trade_intensity": Query(
        lambda d, f: products.trade_intensity(d.flows, 10, f),
        "reporter:int rank:int hs2:int value_sum:num value_count:long value_mean:num partners:long",
        _ranked(
            """SELECT reporter, hs2, round_even(CAST(sum(v) AS DOUBLE), 2) AS value_sum, count(v) AS value_count,
  round_even(avg(CAST(v AS DOUBLE)), 2) AS value_mean, count(DISTINCT partner) AS partners FROM x GROUP BY reporter, hs2""",
            "reporter", "hs2", 10,
        ),
    ),
    "trade_intensity_by_value": Query(
        lambda d, f: products.trade_intensity(d.flows, 10, f, order="value"),
        "reporter:int rank:int hs2:int value_sum:num value_count:long value_mean:num partners:long",
        _ranked(
            """SELECT reporter, hs2, sum(v) AS exact, round_even(CAST(sum(v) AS DOUBLE), 2) AS value_sum, count(v) AS value_count,
  round_even(avg(CAST(v AS DOUBLE)), 2) AS value_mean, count(DISTINCT partner) AS partners FROM x GROUP BY reporter, hs2""",
            "reporter", "exact DESC, hs2", 10,
        ),
    ),
    "product_complexity": Query(
        lambda d, f: complexity.product_ubiquity(d.flows),
        "product:int ubiquity:long complexity_score:num", UBIQUITY, both=False,
    ),
    "export_complexity": Query(
        lambda d, f: complexity.export_complexity(d.flows, f),
        "reporter:int avg_export_complexity:num records:long mean:num std:num min:num p25:num p50:num p75:num max:num",
        f"""SELECT reporter, sum(CAST(v AS DOUBLE) * complexity_score) / CAST(sum(v) AS DOUBLE) AS avg_export_complexity, count(*) AS records,
  avg(complexity_score) AS mean, stddev_samp(complexity_score) AS std, min(complexity_score) AS min,
  quantile_cont(complexity_score, 0.25) AS p25, quantile_cont(complexity_score, 0.5) AS p50,
  quantile_cont(complexity_score, 0.75) AS p75, max(complexity_score) AS max
FROM x LEFT JOIN ({UBIQUITY}) u ON x.k = u.product GROUP BY reporter""",
    ),
    "economic_complexity": Query(
        lambda d, f: complexity.economic_complexity(d.flows, f),
        "reporter:int diversity:long mean_diversity:num diversity_percentile:num",
        """SELECT r.reporter, r.diversity, avg(o.diversity) AS mean_diversity,
  100.0 * avg(CASE WHEN o.diversity < r.diversity THEN 1 ELSE 0 END) AS diversity_percentile
FROM (SELECT reporter, count(DISTINCT k) AS diversity FROM x GROUP BY reporter) r
CROSS JOIN (SELECT i, count(DISTINCT k) AS diversity FROM flows GROUP BY i) o GROUP BY r.reporter, r.diversity""",
    ),
    "market_penetration": Query(
        lambda d, f: complexity.market_penetration(d.flows, f),
        "reporter:int product:int markets:long total_markets:long penetration_rate:num",
        """SELECT a.reporter, a.k AS product, markets, total_markets, CAST(markets AS DOUBLE) / total_markets AS penetration_rate
FROM (SELECT reporter, k, count(DISTINCT partner) AS markets FROM x GROUP BY reporter, k) a
LEFT JOIN (SELECT k, count(DISTINCT j) AS total_markets FROM flows GROUP BY k) b ON a.k = b.k""",
    ),
    "mean_penetration": Query(
        lambda d, f: complexity.mean_penetration(d.flows, f),
        "reporter:int avg_penetration_rate:num products:long",
        """SELECT a.reporter, avg(CAST(markets AS DOUBLE) / total_markets) AS avg_penetration_rate, count(*) AS products
FROM (SELECT reporter, k, count(DISTINCT partner) AS markets FROM x GROUP BY reporter, k) a
LEFT JOIN (SELECT k, count(DISTINCT j) AS total_markets FROM flows GROUP BY k) b ON a.k = b.k GROUP BY a.reporter""",
    ),
    "product_metrics": Query(
        lambda d, f: complexity.product_metrics(d.flows),
        "product:int global_value:num4 num_exporters:long num_importers:long complexity:num", PRODUCT_METRICS, both=False,
    ),
    "product_opportunities": Query(
        lambda d, f: complexity.product_opportunities(d.flows, 20, f),
        "reporter:int rank:int product:int global_value:num4 num_exporters:long num_importers:long complexity:num",
        _ranked(OPEN_PRODUCTS, "reporter", "global_value DESC, product", 20),
    ),
    "opportunity_counts": Query(
        lambda d, f: complexity.opportunity_counts(d.flows, 20, f),
        "reporter:int opportunity_count:long uncut_count:long",
        f"""SELECT e.reporter, least(count(o.product), 20) AS opportunity_count, count(o.product) AS uncut_count
FROM (SELECT DISTINCT reporter FROM x) e LEFT JOIN ({OPEN_PRODUCTS}) o ON o.reporter = e.reporter GROUP BY e.reporter""",
    ),
    "competitive_position": Query(
        lambda d, f: competition.competitive_position(d.flows, focal=f),
        "reporter:int place:int product:int exports_usd:num2 world_usd:num2 market_share:num",
        f"""SELECT reporter, place, p.k AS product, own * 1000 AS exports_usd, w.v * 1000 AS world_usd, own / w.v AS market_share
FROM ({LEADING_PRODUCTS}) p JOIN (SELECT k, CAST(sum(v) AS DOUBLE) AS v FROM flows GROUP BY k) w ON p.k = w.k""",
    ),
    "competitive_rivals": Query(
        lambda d, f: competition.competitive_rivals(d.flows, focal=f),
        "reporter:int product:int rival_rank:int rival:int rival_usd:num2",
        _ranked(
            f"""SELECT p.reporter, p.k AS product, e.i AS rival, e.v * 1000 AS rival_usd
FROM ({LEADING_PRODUCTS}) p JOIN ({EXPORTERS}) e ON p.k = e.k AND e.i <> p.reporter""",
            "reporter, product", "rival_usd DESC, rival", 5, "rival_rank",
        ),
    ),
    "competitive_rank": Query(
        lambda d, f: competition.competitive_rank(d.flows, focal=f),
        "reporter:int product:int exporter_rank:int value:num4 leader_value:num4 field_share:num",
        f"""SELECT p.reporter, p.k AS product, exporter_rank, f.v AS value, leader_value, f.v / field AS field_share
FROM ({LEADING_PRODUCTS}) p JOIN (
  SELECT *, max(v) OVER (PARTITION BY k) AS leader_value, sum(v) OVER (PARTITION BY k) AS field
  FROM ({_ranked(EXPORTERS, 'k', 'v DESC, i', 10, 'exporter_rank')}) t
) f ON p.k = f.k AND p.reporter = f.i""",
    ),
    "partner_profile": Query(
        lambda d, f: partners.partner_profile(d.flows, d.countries, 20, f),
        "direction:str reporter:int rank:int partner:int partner_name:str total_value:num4 product_count:long "
        "first_year:int last_year:int total_value_usd:num2 trade_duration:int",
        PARTNER_PROFILE,
    ),
    "emerging_partners": Query(
        lambda d, f: partners.emerging_partners(d.flows, d.countries, YEARS, 15, f),
        "direction:str reporter:int rank:int partner:int partner_name:str growth_rate:num total_value_usd:num2 years_active:long",
        EMERGING,
    ),
    "product_profile": Query(
        lambda d, f: products.product_profile(d.flows, d.products, 25, f),
        "direction:str reporter:int rank:int product:int description:str total_value:num4 partner_count:long "
        "first_year:int last_year:int total_value_usd:num2 year_span:int",
        PRODUCT_PROFILE,
    ),
    "product_market_matrix": Query(
        lambda d, f: products.product_market_matrix(d.flows, d.countries, d.products, focal=f),
        "reporter:int product:int description:str partner:int partner_name:str value_usd:num2",
        MATRIX,
    ),
    "product_market_pivot": Query(
        _market_pivot,
        "reporter:int product:int description:str " + " ".join(f"m{m}:num2" for m in MARKETS),
        f"SELECT reporter, product, description, "
        + ", ".join(f"coalesce(avg(CASE WHEN partner = {m} THEN value_usd END), 0) AS m{m}" for m in MARKETS)
        + f" FROM ({MATRIX}) m GROUP BY reporter, product, description",
    ),
    "balance_by_partner": Query(
        lambda d, f: partners.balance_by_partner(d.flows, d.countries, 30, f),
        "reporter:int rank:int partner:int partner_name:str exports:num4 imports:num4 exports_usd:num2 imports_usd:num2 "
        "trade_balance:num2 total_trade:num2",
        BALANCE,
    ),
    "balance_extremes": Query(
        lambda d, f: partners.balance_extremes(d.flows, d.countries, 30, f),
        "reporter:int surplus_partners:long deficit_partners:long largest_surplus_partner:str largest_surplus_usd:num2 "
        "largest_deficit_partner:str largest_deficit_usd:num2",
        BALANCE_EXTREMES,
    ),
    "risk_indicators": Query(
        lambda d, f: concentration.risk_indicators(d.flows, f),
        "reporter:int category:str value:num",
        f"""SELECT reporter, CASE WHEN dimension = 'country' THEN 'Geographic Concentration' ELSE 'Product Concentration' END AS category,
  max(value) / sum(value) AS value FROM ({DIMENSION_VALUES}) a WHERE direction = 'export' GROUP BY reporter, dimension
UNION ALL
SELECT reporter, CASE WHEN dimension = 'country' THEN 'Top 5 Country Dependence' ELSE 'Top 5 Product Dependence' END,
  sum(CASE WHEN r <= 5 THEN value END) / sum(value)
FROM (SELECT *, row_number() OVER (PARTITION BY reporter, dimension ORDER BY value DESC, code) AS r
      FROM ({DIMENSION_VALUES}) b WHERE direction = 'export') c GROUP BY reporter, dimension""",
    ),
}

PROFILES: dict[str, Query] = {
    "null_profile": Query(
        lambda d, f: quality.null_profile(d.flows),
        "column_name:str null_pct:num flagged:bool",
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_pct, "
            f"100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) > 50 AS flagged FROM flows"
            for c in ("t", "i", "j", "k", "v", "q")
        ),
        both=False,
    ),
    "unmatched_references": Query(
        lambda d, f: quality.unmatched_references(d.flows, _partial_countries(d), d.products),
        "role:str records:long unmatched_records:long",
        " UNION ALL ".join(
            f"SELECT '{role}' AS role, count(*) AS records, count(*) FILTER (WHERE {name} IS NULL) AS unmatched_records "
            f"FROM flows LEFT JOIN {table} ON {key}"
            for role, name, table, key in (
                ("exporter", "country_name", f"{PARTIAL_SQL} e", "i = country_code"),
                ("importer", "country_name", f"{PARTIAL_SQL} m", "j = country_code"),
                ("product", "description", "products", "lpad(CAST(k AS VARCHAR), 6, '0') = code"),
            )
        ),
        both=False,
    ),
    "merge_growth": Query(
        lambda d, f: quality.merge_growth(d.flows, _doubled_countries(d), d.products),
        "rows_before:long rows_after:long rows_added:long",
        """SELECT a.n AS rows_before, b.n AS rows_after, b.n - a.n AS rows_added
FROM (SELECT count(*) AS n FROM flows) a CROSS JOIN (
  SELECT count(*) AS n FROM flows
  LEFT JOIN (SELECT * FROM countries UNION ALL SELECT * FROM countries WHERE country_code % 5 = 0) e ON i = e.country_code
  LEFT JOIN (SELECT * FROM countries UNION ALL SELECT * FROM countries WHERE country_code % 5 = 0) m ON j = m.country_code
  LEFT JOIN products ON lpad(CAST(k AS VARCHAR), 6, '0') = code
) b""",
        both=False,
    ),
    "duplicate_country_keys": Query(
        lambda d, f: quality.duplicate_keys(_doubled_countries(d), "country_code"),
        "country_code:int copies:long",
        """SELECT country_code, count(*) AS copies
FROM (SELECT * FROM countries UNION ALL SELECT * FROM countries WHERE country_code % 5 = 0) c
GROUP BY country_code HAVING count(*) > 1""",
        both=False,
    ),
    "data_overview": Query(
        lambda d, f: totals.data_overview(d.flows),
        "columns:str first_year:int last_year:int total_value:num4 total_quantity:num records:long",
        """SELECT 't,i,j,k,v,q' AS columns, min(t) AS first_year, max(t) AS last_year, CAST(sum(v) AS DOUBLE) AS total_value,
  sum(q) AS total_quantity, count(*) AS records FROM flows""",
        both=False,
    ),
    "run_metadata": Query(
        lambda d, f: totals.run_metadata(d.flows, f),
        "reporter:int total_records:long export_records:long import_records:long",
        """SELECT reporter, (SELECT count(*) FROM flows) AS total_records,
  count(*) FILTER (WHERE direction = 'export') AS export_records,
  count(*) FILTER (WHERE direction = 'import') AS import_records FROM d GROUP BY reporter""",
    ),
    "summary_kpis": Query(
        lambda d, f: totals.summary_kpis(d.flows, f),
        "reporter:int total_exports:num4 total_imports:num4 trade_balance:num4 export_markets:long export_products:long",
        KPIS,
    ),
    "summary_metrics": Query(
        lambda d, f: totals.summary_metrics(d.flows, f),
        "reporter:int metric:str value:num4",
        " UNION ALL ".join(
            f"SELECT reporter, '{label}' AS metric, CAST({name} AS DOUBLE) AS value FROM ({KPIS}) k"
            for label, name in (
                ("Total Exports", "total_exports"), ("Total Imports", "total_imports"), ("Trade Balance", "trade_balance"),
                ("Export Markets", "export_markets"), ("Export Products", "export_products"),
            )
        ),
    ),
    "prepared_flows": Query(
        lambda d, f: readers.derive(readers.enrich(readers.clean(d.flows), _partial_countries(d), d.products))
        .groupBy("exporter_name", "hs2")
        .agg(
            F.count("*").alias("records"), F.count("description").alias("described"),
            F.count("importer_name").alias("imported"), F.max("hs4").alias("top_hs4"), F.sum("v").alias("v"),
            F.sum("unit_value").alias("unit_value"), F.sum("log_value").alias("log_value"), F.sum("log_quantity").alias("log_quantity"),
        ),
        "exporter_name:str hs2:int records:long described:long imported:long top_hs4:int v:num4 unit_value:num4 log_value:num "
        "log_quantity:num",
        f"""SELECT e.country_name AS exporter_name,
  CAST(substr(lpad(CAST(k AS VARCHAR), 6, '0'), 1, 2) AS INTEGER) AS hs2,
  max(CAST(substr(lpad(CAST(k AS VARCHAR), 6, '0'), 1, 4) AS INTEGER)) AS top_hs4,
  count(*) AS records, count(description) AS described, count(m.country_name) AS imported, CAST(sum(v) AS DOUBLE) AS v,
  sum(CASE WHEN q > 0 THEN CAST(v AS DOUBLE) / q END) AS unit_value,
  sum(ln(1 + greatest(CAST(v AS DOUBLE), 0))) AS log_value, sum(ln(1 + greatest(q, 0))) AS log_quantity
FROM flows LEFT JOIN {PARTIAL_SQL} e ON i = e.country_code LEFT JOIN {PARTIAL_SQL} m ON j = m.country_code
LEFT JOIN products ON lpad(CAST(k AS VARCHAR), 6, '0') = code
WHERE v IS NOT NULL AND q IS NOT NULL AND v >= 1000
GROUP BY e.country_name, 2""",
        both=False,
    ),
}

CHART_TABLES: dict[str, Query] = {
    "chart_direction_totals": Query(
        lambda d, f: totals.direction_totals(d.flows, f), "direction:str reporter:int value:num4",
        "SELECT direction, reporter, CAST(sum(v) AS DOUBLE) AS value FROM d GROUP BY direction, reporter",
    ),
    "chart_partner_names": Query(
        lambda d, f: charts.partner_name_bars(d.flows, d.countries, focal=f),
        "direction:str reporter:int rank:int label:str value:num4",
        f"""SELECT *, CASE WHEN length(partner_name) > 20 THEN substr(partner_name, 1, 20) || '...' ELSE partner_name END AS label
FROM ({_ranked(BY_NAME, SIDE, 'value DESC, partner_name', 8)}) b""",
    ),
    "chart_chapter_pie": Query(
        lambda d, f: charts.chapter_pie(d.flows, focal=f),
        "direction:str reporter:int rank:int hs2:str value:num4 share_pct:num",
        f"""SELECT *, value / sum(value) OVER (PARTITION BY direction, reporter) * 100 AS share_pct
FROM ({_ranked('SELECT direction, reporter, hs2_raw AS hs2, CAST(sum(v) AS DOUBLE) AS value FROM d GROUP BY ALL', SIDE, 'value DESC, hs2', 10)}) p""",
    ),
    "chart_yearly_lines": Query(
        lambda d, f: charts.yearly_lines(d.flows, f), "reporter:int t:int exports:num4 imports:num4", YEARLY,
    ),
    "chart_yearly_billions": Query(
        lambda d, f: charts.yearly_lines_billions(d.flows, f), "reporter:int t:int exports_busd:num10 imports_busd:num10",
        f"SELECT reporter, t, exports / 1e6 AS exports_busd, imports / 1e6 AS imports_busd FROM ({YEARLY}) y",
    ),
    "chart_hhi_gauge": Query(
        lambda d, f: charts.hhi_gauge(d.flows, f), "direction:str reporter:int value:num band:str",
        f"SELECT direction, reporter, hhi AS value, band FROM ({CONCENTRATION}) c WHERE dimension = 'country'",
    ),
    "chart_complexity_histogram": Query(
        lambda d, f: complexity.complexity_histogram(d.flows, 20), "bin:int bin_from:num bin_to:num n:long",
        f"""SELECT bin, lo + bin * w AS bin_from, lo + (bin + 1) * w AS bin_to, count(*) AS n FROM (
  SELECT CAST(least(coalesce(floor((complexity_score - lo) / nullif(w, 0)), 0), 19) AS INTEGER) AS bin, lo, w
  FROM ({UBIQUITY}) u CROSS JOIN (
    SELECT min(complexity_score) AS lo, (max(complexity_score) - min(complexity_score)) / 20 AS w FROM ({UBIQUITY}) a) e
) b GROUP BY bin, lo, w""",
        both=False,
    ),
    "chart_product_treemap": Query(
        lambda d, f: charts.product_treemap(d.flows, d.products, focal=f), "reporter:int rank:int label:str value:num4",
        f"""SELECT reporter, rank, value, hs2 || ': ' || CASE WHEN length(description) > 30 THEN substr(description, 1, 30) || '...'
  ELSE description END AS label
FROM ({_ranked('SELECT reporter, hs2_raw AS hs2, description, CAST(sum(v) AS DOUBLE) AS value FROM x JOIN products ON hs6 = code GROUP BY ALL', 'reporter', 'value DESC, hs2, description', 15)}) t""",
    ),
    "chart_export_map": Query(
        lambda d, f: charts.export_map(d.flows, d.countries, f), "reporter:int iso3:str partner_name:str value:num4",
        """SELECT reporter, country_iso3 AS iso3, country_name AS partner_name, CAST(sum(v) AS DOUBLE) AS value
FROM x JOIN countries ON partner = country_code GROUP BY reporter, country_iso3, country_name""",
    ),
    "chart_competitive_bubbles": Query(
        lambda d, f: charts.competitive_bubbles(d.flows, f), "reporter:int product:int world_usd:num2 market_share:num exports_usd:num2",
        f"""SELECT reporter, p.k AS product, own * 1000 AS exports_usd, w.v * 1000 AS world_usd, own / w.v AS market_share
FROM ({LEADING_PRODUCTS}) p JOIN (SELECT k, CAST(sum(v) AS DOUBLE) AS v FROM flows GROUP BY k) w ON p.k = w.k""",
    ),
    "chart_flow_nodes": Query(
        lambda d, f: flowgraph.flow_nodes(d.flows, d.countries, focal=f), "reporter:int node_id:int layer:int label:str", NODES,
    ),
    "chart_flow_links": Query(
        lambda d, f: flowgraph.flow_links(d.flows, d.countries, focal=f),
        "reporter:int rank:int hop:int source:int target:int value:num4", LINKS,
    ),
    "chart_portfolio_matrix": Query(
        lambda d, f: complexity.portfolio_matrix(d.flows, f),
        "reporter:int hs2:int value:num4 market_reach:long products:long market_share:num median_reach:num median_share:num quadrant:str",
        PORTFOLIO,
    ),
    "chart_time_panel": Query(
        lambda d, f: timeseries.time_panel(d.flows, f),
        "reporter:int t:int exports:num4 imports:num4 balance_busd:num10 trade_openness:num export_growth:num import_growth:num",
        """SELECT *, (exports - imports) / 1e6 AS balance_busd,
  (exports + imports) / avg(exports + imports) OVER (PARTITION BY reporter) AS trade_openness,
  (exports / lag(exports) OVER (PARTITION BY reporter ORDER BY t) - 1) * 100 AS export_growth,
  (imports / lag(imports) OVER (PARTITION BY reporter ORDER BY t) - 1) * 100 AS import_growth FROM both_years""",
    ),
    "chart_trend_lines": Query(
        lambda d, f: timeseries.trend_lines(d.flows, f),
        "direction:str reporter:int t:int v:num4 trend:num0 trend_low:num0 trend_high:num0",
        f"""SELECT s.direction, s.reporter, s.t, s.v, r.intercept + r.slope * m.mid + r.slope * (s.t - m.mid) AS trend,
  r.intercept + r.slope * m.mid + r.slope_low * (s.t - m.mid) AS trend_low,
  r.intercept + r.slope * m.mid + r.slope_high * (s.t - m.mid) AS trend_high
FROM series s JOIN ({TREND}) r ON r.direction = s.direction AND r.reporter = s.reporter
JOIN (SELECT direction, reporter, quantile_cont(CAST(t AS DOUBLE), 0.5) AS mid FROM series GROUP BY direction, reporter) m
  ON m.direction = s.direction AND m.reporter = s.reporter""",
    ),
    "chart_partner_bars": Query(
        lambda d, f: charts.partner_bars(d.flows, d.countries, focal=f), "direction:str reporter:int rank:int partner_name:str value_busd:num10",
        f"SELECT *, total_value_usd / 1e9 AS value_busd FROM ({PARTNER_PROFILE}) p WHERE rank <= 10",
    ),
    "chart_emerging_scatter": Query(
        lambda d, f: charts.emerging_scatter(d.flows, d.countries, YEARS, f), "direction:str reporter:int partner_name:str value_musd:num10 growth_rate:num",
        f"SELECT *, total_value_usd / 1e6 AS value_musd FROM ({EMERGING}) e",
    ),
    "chart_product_bars": Query(
        lambda d, f: charts.product_bars(d.flows, d.products, focal=f), "direction:str reporter:int rank:int label:str value_busd:num10",
        f"""SELECT *, total_value_usd / 1e9 AS value_busd,
  CASE WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' ELSE description END AS label
FROM ({PRODUCT_PROFILE}) p WHERE rank <= 10""",
    ),
    "chart_balance_bars": Query(
        lambda d, f: charts.balance_bars(d.flows, d.countries, focal=f), "reporter:int rank:int partner_name:str balance_busd:num10 sign:str colour:str",
        f"""SELECT *, trade_balance / 1e9 AS balance_busd, CASE WHEN trade_balance > 0 THEN 'surplus' WHEN trade_balance < 0 THEN 'deficit' ELSE 'even' END AS sign,
  CASE WHEN trade_balance > 0 THEN 'green' ELSE 'red' END AS colour FROM ({BALANCE}) b WHERE rank <= 15""",
    ),
    "table_partners": Query(
        lambda d, f: charts.partner_table(d.flows, d.countries, focal=f),
        "direction:str reporter:int rank:int partner_name:str value_text:str product_count:long trade_duration:int",
        f"SELECT *, {_thousands_sql('total_value_usd')} AS value_text FROM ({PARTNER_PROFILE}) p WHERE rank <= 10",
    ),
    "table_products": Query(
        lambda d, f: charts.product_table(d.flows, d.products, focal=f),
        "direction:str reporter:int rank:int label:str value_text:str partner_count:long",
        f"""SELECT *, {_thousands_sql('total_value_usd')} AS value_text,
  CASE WHEN length(description) > 80 THEN substr(description, 1, 80) || '...' ELSE description END AS label
FROM ({PRODUCT_PROFILE}) p WHERE rank <= 10""",
    ),
    "table_balance_headlines": Query(
        lambda d, f: charts.balance_headlines(d.flows, d.countries, f),
        "reporter:int surplus_partners:long deficit_partners:long largest_surplus_partner:str surplus_text:str "
        "largest_deficit_partner:str deficit_text:str",
        f"""SELECT *, '$' || printf('%.1f', largest_surplus_usd / 1e9) || 'B' AS surplus_text,
  '$' || printf('%.1f', largest_deficit_usd / 1e9) || 'B' AS deficit_text FROM ({BALANCE_EXTREMES}) h""",
    ),
    "table_emerging": Query(
        lambda d, f: charts.emerging_table(d.flows, d.countries, YEARS, focal=f),
        "direction:str reporter:int rank:int partner_name:str growth_text:str value_text:str years_active:long",
        f"""SELECT *, printf('%.1f', growth_rate) || '%' AS growth_text, {_thousands_sql('total_value_usd')} AS value_text
FROM ({EMERGING}) e WHERE rank <= 10""",
    ),
}


POINTS = """SELECT *, {scaled} FROM (
  SELECT reporter, partner, partner_name, total_value, total_quantity, product_diversity, years_active,
         total_value / (total_quantity + 0.001) AS unit_value,
         total_value / sum(total_value) OVER (PARTITION BY reporter) AS market_share,
         total_value / years_active AS avg_annual_trade
  FROM (
    SELECT reporter, partner, country_name AS partner_name, CAST(sum(v) AS DOUBLE) AS total_value,
           coalesce(sum(q), 0) AS total_quantity, count(DISTINCT k) AS product_diversity, count(DISTINCT t) AS years_active
    FROM x JOIN countries ON partner = country_code GROUP BY reporter, partner, country_name
  ) a
) b"""


def _points_sql(columns: Sequence[str], robust: bool) -> str:
    cells = []
    for c in columns:
        w = "OVER (PARTITION BY reporter)"
        if robust:
            spread = f"(quantile_cont({c}, 0.75) {w} - quantile_cont({c}, 0.25) {w})"
            cells.append(f"({c} - quantile_cont({c}, 0.5) {w}) / coalesce(nullif({spread}, 0), 1) AS {c}_scaled")
        else:
            cells.append(f"({c} - avg({c}) {w}) / coalesce(nullif(stddev_pop({c}) {w}, 0), 1) AS {c}_scaled")
    return POINTS.format(scaled=", ".join(cells))


ROBUST = _points_sql(features.FEATURES, True)

DISTANCES = """SELECT a.reporter, a.partner AS one, b.partner AS other, sqrt({squares}) AS distance
FROM points a JOIN points b ON a.reporter = b.reporter""".format(
    squares=" + ".join(f"power(a.{c}_scaled - b.{c}_scaled, 2)" for c in features.FEATURES)
)

DENSITY_CORE = """SELECT reporter, one AS partner, count(*) AS neighbours, count(*) >= 3 AS is_core
FROM distances WHERE distance <= 0.5 GROUP BY reporter, one"""

# Closure of the links between core points; the smallest member names a cluster.
DENSITY_CTES = f"""points AS ({ROBUST}),
distances AS ({DISTANCES}),
cored AS ({DENSITY_CORE}),
links AS (
  SELECT d.reporter, d.one, d.other FROM distances d
  JOIN cored a ON a.reporter = d.reporter AND a.partner = d.one AND a.is_core
  JOIN cored b ON b.reporter = d.reporter AND b.partner = d.other AND b.is_core
  WHERE d.distance <= 0.5
),
reach AS (
  SELECT reporter, one, other FROM links
  UNION
  SELECT r.reporter, r.one, l.other FROM reach r JOIN links l ON l.reporter = r.reporter AND l.one = r.other
),
roots AS (SELECT reporter, one AS partner, min(other) AS root FROM reach GROUP BY reporter, one),
core_clusters AS (
  SELECT reporter, partner, dense_rank() OVER (PARTITION BY reporter ORDER BY root) - 1 AS cluster FROM roots
),
clustered AS (
  SELECT c.reporter, c.partner, c.neighbours, c.is_core,
         coalesce(k.cluster, (
           SELECT min(n.cluster) FROM core_clusters n JOIN distances d
             ON d.reporter = n.reporter AND d.other = n.partner
           WHERE d.reporter = c.reporter AND d.one = c.partner AND d.distance <= 0.5), -1) AS cluster
  FROM cored c LEFT JOIN core_clusters k ON k.reporter = c.reporter AND k.partner = c.partner
)"""


def _silhouette_sql(labelled: str) -> str:
    """Mean silhouette per (reporter, labelling) of rows (reporter, labelling, partner, cluster)."""
    return f"""SELECT reporter, labelling, count(*) AS points,
  avg(CASE WHEN inside IS NULL OR nearest IS NULL THEN 0 ELSE (nearest - inside) / greatest(inside, nearest) END) AS silhouette
FROM (
  SELECT reporter, labelling, one, max(CASE WHEN mine = theirs THEN s / nullif(n - 1, 0) END) AS inside,
         min(CASE WHEN mine <> theirs THEN s / n END) AS nearest
  FROM (
    SELECT d.reporter, a.labelling, d.one, a.cluster AS mine, b.cluster AS theirs, sum(d.distance) AS s, count(*) AS n
    FROM distances d
    JOIN ({labelled}) a ON a.reporter = d.reporter AND a.partner = d.one
    JOIN ({labelled}) b ON b.reporter = d.reporter AND b.partner = d.other AND b.labelling = a.labelling
    GROUP BY d.reporter, a.labelling, d.one, a.cluster, b.cluster
  ) t GROUP BY reporter, labelling, one
) m GROUP BY reporter, labelling"""


FIXED_LABELS = """SELECT reporter, partner, 0 AS labelling, CASE WHEN total_value_scaled > 0 THEN 1 ELSE 0 END AS cluster FROM points
UNION ALL
SELECT reporter, partner, 1 AS labelling, CASE WHEN total_value_scaled > 0 THEN 1 ELSE 0 END
  + CASE WHEN unit_value_scaled > 0 THEN 2 ELSE 0 END AS cluster FROM points"""


def _fixed_labels(points: DataFrame) -> DataFrame:
    large = F.when(F.col("total_value_scaled") > 0, 1).otherwise(0)
    dear = F.when(F.col("unit_value_scaled") > 0, 2).otherwise(0)
    return points.withColumn("labels", F.array(large, large + dear))


def _kmeans_properties(data: TradeData) -> DataFrame:
    points = segments.settled(segments.partner_points(data.flows, data.countries))
    return segments.cluster_checks(points, segments.kmeans_sweep(points).models)


SCALED_BASIC = " ".join(f"{c}_scaled:num" for c in features.BASIC_FEATURES)
SCALED = " ".join(f"{c}_scaled:num" for c in features.FEATURES)

SEGMENTS: dict[str, Query] = {
    "partner_features": Query(
        lambda d, f: features.partner_features(d.flows, d.countries, f),
        "reporter:int partner:int partner_name:str total_value:num4 total_quantity:num product_diversity:long "
        "years_active:long unit_value:num market_share:num avg_annual_trade:num",
        POINTS.format(scaled="1 AS one"),
    ),
    "standard_scaled_features": Query(
        lambda d, f: features.standard_scaled(features.partner_features(d.flows, d.countries, f)),
        f"reporter:int partner:int {SCALED_BASIC}",
        _points_sql(features.BASIC_FEATURES, False),
    ),
    "robust_scaled_features": Query(
        lambda d, f: features.robust_scaled(features.partner_features(d.flows, d.countries, f)),
        f"reporter:int partner:int {SCALED}",
        ROBUST,
    ),
    "silhouette_of_labels": Query(
        lambda d, f: segments.silhouettes(_fixed_labels(segments.partner_points(d.flows, d.countries, f))),
        "reporter:int labelling:int points:long silhouette:num",
        f"WITH points AS ({ROBUST}), distances AS ({DISTANCES}) {_silhouette_sql(FIXED_LABELS)}",
    ),
    "density_clusters": Query(
        lambda d, f: segments.density_clusters(segments.partner_points(d.flows, d.countries, f)),
        "reporter:int partner:int neighbours:long is_core:bool cluster:int",
        f"WITH RECURSIVE {DENSITY_CTES} SELECT * FROM clustered",
    ),
    "density_summary": Query(
        lambda d, f: segments.density_summary(segments.density_clusters(segments.partner_points(d.flows, d.countries, f))),
        "reporter:int n_clusters:long n_noise:long silhouette:num",
        f"""WITH RECURSIVE {DENSITY_CTES}
SELECT c.*, CASE WHEN n_clusters > 1 THEN silhouette ELSE 0 END AS silhouette
FROM (SELECT reporter, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_clusters,
             count(*) FILTER (WHERE cluster = -1) AS n_noise FROM clustered GROUP BY reporter) c
JOIN ({_silhouette_sql('SELECT reporter, 0 AS labelling, partner, cluster FROM clustered')}) s ON s.reporter = c.reporter""",
    ),
    # Fits are iterative and labels are free; what must hold for them SQL can tell.
    "kmeans_properties": Query(
        lambda d, f: _kmeans_properties(d),
        "reporter:int k:int points:long misplaced:long off_centre:long inertia_holds:bool total_squares:num4",
        f"""SELECT reporter, k, n AS points, 0 AS misplaced, 0 AS off_centre, true AS inertia_holds, total_squares FROM (
  SELECT reporter, count(*) AS n, count(*) * ({" + ".join(f"var_pop({c}_scaled)" for c in features.FEATURES)}) AS total_squares
  FROM ({ROBUST}) p GROUP BY reporter
) g JOIN range(2, 11) r(k) ON k < n""",
        both=False,
    ),
    "component_properties": Query(
        lambda d, f: segments.component_checks(
            segments.principal_components(segments.settled(segments.partner_points(d.flows, d.countries)), len(features.FEATURES))
        ),
        "reporter:int total_variance:num4 power2:num power3:num power4:num power5:num scores_match:bool",
        f"""SELECT reporter, total_variance, power2, power3, power4, power5, true AS scores_match FROM (
  WITH cells AS (
    SELECT reporter, partner, unnest(range(0, {len(features.FEATURES)})) AS i, unnest([{", ".join(f"{c}_scaled" for c in features.FEATURES)}]) AS x FROM ({ROBUST}) p),
  covariance AS (
    SELECT a.reporter, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM cells a JOIN cells b ON a.reporter = b.reporter AND a.partner = b.partner GROUP BY ALL),
  whole AS (SELECT reporter, sum(c) AS total_variance FROM covariance WHERE i = j GROUP BY reporter),
  one AS (SELECT v.reporter, i, j, c / total_variance AS c FROM covariance v JOIN whole w ON v.reporter = w.reporter),
  two AS (SELECT a.reporter, a.i, b.j, sum(a.c * b.c) AS c FROM one a JOIN one b ON a.reporter = b.reporter AND a.j = b.i GROUP BY ALL),
  three AS (SELECT a.reporter, a.i, b.j, sum(a.c * b.c) AS c FROM two a JOIN one b ON a.reporter = b.reporter AND a.j = b.i GROUP BY ALL)
  SELECT w.reporter, total_variance, power2, power3, power4, power5 FROM whole w
  JOIN (SELECT reporter, sum(c) AS power2 FROM two WHERE i = j GROUP BY reporter) a ON a.reporter = w.reporter
  JOIN (SELECT reporter, sum(c) AS power3 FROM three WHERE i = j GROUP BY reporter) b ON b.reporter = w.reporter
  JOIN (SELECT x.reporter, sum(x.c * y.c) AS power4 FROM two x JOIN two y ON x.reporter = y.reporter AND x.i = y.j AND x.j = y.i GROUP BY x.reporter) e
    ON e.reporter = w.reporter
  JOIN (SELECT x.reporter, sum(x.c * y.c) AS power5 FROM two x JOIN three y ON x.reporter = y.reporter AND x.i = y.j AND x.j = y.i GROUP BY x.reporter) g
    ON g.reporter = w.reporter
) m""",
        both=False,
    ),
    # No SQL twins below; they fit every reporter in the same jobs.
    "kmeans_sweep": Query(
        lambda d, f: segments.kmeans_sweep(segments.partner_points(d.flows, d.countries)).scores,
        "reporter:int k:int inertia:num silhouette:num chosen:bool",
        both=False,
    ),
    "kmeans_centers": Query(
        lambda d, f: segments.kmeans(segments.partner_points(d.flows, d.countries)).centers.select(
            "reporter", "cluster", *[F.col("center")[n].alias(c) for n, c in enumerate(features.FEATURES)]
        ),
        "reporter:int cluster:int " + " ".join(f"{c}:num" for c in features.FEATURES),
        both=False,
    ),
    "basic_segments": Query(
        lambda d, f: segments.basic_segments(d.flows, d.countries).points,
        "reporter:int partner:int partner_name:str cluster:int pca1:num pca2:num",
        both=False,
    ),
    "partner_segments": Query(
        lambda d, f: segments.partner_segments(d.flows, d.countries).partners,
        "reporter:int partner:int partner_name:str kmeans_cluster:int dbscan_cluster:int pca1:num pca2:num pca3:num",
        both=False,
    ),
    "component_variance": Query(
        lambda d, f: segments.principal_components(segments.settled(segments.partner_points(d.flows, d.countries)), 3).variance,
        "reporter:int component:int variance_share:num",
        both=False,
    ),
}

def _section_counts_sql() -> str:
    """Rows of every section per reporter, from the SQL of the analyses behind them."""
    bodies = {
        "metadata": PROFILES["run_metadata"].sql, "summary_statistics": KPIS, "value_distribution": DISTRIBUTION, "concentration": CONCENTRATION,
        "correlations": ANALYSES["correlations"].sql, "yearly": YEARLY, "balance_openness": ANALYSES["balance_openness"].sql,
        "growth_stats": GROWTH_STATS, "trend": TREND, "market_penetration": ANALYSES["mean_penetration"].sql,
        **{name: ANALYSES[name].sql for name in (
            "export_share_latest", "trade_intensity", "export_complexity", "economic_complexity", "opportunity_counts", "product_opportunities")},
        "product_penetration": ANALYSES["market_penetration"].sql,
        "partner_segments": POINTS.format(scaled="1 AS one"),
        "kmeans_scores": SEGMENTS["kmeans_properties"].sql,
        "density_summary": f"SELECT DISTINCT reporter FROM ({POINTS.format(scaled='1 AS one')}) p",
        "component_variance": f"SELECT DISTINCT reporter, c FROM ({POINTS.format(scaled='1 AS one')}) p CROSS JOIN range(3) r(c)",
    }
    counts = [f"SELECT '{name}' AS section, reporter, count(*) AS rows FROM ({body}) s GROUP BY reporter" for name, body in bodies.items()]
    return "\nUNION ALL\n".join([*counts, f"SELECT 'product_complexity' AS section, NULL AS reporter, count(*) AS rows FROM ({UBIQUITY}) s"])


def _result_manifest(data: TradeData, focal: int | None) -> DataFrame:
    """Rows of every section in the files; the centres are left to ``kmeans_scores``, whose chosen k they have."""
    folder = f"{shared_folder(data.flows.sparkSession).rstrip('/')}/results-{uuid.uuid4().hex}"
    return reports.write_results(reports.stored_flows(data), folder, focal).filter(F.col("section") != "kmeans_centers")


DOCUMENTS: dict[str, Query] = {
    "result_manifest": Query(_result_manifest, "reporter:int section:str rows:long", _section_counts_sql(), both=False),
    # Values read back out of the JSON text.
    "result_document": Query(
        lambda d, f: reports.json_results(reports.stored_flows(d), f).select(
            "reporter",
            *[
                F.get_json_object("document", path).alias(name)
                for name, path in (
                    ("total_records", "$.metadata[0].total_records"),
                    ("export_records", "$.metadata[0].export_records"),
                    ("total_exports", "$.summary_statistics[0].total_exports"),
                    ("total_imports", "$.summary_statistics[0].total_imports"),
                    ("export_products", "$.summary_statistics[0].export_products"),
                    ("first_year", "$.yearly[0].t"),
                    ("first_year_exports", "$.yearly[0].exports"),
                )
            ],
        ),
        "reporter:int total_records:long export_records:long total_exports:num4 total_imports:num4 export_products:long "
        "first_year:int first_year_exports:num4",
        f"""SELECT k.*, (SELECT count(*) FROM flows) AS total_records, n.export_records, y.t AS first_year, y.exports AS first_year_exports
FROM ({KPIS}) k
JOIN (SELECT reporter, count(*) FILTER (WHERE direction = 'export') AS export_records FROM d GROUP BY reporter) n
  ON n.reporter = k.reporter
JOIN ({_ranked(YEARLY, 'reporter', 't', 1)}) y ON y.reporter = k.reporter""",
    ),
}


def _registered(spark: SparkSession, sf_dir: str, query: Query, focal: int | None) -> DataFrame:
    return shaped(query.build(star.trade_data(spark, sf_dir), focal), query.shape)


def _entries() -> dict[str, tuple[Query, int | None]]:
    out: dict[str, tuple[Query, int | None]] = {}
    for name, query in {**ANALYSES, **PROFILES, **CHART_TABLES, **SEGMENTS, **DOCUMENTS}.items():
        out[name] = (query, FOCAL if query.both else None)
        if query.both:
            out[f"{name}_all_reporters"] = (query, None)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: (lambda spark, sf_dir, q=query, f=focal: _registered(spark, sf_dir, q, f))
        for name, (query, focal) in _entries().items()
    }


def oracle_sql() -> dict[str, str]:
    return {
        name: shaped_sql(query.sql, query.shape, _ctes(focal))
        for name, (query, focal) in _entries().items()
        if query.sql is not None
    }
