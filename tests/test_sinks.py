import json

import pytest

from portolan.operators import totals
from portolan.plans import catalog, reports
from portolan.sinks import read_section, result_document, write_json, write_tables
from portolan.sources import star
from portolan.sources.readers import TradeData


@pytest.fixture
def data(flows, countries, products):
    rows = [
        (t, i, j, k, 100 * t % 97 + i * 7 + j * 3 + k % 11 + 1, 1 + (i + j) % 3)
        for t in (2019, 2020, 2021, 2022, 2023)
        for i in (4, 8, 50, 56, 76)
        for j in (4, 8, 50, 56, 76, 842)
        for k in (30420, 610910, 520100)
        if (i + j + k + t) % 4
    ]
    names = countries([(c, f"Country {c}", f"C{c}") for c in (4, 8, 50, 56, 76, 842)])
    return TradeData(flows(rows), names, products([("030420", "Fillets"), ("610910", "Shirts"), ("520100", "Cotton")]))


def read_json(folder):
    return [json.loads(line) for part in folder.glob("part-*") for line in part.read_text().splitlines()]


def test_json_rows_keep_missing_values_and_lose_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "x")], "a int, b double, c string")
    write_json(df, str(tmp_path / "out"))
    got = sorted(read_json(tmp_path / "out"), key=lambda r: r["a"])
    assert got == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": 0.5, "c": "x"}]


def test_document_per_reporter(spark):
    one = spark.createDataFrame([(1, 2020, 5.0), (1, 2019, 4.0), (2, 2020, float("nan"))], "reporter int, t int, v double")
    other = spark.createDataFrame([(1, "x")], "reporter int, label string")
    docs = {r["reporter"]: json.loads(r["document"]) for r in result_document({"yearly": one, "labels": other}).collect()}
    assert docs[1] == {"reporter": 1, "yearly": [{"t": 2019, "v": 4.0}, {"t": 2020, "v": 5.0}], "labels": [{"label": "x"}]}
    assert docs[2] == {"reporter": 2, "yearly": [{"t": 2020, "v": None}], "labels": []}


def test_json_results(data):
    (row,) = reports.json_results(data, 50).collect()
    doc = json.loads(row["document"])
    assert doc["metadata"][0]["total_records"] == data.flows.count()
    assert len(doc["correlations"]) == 32 and len(doc["yearly"]) == 5
    kpis = doc["summary_statistics"][0]
    assert kpis["trade_balance"] == kpis["total_exports"] - kpis["total_imports"]


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_write_tables(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    (path,) = write_tables({"t": df}, str(tmp_path), fmt)
    back = spark.read.format(fmt).option("header", True).load(path).collect()
    assert len(back) == 1 and str(back[0]["a"]) == "1"
    assert (json.loads(back[0]["b"]) if fmt == "csv" else list(back[0]["b"])) == [1, 2]


def test_export_tables(spark, data, tmp_path):
    paths = reports.export_tables(data, 50, str(tmp_path))
    counts = {p.rsplit("/", 1)[1]: spark.read.parquet(p).count() for p in paths}
    assert counts["exports"] == data.flows.filter("i = 50").count()
    assert counts["imports"] == data.flows.filter("j = 50").count()
    assert counts["clustering"] == 6 and counts["summary"] == 5


def test_every_report_table_runs(data):
    tables = {
        **{f"basic {n}": t for n, t in reports.basic_report(data, 50).items()},
        **{f"deep {n}": t for n, t in reports.deep_report(data, 50).items()},
        **{f"partner {n}": t for n, t in reports.partner_report(data, 50).items()},
    }
    for name, df in tables.items():
        if name.startswith("partner emerging"):
            continue
        assert df.count() > 0, name


def test_enhanced_report(data):
    tables = reports.enhanced_report(data, 50)
    assert {"partner_segments", "flow_nodes", "trend", "risk_indicators"} <= set(tables)
    for name in ("partner_segments", "flow_links", "risk_indicators", "time_panel"):
        assert tables[name].count() > 0, name


def test_whole_results_are_written_and_read_back(spark, data, tmp_path):
    folder = str(tmp_path / "results")
    manifest = reports.write_results(data, folder).collect()
    rows = {(m["reporter"], m["section"]): m["rows"] for m in manifest}
    sections = reports.result_sections(data)
    assert {s for _, s in rows} == set(sections) - {"product_opportunities"}  # this one is empty here
    assert {s for r, s in rows if r is None} == {"product_complexity"}
    for name in ("partner_segments", "product_penetration", "product_complexity", "kmeans_scores", "trend", "correlations", "metadata"):
        schema = sections[name].schema
        back = read_section(spark, folder, name, schema)
        assert back.count() == sections[name].count() == sum(n for (_, s), n in rows.items() if s == name), name
    # values survive the way through the files
    key = ["reporter", "product"]
    first, again = (sorted(map(tuple, d.select(*key, "markets", "penetration_rate").collect())) for d in (sections["product_penetration"], read_section(spark, folder, "product_penetration", sections["product_penetration"].schema)))
    assert first == again
    documents = {d["reporter"]: json.loads(d["document"]) for d in spark.read.parquet(f"{folder}/documents").collect()}
    assert set(documents) == {r for r, _ in rows if r is not None}
    doc = documents[50]
    assert doc["metadata"][0]["total_records"] == data.flows.count() and doc["summary_statistics"][0]["export_products"] == 3
    assert {s["section"]: s["rows"] for s in doc["sections"]} == {s: n for (r, s), n in rows.items() if r == 50}


def test_sections_share_one_cube(spark, data, tmp_path):
    """Sections about sums read the stored cube and not the flows; a cube changes no result."""
    path = str(tmp_path / "flows")
    data.flows.write.parquet(path)
    stored = data._replace(flows=spark.read.parquet(path))
    sections = reports.statistics_sections(stored)
    plans = {n: d._jdf.queryExecution().executedPlan().toString() for n, d in sections.items()}
    assert {n for n, p in plans.items() if path in p} == {"metadata", "correlations", "trade_intensity", "export_complexity"}
    whole = reports.statistics_sections(data, cube=data.flows)
    for name in ("summary_statistics", "concentration", "yearly", "export_share_latest", "economic_complexity", "market_penetration", "product_opportunities"):
        a, b = (sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d[name].collect()), key=repr) for d in (sections, whole))
        assert a == b, name


@pytest.fixture
def star_tables(spark, tmp_path):
    """A folder of order-line tables: ten orders of three nations in two years."""
    tables = {
        "nation": ([(i, f"Nation {i}") for i in range(3)], "n_nationkey long, n_name string"),
        "customer": ([(i, i % 3) for i in range(6)], "c_custkey long, c_nationkey long"),
        "supplier": ([(i, i % 3) for i in range(4)], "s_suppkey long, s_nationkey long"),
        "part": ([(i, f"Brand#1{i}", "SMALL", i + 1) for i in range(4)], "p_partkey long, p_brand string, p_type string, p_size long"),
        "orders": ([(i, i % 6, f"{1997 + i % 2}-03-01") for i in range(10)], "o_orderkey long, o_custkey long, o_orderdate string"),
        "lineitem": (
            [(i % 10, i % 4, i * 7 % 4, float(i % 5 + 1), 100.0 + i * i, 0.1, i % 3 / 100) for i in range(60)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def read_by(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), sorted(df.inputFiles())


def test_the_document_query_joins_the_star_tables_once(spark, star_tables):
    """All sections read flows that were written once: none of them reads line items again."""
    out = catalog.queries()["result_document_all_reporters"](spark, star_tables)
    plan, files = read_by(out)
    assert files and not any("lineitem" in f for f in files) and "l_orderkey" not in plan
    rows = {r.reporter: r for r in out.collect()}
    unstored = reports.json_results(star.trade_data(spark, star_tables))
    want = {r.reporter: json.loads(r.document) for r in unstored.collect()}
    assert set(rows) == set(want) == {0, 1, 2}
    for reporter, doc in want.items():
        assert rows[reporter].total_records == 60 and rows[reporter].export_records == doc["metadata"][0]["export_records"]
        assert rows[reporter].first_year == doc["yearly"][0]["t"] and rows[reporter].export_products == doc["summary_statistics"][0]["export_products"]


def test_the_manifest_query_joins_the_star_tables_once(spark, star_tables, monkeypatch):
    """The sections of the manifest are made from flows that were written once."""
    given = []

    def few(data, focal=None):
        given.append(read_by(data.flows))
        return {"metadata": totals.run_metadata(data.flows, focal), "summary_statistics": totals.summary_kpis(data.flows, focal)}

    monkeypatch.setattr(reports, "result_sections", few)
    found = catalog.queries()["result_manifest"](spark, star_tables).collect()
    ((plan, files),) = given
    assert files and not any("lineitem" in f for f in files) and "l_orderkey" not in plan
    assert sorted(tuple(r) for r in found) == [(r, s, 1) for r in range(3) for s in ("metadata", "summary_statistics")]
