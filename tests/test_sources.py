import pytest

from portolan import load
from portolan.operators import quality
from portolan.sources import readers
from portolan.sources.readers import SourceError, TradeData

FLOWS = "t,i,j,k,v,q\n2020,50,842,610910,1000.0,2.0\n2020,50,842,30420,999.999,NA\n2021,842,50,520100,5000,\n2021,50,999,610910,7000,3.5\n"
COUNTRIES = "country_code,country_name,country_iso2,country_iso3\n50,Home,HM,HOM\n842,Away,NA,AWY\n"
PRODUCTS = "code,description\n030420,Fillets\n610910,Shirts\n520100,Cotton\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "flows.csv").write_text(FLOWS)
    (tmp_path / "countries.csv").write_text(COUNTRIES)
    (tmp_path / "products.csv").write_text(PRODUCTS)
    return tmp_path


def paths(folder):
    return [str(folder / f"{n}.csv") for n in ("flows", "countries", "products")]


def test_load_reads_typed_tables(spark, folder, as_rows):
    data = load(spark, *paths(folder))
    assert data.flows.count() == 4
    assert [r["q"] for r in as_rows(data.flows, "t", "k", "v")] == [None, 2.0, None, 3.5]
    # The leading zero of a product code survives; a marker cell is missing.
    assert [r["code"] for r in as_rows(data.products, "code")] == ["030420", "520100", "610910"]
    assert [r["country_iso2"] for r in as_rows(data.countries, "country_code")] == ["HM", None]


def test_parquet_source(spark, folder):
    data = load(spark, *paths(folder))
    places = []
    for name, df in zip(data._fields, data):
        places.append(str(folder / name))
        df.write.parquet(places[-1])
    again = load(spark, *places)
    assert again.flows.count() == 4 and again.products.count() == 3


def test_strict_data_set(spark, folder, as_rows):
    data = load(spark, *paths(folder), drop_missing=True, min_value=1000)
    assert [r["v"] for r in as_rows(data.flows, "v")] == [1000.0, 7000.0]


def test_minimum_is_inclusive(flows):
    df = flows([(2020, 1, 2, 10100, 1000.0, 1), (2020, 1, 2, 10100, 999.999, 1)])
    assert readers.at_least(df, 1000).count() == 1


def test_bad_sources_are_reported(spark, folder):
    good = paths(folder)
    with pytest.raises(SourceError, match="cannot read"):
        load(spark, str(folder / "absent.csv"), *good[1:])
    (folder / "empty.csv").write_text("t,i,j,k,v,q\n")
    with pytest.raises(SourceError, match="empty"):
        load(spark, str(folder / "empty.csv"), *good[1:])
    spark.read.csv(good[0], header=True, inferSchema=True).drop("q").write.parquet(str(folder / "short"))
    with pytest.raises(SourceError, match="missing columns: q"):
        load(spark, str(folder / "short"), *good[1:])
    spark.read.csv(good[0], header=True).write.parquet(str(folder / "text"))
    with pytest.raises(SourceError, match="not numeric"):
        load(spark, str(folder / "text"), *good[1:])


def test_enrich_keeps_unmatched_and_fans_out(flows, countries, products, as_rows):
    df = flows([(2020, 50, 999, 30420, 5, 1), (2020, 50, 842, 30420, 6, 1)])
    names = countries([(50, "Home", "HOM"), (842, "Away", "AWY")])
    goods = products([("030420", "Fillets")])
    got = as_rows(readers.enrich(df, names, goods), "v")
    assert [r["importer_name"] for r in got] == [None, "Away"]
    assert [r["description"] for r in got] == ["Fillets", "Fillets"]
    assert got[0]["k_str"] == "030420" and got[0]["exporter_iso3"] == "HOM"
    twice = names.unionByName(names.filter("country_code = 50"))
    assert readers.enrich(df, twice, goods).count() == 4


def test_prepared_flows_of_one_reporter(flows, countries, products, as_rows):
    df = flows([(2020, 50, 842, 30420, 5, 2), (2020, 842, 4, 30420, 6, 1)])
    data = TradeData(df, countries([(50, "Home", "HOM")]), products([("030420", "Fillets")]))
    got = as_rows(readers.prepared_flows(data, 50))
    assert len(got) == 1
    assert (got[0]["hs2"], got[0]["hs4"], got[0]["unit_value"]) == (3, 304, 2.5)


def test_null_profile(flows, as_rows):
    df = flows([(2020, 1, 2, 3, None, None), (2020, 1, 2, 3, 1, None), (2020, 1, 2, 3, 1, None), (2020, 1, 2, 3, 1, 1)])
    got = {r["column_name"]: r for r in as_rows(quality.null_profile(df))}
    assert got["v"]["null_pct"] == 25 and not got["v"]["flagged"]
    assert got["q"]["null_pct"] == 75 and got["q"]["flagged"]


def test_unmatched_references(flows, countries, products, as_rows):
    df = flows([(2020, 50, 999, 30420, 5, 1), (2020, 50, 998, 1, 5, 1), (2020, 7, 50, 30420, 5, 1)])
    got = quality.unmatched_references(df, countries([(50, "Home", "HOM"), (7, None, None)]), products([("030420", "x")]))
    assert {r["role"]: r["unmatched_records"] for r in as_rows(got)} == {"exporter": 1, "importer": 2, "product": 1}


def test_merge_growth(flows, countries, products, as_rows):
    df = flows([(2020, 50, 842, 30420, 5, 1), (2020, 50, 50, 30420, 5, 1), (2020, 842, 842, 1, 5, 1)])
    names = countries([(50, "Home", "HOM"), (50, "Home", "HOM"), (842, "Away", "AWY")])
    goods = products([("030420", "x"), ("030420", "y")])
    (got,) = as_rows(quality.merge_growth(df, names, goods))
    assert got == {"rows_before": 3, "rows_after": readers.enrich(df, names, goods).count(), "rows_added": 2 * 2 + 4 * 2 + 1 - 3}
    assert as_rows(quality.duplicate_keys(names, "country_code")) == [{"country_code": 50, "copies": 2}]


def test_stored_flows_prune_years(spark, flows, tmp_path):
    df = flows([(2019 + n % 3, n % 5, n % 7, 10100 + n, n, 1) for n in range(60)])
    readers.store_flows(df, str(tmp_path / "stored"))
    back = readers.read_flows(spark, str(tmp_path / "stored"))
    assert back.select(*df.columns).exceptAll(df).isEmpty() and back.count() == 60
    text = back.filter("t = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t" in text


BAD = "t,i,j,k,v,q\n2020,50,842,610910,abc,2\n2020,50,842,30420,5000.5,x1\n2021,842,50,520100,7000,NA\n2021.0,842,50,520100,-,\n20x,842,50,99999999999,8000,1\n"


def test_unreadable_cells_are_counted_and_raise(spark, folder, as_rows):
    good = paths(folder)
    bad = str(folder / "bad.csv")
    (folder / "bad.csv").write_text(BAD)
    rows = readers.read_with_rejects(spark, bad)
    report = {r["column_name"]: r for r in as_rows(readers.reject_report(rows))}
    assert {c: (r["records"], r["known"], r["unreadable"]) for c, r in report.items()} == {
        "t": (5, 4, 1), "i": (5, 5, 0), "j": (5, 5, 0), "k": (5, 4, 1), "v": (5, 3, 2), "q": (5, 2, 1), "": (5, 0, 0),
    }
    assert report["v"]["example"] == "-" and report["k"]["example"] == "99999999999"
    # unreadable cells stay NULL in rows that stay; a whole number may have a zero fraction
    assert sorted((r["t"] or 0, r["v"]) for r in as_rows(readers.read_flows(spark, bad)) if r["v"] is not None) == [(0, 8000.0), (2020, 5000.5), (2021, 7000.0)]
    assert sorted(r["t"] for r in as_rows(rows) if r["t"]) == [2020, 2020, 2021, 2021]
    with pytest.raises(SourceError, match="5 unreadable cells, more than 0: 2 in v, for example '-'"):
        load(spark, bad, *good[1:])
    with pytest.raises(SourceError, match="more than 4"):
        load(spark, bad, *good[1:], max_rejects=4)
    assert load(spark, bad, *good[1:], max_rejects=5).flows.count() == 5
    assert load(spark, bad, *good[1:], max_rejects=None).flows.count() == 5


def test_a_text_column_is_not_numeric(spark, folder):
    (folder / "text.csv").write_text("t,i,j,k,v,q\n2020,50,842,610910,low,2\n2020,50,842,30420,high,NA\n2020,50,842,30420,,1\n")
    with pytest.raises(SourceError, match="not numeric: v, for example 'high'"):
        load(spark, str(folder / "text.csv"), *paths(folder)[1:], max_rejects=100)


def test_broken_records_are_rejects(spark, folder, as_rows):
    (folder / "broken.csv").write_text("t,i,j,k,v,q\n2020,50,842,610910,1000,2\n2020,50\n2020,50,842,610910,1000,2,9\n")
    report = {r["column_name"]: r["unreadable"] for r in as_rows(readers.reject_report(readers.read_with_rejects(spark, str(folder / "broken.csv"))))}
    assert report == {"t": 0, "i": 0, "j": 0, "k": 0, "v": 0, "q": 0, "": 2}


def test_ingest_counts_while_it_writes(spark, folder, as_rows):
    bad, target = str(folder / "bad.csv"), str(folder / "stored")
    (folder / "bad.csv").write_text(BAD)
    report = {r["column_name"]: r["unreadable"] for r in as_rows(readers.ingest_flows(spark, bad, target, max_rejects=5))}
    assert report == {"t": 1, "i": 0, "j": 0, "k": 1, "v": 2, "q": 1, "": 0}
    assert spark.read.parquet(target).count() == 5
    with pytest.raises(SourceError, match="5 unreadable cells, more than 0"):
        readers.ingest_flows(spark, bad, target)
    clean = as_rows(readers.ingest_flows(spark, paths(folder)[0], target))
    assert {r["unreadable"] for r in clean} == {0} and {r["records"] for r in clean} == {4}
    assert readers.read_with_rejects(spark, target).filter("size(_rejects) > 0").count() == 0
