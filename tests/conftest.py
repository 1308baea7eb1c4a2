import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from portolan.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "portolan-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables not present")
    return folder


FLOW = "t int, i int, j int, k int, v double, q double"


@pytest.fixture
def flows(spark):
    """Builds a flow table from (t, i, j, k, v, q) rows."""
    return lambda rows: spark.createDataFrame([(*r[:4], None if r[4] is None else float(r[4]), None if r[5] is None else float(r[5])) for r in rows], FLOW)


@pytest.fixture
def countries(spark):
    def build(rows):
        return spark.createDataFrame(rows, "country_code int, country_name string, country_iso3 string")

    return build


@pytest.fixture
def products(spark):
    return lambda rows: spark.createDataFrame(rows, "code string, description string")


def rows(df, *order):
    """Rows as dictionaries, sorted by the given columns."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(r[c] for c in order)) if order else out


@pytest.fixture
def as_rows():
    return rows
