import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    """Tests have no cluster: their checkpoints go to a folder of the test run."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text[, source]) rows, with extra columns of clashing names."""

    def build(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1]), *["x" for _ in extra]) for r in rows]
        return spark.createDataFrame(full, COLUMNS + "".join(f", {c} string" for c in extra))

    return build
