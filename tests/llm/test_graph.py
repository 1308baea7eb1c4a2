import pytest

from portolan.llm import graph


@pytest.fixture
def many_partitions(spark):
    """So many shuffle partitions that most of a small table's are empty, and none is put together."""
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("per_file, most", [(200_000, 1), (40, 5)])
def test_rounds_are_written_in_as_many_files_as_they_fill(spark, monkeypatch, many_partitions, per_file, most):
    written = []

    def settled(df, whole=graph.settled):
        out = whole(df)
        written.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "settled", settled)
    monkeypatch.setattr(graph, "EDGES_PER_FILE", per_file, raising=False)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 150)] + [(500, 501), (7, 7), (501, 500)], "a long, b long")
    found = {r.node: r.component for r in graph.components(links).collect()}
    assert found == {**dict.fromkeys(range(151), 0), 500: 500, 501: 500}
    assert len(written) > 2 and max(written[1:]) <= most
