import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from portolan.llm import bpe, mixing, quality
from portolan.llm.common import table
from tests.llm import test_lines, test_probminhash, test_quality


def brute(rows, ranks):
    """Plain Python for the first three stages and the last; rows are (doc_id, text, source)."""
    limits = (quality.MAX_DOCS, quality.MAX_SHARE, quality.MIN_LEFT)
    kept = {r[0] for r in test_quality.expected(rows, *limits) if r[-1]}
    assert not any(r[-2] for r in test_quality.expected(rows, *limits))  # no line of the small table is above the limits
    rows = [r for r in rows if r[0] in kept]
    found, _, cls = test_lines.brute([(i, t) for i, t, _ in rows])
    first = {}
    for no_id, d, text, at, line, doc_id in found:
        first[cls[line]] = min(first.get(cls[line], (d, at)), (d, at))
    gone = {(d, at) for _, d, _, at, line, _ in found if first[cls[line]] != (d, at)}
    rows = [(i, "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone), s) for i, t, s in rows]
    classes, _ = test_probminhash.brute([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if (r[0], r[0]) in classes]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, text, _ in rows:
        ids = encoding.encode_ordinary(text)
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out), rows


def test_run_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").collect()]
    want, _ = brute(rows, bpe.load_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(tuple(r)[:4] for r in out) == want
    assert [r.position for r in out] == list(range(len(want)))


def test_stages_keep_the_columns_of_documents(spark, documents):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, body, "a"), (2, body, "b"), (3, body + " more words here", "a"), (4, "short", "a"), (5, None, None), (None, body.upper(), None), (1, body, "a")]
    docs = documents(rows, extra=("v", "row", "block", "slot", "kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count() > 0


def test_the_mix_is_the_order_of_the_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    placed = sorted(mixing.mix_exact(docs).collect(), key=lambda r: (r.slot, r.offset))
    assert [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()] == [r.doc_id for r in placed]


def test_run_returns_its_rows_in_the_order_of_stage_4(spark, sf_dir, monkeypatch):
    placed = sorted(mixing.mix_exact(table(spark, sf_dir, "documents")).collect(), key=lambda r: (r.slot, r.offset))
    want = [r.doc_id for r in placed]
    stages = corpus_pipeline.STAGES  # the first three do not order rows and are left out here
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages[3:])
    assert [r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()] == want != sorted(want)
    # another decision of the stage gives another order
    by_id = ("by id", lambda spark, docs, sf_dir: docs.orderBy("doc_id"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [by_id, stages[4]])
    assert [r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()] == sorted(want)


def test_the_last_stage_keeps_the_order_and_every_row(spark, documents):
    rows = [(i * 37 % 101, f"text {i}") for i in range(101)] + [(None, "a"), (None, None), (5, "x"), (5, "x")]
    docs = documents(rows).repartition(7).orderBy("text", "doc_id")
    want = [r.doc_id for r in docs.collect()]
    out = corpus_pipeline.byte_bpe(spark, docs, "")
    assert [r.doc_id for r in out.collect()] == want and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position"]


def test_positions_of_a_table_with_many_files_in_a_part(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 2300, numPartitions=2).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").write.option("maxRecordsPerFile", 1).parquet(path)
    placed = corpus_pipeline._placed(spark.read.parquet(path)).collect()
    assert sorted((r.position, r.doc_id) for r in placed) == [(i, i) for i in range(2300)]
