import random
import zlib

import numpy as np
import pytest

from portolan.llm import toxicity
from portolan.llm.common import table

BAD = ["stupid", "moron", "pathetic", "worthless", "disgusting"]


def labelled(n, seed=1):
    rnd = random.Random(seed)
    syllables = ["an", "ther", "ion", "ble", "re", "ou", "sh", "in", "est", "ha", "dor", "mi"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(20, 120))]
        toxic = i % 3 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (99_999, 1), (3, None)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_held_out_accuracy_and_unseen_misspellings(spark, model):
    rows = labelled(400, seed=2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [out[i].predicted == label for i, _, label in rows]
    assert np.mean(right) > 0.95
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    plain = "ther ion reble anou shin est " * 5
    texts = [(0, plain), (1, plain + "stupidd"), (2, plain + "pathetick"), (3, plain + "w0rthless")]
    scores = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert all(scores[i] > scores[0] for i in (1, 2, 3))


def test_odd_rows(spark, model, documents):
    rows = [(1, None), (2, ""), (None, "stupid moron"), (3, "x" * 50_000), (3, "x" * 50_000), (4, "stupid " * 20_000), (5, "!!! ???"), (6, "日本 é ß")]
    df = documents(rows, extra=("score", "toxic", "held_out"))
    out = toxicity.score(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert next(r for r in out if r.doc_id is None).predicted == 1 and next(r for r in out if r.doc_id is None).held_out is False
    assert next(r for r in out if r.doc_id == 4).predicted == 1
    assert toxicity.score(df.limit(0), model).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = labelled(120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    truth = [(i, t) for i, _, t in rows]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in truth]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (truth, turned))
    assert a.intercept == b.intercept and (a.weights == b.weights).all()


def test_without_labels_every_score_is_the_base_rate(spark, documents):
    df = documents([(1, "a"), (2, None)])
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(df, toxicity.fit(df, empty)).collect()} == {0}


def test_table_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    hit = [r.predicted for r in scored if r.toxic == 1]
    false = [r.predicted for r in scored if r.toxic == 0]
    assert np.mean(hit) > 0.5 and np.mean(false) < 0.2


def test_features_do_not_cross_words():
    one, n1 = toxicity.features(["stupid", "moron"])
    two, n2 = toxicity.features(["moron"])
    assert one[n1[0] :].tolist() == two.tolist() and n1[1] == n2[0]
