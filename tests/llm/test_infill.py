import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from portolan.llm import infill, queries
from portolan.llm.common import table


def expected(rows, rate=100):
    out = []
    for doc_id, text in rows:
        text = text or ""
        h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            out.append((doc_id, n, "plain", None, None, text))
        elif h4 % 100 < 50:
            out.append((doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"))
        else:
            out.append((doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"))
    return sorted(out, key=repr)


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n\n"), (5, "no line end"), (6, "a\nb"), (7, "a\nb\n"), (8, "x<P>\ny"), (9, "<S\n><\nM\n>"), (10, "é\n中文\n👩‍👩‍👧\nß"),
    (11, "line\r\nnext same\x0bsame\n"), (12, "\x00\n\x00"), (None, "a\nb\nc\nd"), (None, None), (13, "<\n" * 50 + "<"), (14, "P>\n" * 9 + "<"), (-3, "q\n" * 7),
    (15, "tie\ntie\n"), (15, "tie\ntie\n"), (15, "other\ntext"), (2**62, "\n" + "long line " * 30_000 + "\n中\n"), (16, "y\n" * 100_000), (17, "é" * 70_000 + "\n" + "é"),
]


def test_odd_texts(documents):
    df = documents(ODD, extra=("n", "form", "output", "_text", "_cut", "h1"))
    got = infill.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected(ODD)
    texts = sorted((r[0] or "") for r in got.select(infill.restored()).collect())
    assert texts == sorted((t or "") for _, t in ODD)
    assert infill.digest(infill.fill_in_middle(df.limit(0))).collect() == []


def test_rates_and_forms(documents):
    rows = [(i, "a\nb\nc\n") for i in range(300)]
    got = sorted([tuple(r) for r in infill.fill_in_middle(documents(rows), rate=30).collect()], key=repr)
    assert got == expected(rows, rate=30)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        infill.fill_in_middle(documents(rows), unit_end="é")


def test_table_equals_brute_force_and_sql(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted([tuple(r) for r in infill.fill_in_middle(docs).collect()], key=repr) == expected(rows)
    got = queries.op11_fill_in_middle(spark, sf_dir)
    documents = docs.toArrow()  # noqa: F841 - read by name
    twin = duckdb.sql(queries.OP11_SQL)
    assert twin.columns == got.columns
    assert sorted(twin.fetchall(), key=repr) == sorted([tuple(r) for r in got.collect()], key=repr)


def test_sql_on_odd_texts(documents):
    df = documents(ODD)
    found = duckdb.connect()
    found.register("documents", pa.table(df.toArrow()))
    want = [tuple(r) for r in infill.digest(infill.fill_in_middle(df)).collect()]
    assert sorted(found.sql(queries.OP11_SQL).fetchall(), key=repr) == sorted(want, key=repr)


def test_rank_and_select_over_words():
    rnd = random.Random(4)
    for density in (0.0, 0.02, 0.5, 1.0):
        data = np.array([10 if rnd.random() < density else rnd.choice([9, 11, 138, 0, 255, 128, 10 ^ 128]) for _ in range(1000)], np.uint8)
        marks = infill.Marks(infill.equal_bytes(infill.words_of(data), 10))
        places = np.flatnonzero(data == 10)
        assert marks.select(np.arange(len(places))).tolist() == places.tolist()
        assert marks.rank(np.arange(1001)).tolist() == [int((data[:i] == 10).sum()) for i in range(1001)]


def test_continuation_bytes():
    data = np.frombuffer("aé中👩߿￿\x7f".encode() * 5, np.uint8)
    marks = infill.Marks(infill.continuation_bytes(infill.words_of(data)))
    assert marks.rank(np.arange(len(data) + 1)).tolist() == [int(((data[:i] & 0xC0) == 0x80).sum()) for i in range(len(data) + 1)]
