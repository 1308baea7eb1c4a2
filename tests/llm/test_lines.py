import random

import numpy as np
import pytest

from portolan.llm import lines
from portolan.llm.common import LAST, table


def distance(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, tau=2, per_edit=20):
    found = []
    for doc_id, text in {(i, t) for i, t in rows}:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\x0b\x0c\r"):
                found.append((doc_id is None, LAST if doc_id is None else doc_id, text, at, line, doc_id))
    texts = sorted({f[4] for f in found})
    root = {t: t for t in texts}
    links = dict.fromkeys(texts, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = {}
    for t in texts:
        by_size.setdefault(len(t), []).append(t)
    for a in texts:
        t = min(tau, len(a) // per_edit)
        for more in range(t + 1):
            for b in by_size.get(len(a) + more, ()):
                if (more or a < b) and distance(a, b) <= t:
                    root[find(a)] = find(b)
                    links[a] += 1
                    links[b] += 1
    return found, links, {t: find(t) for t in texts}


def compare(rows, out, **more):
    found, links, cls = brute(rows, **more)
    assert len(out) >= len(found)
    first = {}
    for no_id, d, text, at, line, doc_id in found:
        first.setdefault(cls[line], []).append((no_id, d, at, doc_id))
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.line_no), []).append(r)
    for no_id, d, text, at, line, doc_id in found:
        own = min(first[cls[line]], key=lambda x: x[:3])
        for r in by[doc_id, at]:
            if sum(f[5] == doc_id and f[3] == at for f in found) == 1:
                assert (r.n_links, r.class_doc, r.class_line) == (links[line], own[3], own[2]), (line, r)
                assert r.kept == ((no_id, d, at) == own[:3])


def test_within_equals_the_edit_distance():
    rnd = random.Random(4)
    short, long, tau, want = [], [], [], []
    for _ in range(800):
        a = "".join(rnd.choice("abé𝒳") for _ in range(rnd.randrange(0, 30)))
        b = list(a)
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "b", "zz"])
        a, b = sorted((a, "".join(b)), key=len)
        t = rnd.randrange(4)
        if len(b) - len(a) <= t:
            short.append(a), long.append(b), tau.append(t), want.append(distance(a, b) <= t)
    assert lines.within(short, long, np.array(tau)).tolist() == want
    assert lines.within([], [], np.zeros(0, int)).tolist() == []


def test_every_close_pair_meets():
    rnd = random.Random(6)
    for _ in range(3000):
        t = rnd.choice([1, 2, 3])
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(t + 1, 25)))
        b = list(a)
        for _ in range(rnd.randrange(1, t + 1)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
        a, b = sorted((a, "".join(b)), key=len)
        assert a == b or len(a) <= t or lines.first_meeting(a, b, t) is not None


def odd_rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(1, 8)))
    base = [" ".join(word() for _ in range(n)) for n in (2, 4, 6, 8, 20) for _ in range(3)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randrange(1, 6)):
            line = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(line) + 1)
                line[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "é"])
            text.append("".join(line))
        rows.append((i, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n \n\t\n"), (None, base[5] + "\n" + base[9]), (103, "y" * 2_000), (104, "y" * 2_000 + "z"), (105, "short\nshort\nshorT")]
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_odd_rows(documents, block):
    rows = odd_rows()
    df = documents(rows + [rows[3], rows[3]], extra=("g", "at", "line", "d", "key", "row", "class", "kept", "content"))
    out = lines.near_lines(df, block=block).collect()
    assert len(out) == sum(bool(x.strip(" \t\x0b\x0c\r")) for _, t in rows + [rows[3], rows[3]] for x in (t or "").split("\n"))
    compare(rows, out)
    if block == 512:
        assert lines.near_lines(df.limit(0)).count() == 0
        gone = {}
        for r in out:
            gone.setdefault(r.doc_id, set()).update(() if r.kept else (r.line_no,))
        new = lines.dedup_lines(df)
        assert new.columns == df.columns and new.count() == len(rows) + 2
        texts = dict(rows)
        for r in new.collect():
            want = texts[r.doc_id]
            if want is not None:
                want = "\n".join(x for i, x in enumerate(want.split("\n")) if i not in gone.get(r.doc_id, ()))
            assert r.text == want and (want is None or r.n_chars == len(want))


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(rows, lines.near_lines(docs).collect())


def test_a_line_of_every_document_is_filed_once(documents, monkeypatch):
    hot, near = "the same notice at the foot of every page", "the same notice at the foot of every pagé"
    rows = [(i, f"{hot}\nown words of document {i:05d} {i * 7919}") for i in range(400)] + [(400, near)]
    tables, plain = [], lines.stored

    def stored(df):
        tables.append(plain(df))
        return tables[-1]

    monkeypatch.setattr(lines, "stored", stored)
    out = lines.near_lines(documents(rows)).collect()
    filed = tables[0].groupBy("line").count().collect()
    assert {r["count"] for r in filed} == {1} and {hot, near} <= {r.line for r in filed}
    kept = [(r.doc_id, r.line_no) for r in out if r.class_doc == 0 and r.class_line == 0 and r.kept]
    assert kept == [(0, 0)] and len([r for r in out if (r.class_doc, r.class_line) == (0, 0)]) == 401
