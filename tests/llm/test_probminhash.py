import random
import re
from collections import Counter

import numpy as np
import pytest

from portolan.llm import probminhash
from portolan.llm.common import table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def bag(text):
    words = [w for w in SPACE.split((text or "").lower()) if w]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    items = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in items) for i in a if i in b)


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and (a == b or (len(a & b) and similarity(a, b) >= threshold - 1e-9)):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None) for i in members]
    return sorted(out, key=repr), len(groups)


def got(df):
    rows = df.collect()
    return sorted([(r.doc_id, r.class_id) for r in rows], key=repr), sum(r.kept for r in rows)


def test_table_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(probminhash.near_documents(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def odd_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(40):  # a chain of near copies and copies of copies
        text = list(base)
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(120)] = word()
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(word() for _ in range(50))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \n\t\x0b"), (203, "one two"), (204, "ONE\ttwo "), (205, "one"), (None, "one two"), (None, "no id at all here"), (None, "no id at all here")]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (300, "same " * 5000), (301, "same " * 5000 + "end"), (302, "a b c d e f " * 40), (303, "a b c d e f " * 41)]
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_odd_rows(documents, monkeypatch, block):
    monkeypatch.setattr(probminhash, "BLOCK", block)
    rows = odd_rows()
    df = documents(rows, extra=("v", "d", "row", "group", "key", "a", "b", "kept", "turn"))
    assert got(probminhash.near_documents(df)) == brute(rows)
    assert probminhash.near_documents(df.limit(0)).count() == 0
    kept = probminhash.keep_one(df)
    assert kept.columns == df.columns
    marked = [r.doc_id for r in probminhash.near_documents(df).filter("kept").collect()]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted(marked, key=repr)
    assert probminhash.keep_one(df.limit(0)).count() == 0


def test_pairs_that_miss_the_centre_are_found(documents):
    # b and c link with each other, but not with the text they share bands with
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(300)]
        left = base[:265] + [word() for _ in range(35)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(left)), (10 * g + 2, " ".join(left[:260] + [word() for _ in range(5)] + left[265:]))]
    assert got(probminhash.near_documents(documents(rows))) == brute(rows)


def test_exact_similarity_equals_its_definition():
    rnd = random.Random(3)
    for _ in range(50):
        a = Counter(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 30)))
        b = Counter(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 30)))
        pack = lambda c: (np.array(sorted(map(ord, c)), np.uint64), np.array([c[chr(i)] for i in sorted(map(ord, c))]))
        assert abs(probminhash.probability_jaccard(pack(a), pack(b)) - similarity(a, b)) < 1e-12


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(0)
    items = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    weights = rng.integers(1, 6, len(items))
    other = np.where(rng.random(len(items)) < 0.3, weights * 2, weights)
    keep = rng.random(len(items)) < 0.9
    exact = probminhash.probability_jaccard((items, weights), (items[keep], other[keep]))
    a, b = probminhash.signature(items, weights, 4000), probminhash.signature(items[keep], other[keep], 4000)
    assert abs((a == b).mean() - exact) < 0.03
