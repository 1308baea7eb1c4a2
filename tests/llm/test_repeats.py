import hashlib
import random
import re

import numpy as np
import pytest

from portolan.llm import suffixes, subtrees
from portolan.llm.common import LAST, table

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def expected_words(rows, length):
    docs = [(i, LAST if i is None else i, SPACE.findall((t or "").encode())) for i, t in rows]
    first = {}
    for _, o, words in docs:
        for a in range(len(words) - length + 1):
            w = tuple(words[a : a + length])
            first[w] = min(first.get(w, o), o)
    out = []
    for i, o, words in docs:
        gone = set()
        for a in range(len(words) - length + 1):
            if first[tuple(words[a : a + length])] < o:
                gone |= set(range(a, a + length))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def expected_bytes(rows, length):
    docs = [(i, (t or "").encode()) for i, t in rows]
    times = {}
    for _, b in docs:
        for a in range(len(b) - length + 1):
            k = hashlib.md5(b[a : a + length]).digest()
            times[k] = times.get(k, 0) + 1
    out = []
    for i, b in docs:
        gone = np.zeros(len(b) + length, bool)
        for a in range(len(b) - length + 1):
            if times[hashlib.md5(b[a : a + length]).digest()] > 1:
                gone[a : a + length] = True
        gone = gone[: len(b)]
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_tables_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(subtrees.digest(subtrees.dedup_substrings(docs))) == expected_words(rows, 13)
    assert got(suffixes.digest(suffixes.dedup_bytes(docs))) == expected_bytes(rows, 400)


def odd_rows(seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "é", "ab", "ba", "x" * 30, "zz"]) + rnd.choice(["", "", str(rnd.randrange(9))])
    passage = " ".join(word() for _ in range(30))
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(40))) + rnd.choice(["\n", " ", "\t\x0b"]) + (passage if i % 3 else "") + " " + " ".join(word() for _ in range(rnd.randrange(30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (None, passage), (None, passage + " tail"), (5, rows[5][1]), (5, passage * 2), (7, "same " * 300), (8, "same same " * 200), (103, "a" * 700), (104, "b" + "a" * 650)]
    rows += [(200, " ".join(f"w{i % 997}" for i in range(30_000))), (201, " ".join(f"w{i}" for i in range(40)))]
    return rows


@pytest.mark.parametrize("group_units", [4_000_000, 100])
def test_odd_rows(documents, group_units):
    rows = odd_rows()
    df = documents(rows, extra=("k", "h", "o", "c", "found", "kept", "size"))
    assert got(subtrees.digest(subtrees.dedup_substrings(df, group_units=group_units))) == expected_words(rows, 13)
    assert got(suffixes.digest(suffixes.dedup_bytes(df, 40, 16, group_units=group_units))) == expected_bytes(rows, 40)


def test_empty_table(documents):
    df = documents([])
    assert subtrees.dedup_substrings(df).count() == 0 and suffixes.dedup_bytes(df).count() == 0


def test_spans_and_kept_text(documents):
    shared = " ".join(f"s{i}" for i in range(15))
    out = {r.doc_id: r for r in subtrees.dedup_substrings(documents([(1, f"a {shared} b"), (2, f"c d {shared} e")])).collect()}
    assert out[1].spans == [] and [tuple(s) for s in out[2].spans] == [(2, 17)] and bytes(out[2].kept) == b"c d e"


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + 1 + seed, 3000).astype(np.uint8)
    text[500:1500] = text[1600:2600]
    order = suffixes.suffix_array(text, 64)
    assert sorted(order.tolist()) == list(range(len(text)))
    raw = text.tobytes()
    keys = [raw[i : i + 64] for i in order]
    assert keys == sorted(keys)
    same = suffixes.neighbours_equal(order, text, 64)
    inside = order <= len(text) - 64
    pairs = inside[1:] & inside[:-1]
    assert (same[1:][pairs] == np.array([a == b for a, b in zip(keys, keys[1:])])[pairs]).all()


@pytest.mark.parametrize("seed", range(4))
def test_only_wanted_suffixes_are_sorted(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + 1 + seed, 3000).astype(np.uint8)
    text[500:1500] = text[1600:2600]
    wanted = np.zeros(3000, bool)
    wanted[[0, 2999]] = wanted[550:700] = wanted[1650:1800] = True
    order = suffixes.suffix_array(text, 64, wanted)
    full = suffixes.suffix_array(text, 64)
    assert order[wanted[order]].tolist() == full[wanted[full]].tolist()
    needed = suffixes.reached(wanted, suffixes.smaller_than_next(text))
    assert sorted(order.tolist()) == np.flatnonzero(needed).tolist()
    assert len(order) == 3000 if seed == 0 else len(order) < 400


def test_ties_that_stay_equal_are_not_moved(monkeypatch):
    """Copies of a passage are equal at every further word: no round sorts them again."""
    passage = np.random.default_rng(1).integers(97, 123, 500)
    text = np.concatenate([passage, [65], passage, [66], passage]).astype(np.uint8)
    wanted = np.zeros(len(text), bool)
    wanted[:101] = wanted[501:602] = wanted[1002:1103] = True

    def lexsort(keys):
        raise AssertionError(f"{len(keys[0])} suffixes sorted again")

    monkeypatch.setattr(suffixes.np, "lexsort", lexsort)
    order = suffixes.suffix_array(text, 400, wanted)
    order = order[wanted[order]]
    assert order.reshape(-1, 3).tolist() == sorted([[i, i + 501, i + 1002] for i in range(101)], key=lambda p: bytes(text[p[0] :][:400]))
    assert suffixes.neighbours_equal(order, text, 400).reshape(-1, 3).tolist() == [[False, True, True]] * 101


def test_smaller_than_next():
    text = np.frombuffer(b"mississippi", np.uint8)
    assert [bool(text[i:].tobytes() < text[i + 1 :].tobytes()) for i in range(len(text))] == suffixes.smaller_than_next(text).tolist()


def test_deep_nodes_group_equal_suffixes():
    m = np.array([[1, 2], [2, 1], [1, 2], [1, 3]])
    node = subtrees.deep_nodes(m)
    assert node[0] == node[2] and len(set(node.tolist())) == 3
