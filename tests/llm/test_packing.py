import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from portolan.llm import packing, queries
from portolan.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, pieces):
    """Every id of every document is in one piece, sequences are pieces, lengths are powers of two."""
    by_doc = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.length & (p.length - 1) == 0 and p.offset == 0
        by_doc[p.doc_id].append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for doc_id, texts in texts_by_id(rows).items():
        want = Counter()
        for text in texts:
            ids, at = ids_of(text), 0
            sizes = [1024] * (len(ids) // 1024) + [1 << i for i in range(9, -1, -1) if len(ids) % 1024 >> i & 1]
            for size in sizes:
                want[at, len(ids), tuple(ids[at : at + size])] += 1
                at += size
        assert Counter((p.start, p.doc_tokens, tuple(p.ids)) for p in by_doc.pop(doc_id)) == want
    assert not by_doc


def texts_by_id(rows):
    out = defaultdict(list)
    for doc_id, text in rows:
        out[doc_id].append(text)
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n\n  x\t 　y\x1c z\x85 \x1f \x00"), (5, "I've don't 'S we'LL <|endoftext|>"), (6, "½ ² Ⅷ 一二 ١٢٣ x_y-z"), (7, "日本語 👩‍👩‍👧 ḁ̊"),
    (8, "a" * 5000), (8, "a" * 5000), (9, " " * 3000 + "x"), (None, "no id"), (None, None), (10, "the quick fox  \n jumps " * 9_000), (11, "​﻿\xad"),
    (12, "new \U00013460\U000143fa letters1 \U000143fb"), (13, "x" * 40 + "\n" * 700), (2**62, "far"),
]


@pytest.mark.parametrize("chars, span, words", [(4_000_000, 1_000_000, 500_000), (300, 50, 20)])
def test_odd_texts(documents, monkeypatch, tmp_path, chars, span, words):
    monkeypatch.setattr(packing, "BLOCK_CHARS", chars)
    monkeypatch.setattr(packing, "SPAN_CHARS", span)
    monkeypatch.setattr(packing, "KNOWN_WORDS", words)
    df = documents(ODD, extra=("ids", "length", "start", "sequence_id"))
    packed = packing.pack(df, PATH, path=str(tmp_path / "out"))
    assert packed.columns == ["doc_id", "start", "doc_tokens", "ids", "crc32", "sequence_id", "offset", "length"]
    check(ODD, packed.collect())
    assert packing.digest(packing.pack(df.limit(0), PATH)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, PATH, max_tokens=1000)


def test_table_and_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, PATH)
    rows = packed.collect()
    check([(r.doc_id, r.text) for r in docs.collect()], rows)
    want = Counter((r.doc_id, r.start, r.length, zlib.crc32(np.array(r.ids, "<u4").tobytes()), r.doc_tokens, r.sequence_id, r.offset) for r in rows)
    digest = packing.digest(packed)
    assert dict(digest.dtypes) == dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint")
    assert Counter(tuple(r) for r in digest.collect()) == want
    query = queries.op12_pack_sequences(spark, sf_dir)
    found = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in query.collect())
    assert found == Counter(r[:5] for r in want.elements())


def test_words_are_spelled_together():
    """Words mapped in one go have the letters, and the model's ids, that each word has by itself."""
    words = ["", " the", "\x00\x7f\xad", "ÿ", " ÿÿ", "\n\n", "日本", "👩‍👩", *map(chr, range(0x180))]
    alone = [w.encode().decode("latin-1").translate(packing.ALPHABET) for w in words]
    assert packing.spelled(words) == alone and packing.spelled([]) == [] and packing.spelled([""]) == [""]
    assert len(set("".join(packing.spelled(list(map(chr, range(0x80))))))) == 0x80
    encoder = packing.Encoder(LIBRARY.to_str(), public_tokenizers.PATTERN)
    texts = [w for w in words if w]
    assert [x.tolist() + [0] for x in encoder.encode(texts)] == [ids_of(t) for t in texts]


def test_one_folder_per_length(documents, tmp_path):
    text = "word " * 1500
    packing.pack(documents([(1, text), (2, None)]), PATH, path=str(tmp_path / "out"), max_tokens=256)
    tokens = len(ids_of(text))
    lengths = {256, 1} | {1 << i for i in range(8) if tokens >> i & 1}
    assert {p.name for p in (tmp_path / "out").glob("length=*")} == {f"length={n}" for n in lengths}


@pytest.mark.parametrize("most", [1, 2, 1024])
def test_decompose(most):
    lengths = np.arange(1, 3000)
    document, sizes = packing.decompose(lengths, most)
    assert np.bincount(document, weights=sizes).astype(int).tolist() == lengths.tolist()
    assert (sizes & (sizes - 1) == 0).all() and sizes.max() <= most
    assert (np.diff(sizes)[np.diff(document) == 0] <= 0).all()


def test_classes_of_known_characters_equal_the_library():
    """Pre-tokens around every assigned character of the first plane; unassigned ones never take this way."""
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co") and not 0xAC00 <= c < 0xD7A0]
    for a in range(0, len(chars), 500):
        text = "".join(f"a{c}1." for c in chars[a : a + 500])
        want = [text[i:j] for _, (i, j) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert packing.pre_tokens(text, public_tokenizers.PATTERN) == want
