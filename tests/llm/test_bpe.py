import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from portolan.llm import bpe
from portolan.llm.common import table

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def expected(rows):
    out = []
    for doc_id, text in rows:
        ids = ENCODING.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(docs):
    df = bpe.digest(bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS))
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_table_equals_the_tokenizer_library(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("chars", [8_000_000, 300])
def test_odd_texts(documents, monkeypatch, chars):
    rows = [
        (1, None), (2, ""), (3, " "), (4, "\n\n  x\t 　y\x1c z\x85"), (5, "I've don't 'S we'LL"), (6, "½ ² Ⅷ 一二 ١٢٣ x_y-z"), (7, "日本語 👩‍👩‍👧 ḁ̊"),
        (8, "a" * 5000), (8, "a" * 5000), (9, " " * 3000 + "x"), (None, "no id"), (10, "the " * 30_000), (11, "​‍﻿­"), (12, "<|endoftext|>"),
    ]
    df = documents(rows, extra=("block", "word", "codes", "ids"))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
    monkeypatch.setattr(bpe, "CHUNK_TOKENS", chars)
    assert got(df) == expected(rows)
    assert got(df.limit(0)) == []


def test_splitter_equals_the_pattern():
    rnd = random.Random(1)
    exact = regex.compile(public_tokenizers.PATTERN)
    for _ in range(300):
        text = "".join(rnd.choice([" ", "  ", "\n", "é", "ß", "7", "٣", "'s", "_", ".", "a", "B", "\t", "\xa0", "ñ", "中", "½"]) for _ in range(40))
        assert bpe.pre_tokens(text, public_tokenizers.PATTERN) == exact.findall(text)
        assert bpe.pre_tokens(text + "𝒳😀𐍈", public_tokenizers.PATTERN) == exact.findall(text + "𝒳😀𐍈")


def test_merge_equals_the_tokenizer_library():
    rnd = random.Random(2)
    for _ in range(500):
        word = "".join(rnd.choice("abcdetionshr éñß中") for _ in range(rnd.randrange(1, 60))).encode()
        assert bpe.merge(word, RANKS) == ENCODING._encode_single_piece(word)


def test_pack_round_trip():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert bpe.unpack(bpe.pack(numbers)).tolist() == numbers.tolist()
    assert bpe.unpack(bpe.pack(numbers[:0])).tolist() == []
