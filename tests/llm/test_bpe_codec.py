from __future__ import annotations

import hashlib
import random

import pytest

from tastemill.llm import bpe_codec as B


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


def _texts():
    rnd = random.Random(5)
    letters = ["ab", "the", " ", "  ", "\n", "'s", "'ll", "'", "!", "##", "7", "é", "漢", "🙂", "\t", " ", "x" * 40, " " * 30, "<|endoftext|>", "aaaa", "ñ", "\r\n", "don't"]
    return [
        "", "a", " ", "<|endoftext|>", "a" * 5000, " " * 5000, "'" * 3000, "ab" * 4000, "7" * 3000, "é" * 2500, "\n" * 999 + "x",
        *("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 400))) for _ in range(120)),
        *("".join(rnd.choice("abcdefgh'st! ") for _ in range(3000)) for _ in range(10)),
        *("".join(rnd.choice("abcde") for _ in range(3000)) for _ in range(10)),
    ]


@pytest.mark.parametrize("leaf", [7, 16, 61, 1000, B.LEAF])
def test_encode_equals_library_at_any_leaf_size(library, leaf):
    c = B.Codec(B.vocabulary_path(), leaf=leaf)
    for text in _texts():
        ids = c.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, (leaf, text[:80])
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_rows(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (5, "long " * 9000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, B.digests(docs).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = {r.doc_id: r.text for r in B.decode_column(B.encode_column(docs)).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert B.digests(docs.limit(0)).count() == 0
