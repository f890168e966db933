"""Byte-level BPE and packing against the tokenizers' own libraries."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import SCHEMA, corpus, rows
from tokenizers import Tokenizer

from issuelens.llm import bpe, packing

HARD = ["  a  b\n\n c\x1c\x1d d\x85e  f's 'S it's we'll I'VE 123 45,6 ́x é   zz 　\n", "日本語 テスト 👩‍👩‍👧 ",
        "\t\tfoo()\r\n  bar", "İstanbul ΣΑΣ ſ K Å <|endoftext|>x a<|endoftext|>b", "½ ª º µ ß ÿ × ÷",
        " " * 300, "don't\x00\x01 x\x0b\x0cy \"quoted\" $%^&*()_+ 1a2b", " 's'", "x\x1fy", "Aÿ'S÷'ll"]


@pytest.fixture(scope="module")
def texts():
    return HARD + corpus()


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_are_those_of_the_rank_library(spark, texts, reference):
    docs = spark.createDataFrame(rows(texts), SCHEMA).withColumnRenamed("lang", "ids")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        assert np.frombuffer(got[i].ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(got[i].decoded) == text.encode()
        assert got[i].source == "web"


def test_random_bytes_of_all_kinds_round_trip(reference):
    draw = np.random.default_rng(3)
    own = bpe.Codec()
    for _ in range(200):
        text = "".join(chr(c) for c in draw.integers(1, 0x2FFF, draw.integers(1, 60)))
        ids = np.frombuffer(own.encode([text])[0], "<u4")
        assert ids.tolist() == reference.encode_ordinary(text)
        assert own.decode(ids).tobytes() == text.encode()


def test_pieces_are_binary_gapless_and_of_one_document(spark, texts):
    docs = spark.createDataFrame(rows(texts) + rows(["repeated"] * 2, 9000), SCHEMA)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.piece_digests(docs).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.offset == 0 and p.length & (p.length - 1) == 0 and p.length <= 2048 for p in pieces)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        at = 0
        for p in own:
            assert p.start == at
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        lengths = [p.length for p in own if p.length < 2048]
        assert lengths == sorted(set(lengths), reverse=True)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "two words", "x", None, 9)], SCHEMA)
    assert sorted(p.doc_tokens for p in packing.pack(docs).collect())[0] == 1
    assert {r.n_tokens for r in bpe.token_digests(docs).collect()} == {0, 2}
    assert packing.pack(docs.limit(0)).count() == 0
    assert bpe.token_digests(docs.limit(0)).count() == 0


def test_a_length_that_is_no_power_of_two_is_refused(spark):
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(spark.createDataFrame([], SCHEMA), max_length=1000)
