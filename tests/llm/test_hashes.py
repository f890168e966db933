"""Unequal words and lines stay apart, also those that polynomial hashes confuse."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from cases import SCHEMA, rows

from issuelens.llm import bytetext, line_dedup, minhash_dedup, substring_dedup


def thue_morse(n, letters="ab"):
    """A string and its complement that agree under any polynomial modulo 2^64 of an odd base, once long enough."""
    word = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def hashed(words, seed=0):
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return bytetext.word_hashes(data, np.concatenate([[0], ends[:-1]]), ends, seed)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterns_do_not_collide(n):
    one, other = thue_morse(n)
    assert len(set(hashed([one, other]).tolist())) == 2


def test_hashes_follow_the_bytes_alone():
    words = ["", "a", "b", "ab", "a\0", "12345678", "123456789", "x" * 8, "x" * 16, "x" * 17, "é日本", "a" * 3_000_000]
    one, again = hashed(words), hashed(["pad", *words, *words])
    assert (again[1:1 + len(words)] == one).all() and (again[1 + len(words):] == one).all()
    assert len(set(one.tolist())) == len(words)
    assert not (hashed(words, seed=1) == one).any()
    many = [f"{i:x}" for i in range(200_000)]
    found = hashed(many)
    assert len(set(found.tolist())) == len(many)
    assert abs(np.unpackbits(found.view(np.uint8)).mean() - 0.5) < 0.001


@pytest.mark.parametrize("run", [1, 2])
def test_lines_that_differ_stay(spark, run):
    one, other = thue_morse(2048)
    texts = ["\n".join([one] * run), "\n".join([other] * run), "\n".join([one] * run)]
    got = line_dedup.dedup(spark.createDataFrame(rows(texts), SCHEMA), run=run).orderBy("doc_id").collect()
    # inside one text, a line that repeats goes as well
    assert got[1].text.split("\n")[0] == other and got[2].text == ""


def test_words_that_differ_stay(spark):
    one, other = thue_morse(2048)
    common = " ".join(f"w{i}" for i in range(12))
    texts = [f"{common} {one}", f"{common} {other}", f"{common} {one}"]
    got = substring_dedup.word_digests(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 0, 13]
    assert got[1].kept_sha256 == hashlib.sha256(texts[1].encode()).hexdigest()


def test_documents_without_a_common_word_are_not_linked(spark):
    one, other = thue_morse(2048)
    texts = [f"{one} {one} {one}", f"{other} {other} {other}", f"{one} {one} {one}"]
    got = minhash_dedup.group_rows(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 1, 0]
