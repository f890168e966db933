"""Line, word-window and byte-string dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from cases import SCHEMA, WORD, corpus, rows

from issuelens.llm import line_dedup, substring_dedup, suffix_dedup

SHUFFLED = corpus()


def covered(n, starts, length):
    gone = [False] * n
    for i in starts:
        for j in range(i, i + length):
            gone[j] = True
    return gone


@pytest.fixture(scope="module")
def docs(spark):
    data = rows(SHUFFLED) + [(None, SHUFFLED[0], "x", "y", 1), (3, SHUFFLED[3], "en", "web", 5)]
    frame = spark.createDataFrame(data, SCHEMA).withColumnRenamed("lang", "slot").withColumnRenamed("source", "row")
    return frame.repartition(5).cache()


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize(("length", "start"), [(13, 7), (5, 1), (6, 6), (12, 2)])
def test_word_windows(docs, length, start):
    data = texts(docs)
    first = {}
    for i, text in data:
        words = WORD.findall(text or "")
        for k in range(len(words) - length + 1):
            key = tuple(words[k:k + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    expected = Counter()
    for i, text in data:
        words = WORD.findall(text or "")
        gone = covered(len(words), [k for k in range(len(words) - length + 1) if i is not None
                                    and first[tuple(words[k:k + length])] < i], length)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        expected[i, len(words), sum(gone), kept] += 1
    got = substring_dedup.dedup(docs, length, start).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == expected
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


@pytest.mark.parametrize(("length", "large"), [(200, 64), (40, 64), (40, 1), (25, 5)])
def test_byte_strings(docs, length, large):
    data = [(i, (t or "").encode()) for i, t in texts(docs)]
    seen = Counter(b[k:k + length] for _, b in data for k in range(len(b) - length + 1))
    expected = Counter()
    for i, b in data:
        gone = [False] * len(b)
        end = 0
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[max(k, end):k + length] = [True] * (k + length - max(k, end))
                end = k + length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected[i, len(b), spans, kept] += 1
    got = suffix_dedup.dedup(docs, length, large).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.removed), bytes(r.kept)) for r in got) == expected


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_runs(docs, run):
    data = texts(docs)
    lines = [(i, (t or "").split("\n")) for i, t in data]
    places = {}
    for i, own in lines:
        for k in range(len(own) - run + 1):
            key = tuple(own[k:k + run])
            if i is not None and any(WORD.search(x) for x in key):
                places[key] = min(places.get(key, (i, k)), (i, k))
    expected = Counter()
    for (i, own), (_, text) in zip(lines, data):
        starts = [k for k in range(len(own) - run + 1) if i is not None
                  and (i, k) > places.get(tuple(own[k:k + run]), (i, k))]
        gone = covered(len(own), starts, run)
        kept = "\n".join(x for x, g in zip(own, gone) if not g)
        expected[i, len(own), sum(gone), None if text is None else kept] += 1
    got = line_dedup.dedup(docs, run, carry=("slot", "n_chars")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == expected
    assert {r.slot for r in got} == {"en", "x"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.word_digests(none).count() == 0
    assert suffix_dedup.byte_digests(none).count() == 0
    assert line_dedup.line_digests(none).count() == 0


def test_digests_of_nothing_left(spark):
    empty = hashlib.sha256(b"").hexdigest()
    docs = spark.createDataFrame(rows([None, ""]), SCHEMA)
    for query in (substring_dedup.word_digests, suffix_dedup.byte_digests, line_dedup.line_digests):
        assert {r.kept_sha256 for r in query(docs).collect()} == {empty}


def test_hash_collisions_are_verified_on_the_bytes():
    import numpy as np

    data = np.frombuffer(b"abcdefghij" * 3 + b"abcdeXghij", np.uint8)
    suffixes = suffix_dedup.Suffixes(data)
    i, j = np.array([0, 0]), np.array([10, 30])
    assert suffixes.verified(i, j, np.array([10, 10])).tolist() == [True, False]
    assert suffix_dedup._exact(data, 4, 34, 6, 4) == (1, 4)


def test_suffixes_are_sorted_within_their_groups():
    import numpy as np

    draw = np.random.default_rng(1)
    data = draw.integers(97, 99, 4000).astype(np.uint8)
    at = draw.integers(0, 3900, 300)
    size = draw.integers(1, 100, 300)
    group = np.sort(draw.integers(0, 12, 300)).astype(np.uint64)
    order = suffix_dedup.Suffixes(data).sort(group, at, size)
    found = [(int(group[k]), data[at[k]:at[k] + size[k]].tobytes()) for k in order]
    assert found == sorted(found)
