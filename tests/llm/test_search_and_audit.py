"""Ranked search against a plain scorer, and the audit of sources against plain sums."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from issuelens.llm import divergence, ranked_search

DOCS = "doc_id bigint, text string, lang string, source string"
ITEMS = "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text, pattern=TERM):
    return pattern.findall((text or "").translate(LOWER))


def texts(draw, n):
    words = [f"w{draw.randrange(40)}" for _ in range(60)] + ["é", "日本", "ÉA", "It's", "x_y", "--", "\x00", "C3po"]
    return [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 60))) for _ in range(n)]


def scores(docs, items):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    big_n = sum(bool(c) for _, c in counts)
    big_l = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, c in counts:
            n = sum(c.values())
            if n:
                m = 25 + 75 * n * big_n // big_l
                found.append((-sum(k * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                                   * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t]),
                              i is None, i))
        found = sorted((f for f in found if f[0] < 0), key=lambda f: (f[0], f[1], f[2] or 0))[:10]
        rows += [(item, place, i, -score) for place, (score, _, i) in enumerate(found, 1)]
    return rows


def ranked(spark, docs, items):
    frame = spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS).withColumnRenamed("lang", "score")
    asked = spark.createDataFrame(items, ITEMS).withColumn("slot", F.lit(1))
    return [tuple(r) for r in ranked_search.ranked(frame.repartition(3), asked).collect()]


def by_text(rows):
    return sorted(rows, key=repr)


def test_ranks_equal_plain_scores(spark):
    draw = random.Random(2)
    docs = list(enumerate(texts(draw, 120)))
    docs += [(i + 200, t) for i, t in docs[:40]] + [(None, docs[3][1]), (None, None), (7, docs[5][1]), (400, ""), (401, "-- ..")]
    docs += [(500 + i, docs[0][1]) for i in range(60)] + [(600, "w1 " * 400_000 + "w2")]
    items = list(enumerate(texts(draw, 25)))
    items += [(90, None), (91, ""), (92, "--"), (93, "nowhere"), (94, "w1 " * 300 + "w2"), (None, "w3 w4"), (5, "w3 w4"), (5, "w3 w4")]
    assert by_text(ranked(spark, docs, items)) == by_text(scores(docs, items))


def test_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 300)
    draw = random.Random(4)
    docs, items = list(enumerate(texts(draw, 50))), list(enumerate(texts(draw, 12)))
    assert by_text(ranked(spark, docs, items)) == by_text(scores(docs, items))


def test_search_of_nothing(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == []
    assert ranked(spark, [(1, None)], [(1, "a")]) == [] and ranked(spark, [(1, "b")], [(1, None)]) == []


def test_shared_pairs_are_summed_once():
    draw = random.Random(6)
    sequences = [sorted(draw.sample(range(30), draw.randrange(0, 20))) for _ in range(40)]
    pairs, rests = ranked_search.shared_pairs(sequences, 30)
    made = {30 + i: p for i, p in enumerate(pairs)}

    def leaves(symbol):
        return [symbol] if symbol < 30 else [x for part in made[symbol] for x in leaves(part)]

    assert [[x for s in rest for x in leaves(s)] for rest in rests] == sequences
    assert pairs and len(pairs) + sum(map(len, rests)) < sum(map(len, sequences))
    used = Counter(s for rest in rests for s in rest) + Counter(s for p in pairs for s in p)
    assert all(used[s] >= 2 for s in made)
    left = Counter(p for rest in rests for p in zip(rest, rest[1:]))
    assert not left or max(left.values()) == 1


def test_a_long_text_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(ranked_search, "PIECE_BYTES", 10)
    text = "Ab cd12 É-x " * 9 + "y" * 50 + " z"
    assert [t.decode() for piece in ranked_search.term_pieces(text.encode()) for t in piece] == terms(text)


def audited(docs, listed=200):
    """The audit by plain sums."""
    own = [(lang or "", source or "", terms(text, LETTER)) for _, text, lang, source in docs]
    rows = []
    for lang in {lang for lang, _, _ in own}:
        df = Counter(t for la, _, words in own if la == lang for t in set(words))
        kept = [t for t in df if df[t] >= 3]
        counts = {s: Counter() for la, s, _ in own if la == lang}
        for la, s, words in own:
            if la == lang:
                counts[s].update(t for t in words if df[t] >= 3)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(-sum((share(c, t) - share(o, t))**2 // share(o, t) for t in kept), r) for r, o in counts.items() if r != s]
            rows += [(lang, s, "pair", r, -v, k) for k, (v, r) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)]
            found = [(-((share(c, t) - share(whole, t))**2 // share(whole, t)), t) for t in kept
                     if c[t] and share(c, t) > share(whole, t)]
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))[:listed]
            rows += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(found, 1)]
    return rows


def audit(spark, docs, **options):
    frame = spark.createDataFrame(docs, DOCS).withColumn("term", F.lit("x")).repartition(3)
    return [tuple(r) for r in divergence.audit(frame, **options).collect()]


@pytest.fixture
def sourced():
    draw = random.Random(8)
    docs = [(i, t, draw.choice(["en", "de", None, ""]), draw.choice(["web", "", None, "é", "a b"]))
            for i, t in enumerate(texts(draw, 90))]
    docs += [(1, None, "en", "empty"), (2, "", "xx", "one"), (3, "solo", "xx", "two"), (None, "w x y", None, None), (5, "-- 12", "en", "none")]
    return docs + [docs[4]] * 30 + [(9, "long tail " * 200_000, "en", "web")]


def test_audit_equals_plain_sums(spark, sourced):
    assert sorted(audit(spark, sourced)) == sorted(audited(sourced))


def test_audit_in_shards_and_with_few_terms_listed(spark, sourced):
    assert sorted(audit(spark, sourced, shard_terms=7, listed=5)) == sorted(audited(sourced, 5))


def test_audit_of_more_sources_than_a_tile(spark):
    draw = random.Random(9)
    many = divergence.TILE + 44
    docs = [(i, " ".join(draw.choice("abcdefghij") * 2 for _ in range(4)), "en", f"s{i % many}") for i in range(2 * many)]
    assert sorted(audit(spark, docs)) == sorted(audited(docs))


def test_audit_of_nothing(spark):
    assert audit(spark, []) == []
    assert sorted(audit(spark, [(1, None, None, None), (2, None, None, "s")])) == [
        ("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_large_counts_stay_exact(spark):
    rows = [(10**12, 3 * 10**13, 10**6), (0, 10**15, 1), (5 * 10**14, 5 * 10**14, 7)]
    frame = spark.createDataFrame(rows, "c bigint, n bigint, v bigint")
    got = [r[0] for r in frame.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]


def test_a_task_adds_up_a_source_before_its_words_are_vectors(spark):
    docs = [(i, "up up down", "en", "web") for i in range(300)] + [(1, "up", "de", "web"), (2, "down", "en", "é")]
    frame = spark.createDataFrame(docs, DOCS).coalesce(1)
    rows = divergence.tokens(divergence._source(frame, "text", "lang", "source"), 1, 3).collect()
    counted, words = Counter(), 0
    for row in rows:
        if row["kind"] == 0:
            words += len(row["words"])
            counted.update({(row["source"], word): 2**row["digit"] for word in row["words"]})
    assert counted == {("web", "up\0en"): 600, ("web", "down\0en"): 300, ("web", "up\0de"): 1, ("é", "down\0en"): 1}
    assert words == sum(n.bit_count() for n in counted.values())
    assert [sorted(r["words"]) for r in sorted(rows, key=lambda r: r["digit"]) if r["kind"] == 1] == [
        ["down\0en", "up\0de", "up\0en"], ["down\0en", "up\0en"], ["down\0en", "up\0en"]]


def test_what_a_task_holds_stays_bounded_and_exact(monkeypatch):
    draw = random.Random(10)
    docs = [(" ".join(draw.choice(["a", "bé", "ccc"]) for _ in range(draw.randrange(9))), draw.choice(["x", "y"])) for _ in range(200)]
    expected = Counter((s, t + "\0en") for text, s in docs for t in terms(text, LETTER))
    for limit, value in (("HELD_ENTRIES", 4), ("HELD_BYTES", 20), ("HELD_WORDS", 2), ("ROW_WORDS", 1), ("HELD_WORDS", 1 << 20)):
        with monkeypatch.context() as patched:
            patched.setattr(divergence, limit, value)
            got, held = Counter(), divergence._Held()
            for k in range(0, len(docs), 7):
                some = docs[k:k + 7]
                batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    ["en"] * len(some), [s for _, s in some], [t for t, _ in some])], names=["lang", "source", "text"])
                batches = []
                for part in divergence._by_lang(batch):
                    held.add(*part)
                    if held.full():
                        batches, held = list(held.rows(3, 3)), divergence._Held()
                for row in (r for b in (*batches, *(held.rows(3, 3) if k + 7 >= len(docs) else ())) for r in b.to_pylist()):
                    assert len(row["words"]) <= divergence.ROW_WORDS
                    if row["kind"] == 0:
                        got.update({(row["source"], word): 2**row["digit"] for word in row["words"]})
            assert got == expected


def test_models_join_small_shards_and_part_large_ones(spark):
    words = {0: 3, 1: 3, 2: 30, 3: 2, 5: 4}
    frame = spark.createDataFrame([(k, 1, 0, [f"w{k}-{i}" for i in range(n)]) for k, n in words.items()],
                                  "shard int, kind int, digit int, words array<string>")
    got = divergence.models(frame, 10)
    assert [(own, part) for own, _, part in got] == [([0, 1], 0), ([2], 0), ([2], 1), ([2], 2), ([3, 5], 0)]
    assert {parts for own, parts, _ in got if own == [2]} == {3}


def test_audit_of_a_lang_that_holds_the_separator(spark):
    docs = [(i, t, lang, s) for i, (t, lang, s) in enumerate([("a b", "x\0y", "p"), ("a c", "x\0y", "q"), ("a b b", "x\0y", "q"),
                                                              ("b d", "y", "p"), ("b", "y", "q"), ("b", "y", "q")])]
    assert sorted(audit(spark, docs)) == sorted(audited(docs))
