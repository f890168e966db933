"""Secret scans against regular expressions, the classifier on held-out labels, the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import secrets as tokens
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from cases import SCHEMA, corpus, rows

import corpus_pipeline
from issuelens.llm import quality, secret_scan

KEY = "AKIA" + "Q7" * 10
TEXTS = [
    "password = 'hunter22' and Token:abc", "api_key=AKIA" + "A1" * 9 + " x", "secret: token=token:abcdefgh",
    "deadbeef" * 4 + " é日本 👩 passwd=\"s3cr3t.value\" " + KEY, "token=token=abcdef; APIKEY : abcdefg",
    None, "", "f" * 23, "f" * 24 + "g" + "0" * 30, "AKIAAKIA" + "Z" * 12 + " AKIA1", "plain words only " * 5,
    "passwordſ=abcdefg toKen=abcdef", "k " * 400 + "secret=" + "0123456789abcdef" * 3, "password=a secret=bcdefgh",
]


def base(text):
    text = text or ""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                    for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_pattern_spans(spark):
    many = " ".join(f"token=abc{i:06d}" for i in range(700))
    texts = [*TEXTS, many, *corpus()]
    docs = spark.createDataFrame(rows(texts), SCHEMA).withColumnRenamed("lang", "spans").repartition(3)
    got = {r.doc_id: r for r in secret_scan.span_digests(docs).collect()}
    for i, text in enumerate(texts):
        own = base(text)
        listed = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in own)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(
            sum(k == kind for _, k, _ in own) for kind in range(3))
        assert not own or set(listed.split(",")) <= set(got[i].spans.split(","))


def test_random_strings_are_told_from_identifiers(spark):
    ordinary = ["international_configuration_manager", "experimentalFeatureDescription", "organisation-of-the-states",
                "understandingcommunication", "documentation/reference/installation"] * 4
    docs = [f"{w} {v} more words" for w, v in zip(ordinary, reversed(ordinary))]
    docs += [f"secret={tokens.token_urlsafe(24)} password={tokens.token_urlsafe(30)}" for _ in range(60)]
    frame = spark.createDataFrame(rows(docs), SCHEMA)
    ratios = secret_scan.train(frame)
    assert len(ratios) == len(secret_scan.ALPHABET) ** 2
    strings = [tokens.token_urlsafe(30) for _ in range(40)]
    test = spark.createDataFrame(rows([f"see {s} there" for s in strings] + ordinary), SCHEMA)
    found = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secret_scan.scan(test, ratios=ratios).collect()}
    assert sum(bool(found[i]) for i in range(40)) >= 36
    assert not any(found[i] for i in range(40, len(found)))


def test_a_page_of_keys_takes_seconds(spark):
    many = " ".join(f"token=abc{i:06d}" for i in range(50_000))
    keys = " ".join("k" + tokens.token_hex(15).upper() + "q" for _ in range(2000))
    docs = spark.createDataFrame(rows([many, keys + " " + many[:4000] + " " + keys]), SCHEMA)
    ratios = [1.0] * len(secret_scan.ALPHABET) ** 2
    began = time.time()
    first, second = secret_scan.scan(docs, ratios=ratios).orderBy("doc_id").collect()
    assert len(first.spans) == 50_000 and [(s.start, s.end) for s in first.spans[::9999]] == [
        (16 * i, 16 * i + 15) for i in range(0, 50_000, 9999)]
    assert sum(s.kind == 3 for s in second.spans) == 4000
    masked = secret_scan.mask(docs, ratios=ratios).orderBy("doc_id").first().text
    assert masked == " ".join([secret_scan.MASK] * 50_000)
    assert time.time() - began < 60


def test_free_spans_meet_no_pattern(spark):
    draw = random.Random(1)
    cases = []
    for _ in range(60):
        spans = sorted((s := draw.randrange(300), k, s + draw.randrange(1, 60)) for k in (0, 1, 2) for _ in range(draw.randrange(4)))
        cases.append((spans, sorted((s := draw.randrange(300), 3, s + draw.randrange(1, 30)) for _ in range(draw.randrange(9)))))
    kind = "array<struct<start:int,kind:int,end:int>>"
    frame = spark.createDataFrame(cases, f"base {kind}, spans {kind}")
    got = frame.select("base", "spans", secret_scan._outside(F.col("spans"), F.col("base")).alias("free"),
                       secret_scan._furthest(F.col("base")).alias("before")).collect()
    for r in got:
        assert r.free == [x for x in r.spans if not any(b.start < x.end and x.start < b.end for b in r.base)]
        assert r.before == [max([0, *(b.end for b in r.base[:i])]) for i in range(len(r.base))]


def test_masks(spark):
    docs = spark.createDataFrame(rows(TEXTS), SCHEMA)
    ratios = [0.0] * len(secret_scan.ALPHABET) ** 2
    got = {r.doc_id: r.text for r in secret_scan.mask(docs, ratios=ratios).collect()}
    for i, text in enumerate(TEXTS):
        parts, done = [], 0
        for start, _, end in base(text):
            if start >= done:
                parts += [text[done:start], secret_scan.MASK]
            done = max(done, end)
        assert got[i] == (text if text is None else "".join(parts) + text[done:])


def test_scans_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert secret_scan.span_digests(docs).count() == 0


def machine(width, factors, seed=3):
    draw = np.random.default_rng(seed)
    return quality.Machine(0.3, draw.normal(size=width), draw.normal(size=(width, factors)))


def test_the_score_equals_all_pairs():
    model, x = machine(9, 4), np.random.default_rng(1).normal(size=(6, 9))
    for row, logit in zip(x, model.logits(x)):
        pairs = sum(row[i] * row[j] * float(model.factors[i] @ model.factors[j]) for i in range(9) for j in range(i))
        assert np.isclose(logit, model.bias + row @ model.linear + pairs)


def test_gradients_equal_differences():
    model, draw = machine(7, 3), np.random.default_rng(2)
    x, labels = draw.normal(size=(5, 7)), np.array([0, 1, 1, 0, 1.0])

    def loss():
        p = model.scores(x)
        own = -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()
        return own + quality.DECAY / 2 * ((model.linear**2).sum() + (model.factors**2).sum())

    bias, linear, factors = quality.gradients(model, x, labels)
    for weights, slopes in ((model.linear, linear), (model.factors, factors)):
        for at in np.ndindex(weights.shape):
            before, values = weights[at], []
            for change in (1e-5, -1e-5):
                weights[at] = before + change
                values.append(loss())
            weights[at] = before
            assert np.isclose(slopes[at], (values[0] - values[1]) / 2e-5, atol=1e-6)
    before = model.bias
    model.bias = before + 1e-5
    up = loss()
    model.bias = before - 1e-5
    assert np.isclose(bias, (up - loss()) / 2e-5, atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels)
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.93 * len(held)


def test_labels_and_places_are_no_inputs(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    plain = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    other = docs.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang", "source AS quality", "n_chars")
    assert {r.doc_id - 1: r.score for r in quality.score(other, model).collect()} == plain


def test_scores_of_odd_texts(spark):
    data = rows([None, "", "word", "x" * 300_000, "a\nb\n\n", "same", "same"]) + [(None, "text", None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA).withColumnRenamed("source", "score")
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1), (1, 0)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    none = quality.score(docs, quality.train(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.withColumn("source", docs.lang).limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    from issuelens.session import staged

    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(staged(stage(spark, docs[-1], sf), name))
    return docs


def test_stages_keep_the_columns_and_take_effect(spark, stages):
    first, judged, cut, single, masked, packed = stages
    for stage in (judged, cut, single, masked):
        assert stage.dtypes == first.dtypes
    assert 0 < judged.count() < first.count()
    assert cut.count() == judged.count()
    assert single.count() < cut.count()
    assert masked.count() == single.count()
    for row in masked.collect():
        assert not [s for s in base(row.text) if secret_scan.MASK not in row.text[s[0]:s[2]]]
        assert row.n_chars == len(row.text)
    ids = Counter(r.doc_id for r in packed.select("doc_id").distinct().collect())
    assert set(ids) == {r.doc_id for r in masked.collect()}


def test_the_registered_run_gives_the_last_stage(spark, stages):
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, run.collect())) == sorted(map(key, stages[-1].collect()))


def test_the_pipeline_cuts_lone_lines(spark):
    texts = ["first\nrepeats alone\nlast", "other\nrepeats alone\nmore", "repeats alone", "a whole text", "a whole text",
             "before\na whole text", "\n\nx"]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    cut = corpus_pipeline.line_runs(spark, docs, "")
    assert [r.text for r in cut.orderBy("doc_id").collect()] == [
        texts[0], "other\nmore", "", "a whole text", "a whole text", "before", "\n\nx"]
    left = corpus_pipeline.near_duplicates(spark, cut, "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 5, 6]


def test_the_pipeline_takes_awkward_rows(spark, tmp_path):
    data = rows([None, "", " ", "a", "same words in a row here", "same words in a row here", "x\n" * 5000])
    data += [(None, "no id at all", None, None, None), (4, "same words in a row here", None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA + "").withColumnRenamed("lang", "n_removed").withColumnRenamed(
        "source", "slot")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkey = quality.THRESHOLD
    try:
        quality.THRESHOLD = 0.5
        packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        quality.THRESHOLD = monkey
    assert {r.doc_id for r in packed} == {0, 1, 2, 3, 4, 6, None}
