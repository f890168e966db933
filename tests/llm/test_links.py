"""Near-duplicate groups and nearest vectors against brute force."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, WORD, components, corpus, rows

from issuelens.llm import embedding_dedup, minhash_dedup, topk
from issuelens.llm.components import components as connected
from issuelens.session import checkpoint_root


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def variants(n=150):
    """A large group of near copies, some of them linked only through others."""
    draw = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randrange(0, 9)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("shingle", "similarity"), [(3, 0.85), (5, 0.8)])
@pytest.mark.parametrize("small", [False, True])
def test_groups(spark, monkeypatch, shingle, similarity, small):
    if small:
        for name, value in (("SMALL", 3), ("CHUNK", 16), ("LEADERS", 2), ("DEPTH", 3)):
            monkeypatch.setattr(minhash_dedup, name, value)
    texts = corpus() + variants()
    docs = spark.createDataFrame(rows(texts) + [(None, texts[0], "x", "y", 1)], SCHEMA).repartition(4)
    sets = {i: shingles(t, shingle) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= round(100 * similarity) * len(sets[a] | sets[b])]
    expected = components(sets, links)
    _, named = minhash_dedup.groups(docs, shingle, similarity)
    got = named.collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == Counter(
        (i, len(sets[i]), expected[i], expected[i] == i) for i in sets)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_one_of_each_group_stays_with_all_its_columns(spark):
    data = rows(["one two three four five six seven"] * 3 + [None, "", "other words stand here"]) + [
        (0, "one two three four five six seven", "de", "again", 3), (None, "nothing known", None, None, None)]
    docs = spark.createDataFrame(data, SCHEMA).withColumnRenamed("source", "row").coalesce(1)
    got = minhash_dedup.representatives(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["0", "3", "4", "5", "None"]
    assert {r.row for r in got if r.doc_id == 0} == {"web"}
    assert minhash_dedup.representatives(docs.limit(0)).columns == docs.columns


def test_what_meets_a_family_by_chance_is_not_tied_to_it(spark):
    draw = np.random.default_rng(4)
    families = [draw.integers(0, 2**31, 48) for _ in range(2)]
    signatures = []
    for family in families:
        for _ in range(80):
            own = family.copy()
            own[draw.integers(0, 48, 4)] = draw.integers(0, 2**31, 4)
            signatures.append(own)
    for _ in range(60):  # these share a token with each of the two
        own = draw.integers(0, 2**31, 48)
        own[0], own[1] = families[0][0], families[1][1]
        signatures.append(own)
    classes = spark.createDataFrame(
        [(i, i, [int(t) for t in own]) for i, own in enumerate(signatures)], "row bigint, doc_id bigint, tokens array<int>")
    got = dict(minhash_dedup._clusters(classes, 0.85).collect())
    assert got == {**{i: 0 for i in range(1, 80)}, **{i: 80 for i in range(81, 160)}}


def test_a_last_node_is_compared_like_a_small_one(monkeypatch):
    draw = np.random.default_rng(6)
    base = draw.integers(0, 2**31, (4, 48)).astype(np.int32)
    tokens = base[draw.integers(0, 4, 90)]
    for own in tokens:
        own[draw.integers(0, 48, 12)] = draw.integers(0, 2**31, 12)
    ids = draw.permutation(90)
    table = pa.table({"path": pa.array([7] * 90), "doc_id": pa.array(ids),
                      "tokens": pa.array(tokens.tolist(), pa.list_(pa.int32()))})
    monkeypatch.setattr(minhash_dedup, "COMPARED", 48 * 90 * 7)
    one, other = (f(table, 27).to_pydict() for f in (minhash_dedup._compared_node, minhash_dedup._compared_nodes))
    assert sorted(zip(one["a"], one["b"])) == sorted(zip(other["a"], other["b"])) != []


def test_sets_that_many_places_want_are_put_into_several_arrays(monkeypatch):
    texts = ["one two three four", "five six seven", "", "eight nine ten eleven twelve"]
    documents = pa.table({"slot": pa.array([0] * 4), "row": pa.array(range(4)), "doc_id": pa.array(range(4)),
                          "text": pa.array(texts)})
    wanted = pa.table({"row": pa.array([3, 0, 1, 0, 2, 3, 3]), "group": pa.array(range(7))})
    whole = minhash_dedup._shipped(documents, wanted, 3)
    monkeypatch.setattr(minhash_dedup, "ARRAY_BYTES", 24)
    parts = minhash_dedup._shipped(documents, wanted, 3)
    assert parts.column("hashes").num_chunks > whole.column("hashes").num_chunks == 1
    assert parts.combine_chunks().equals(whole.combine_chunks()) and sorted(whole.column("group").to_pylist()) == [*range(7)]


def test_trees_reach_the_recall():
    assert minhash_dedup.trees(0.85) <= minhash_dedup.trees(0.8) <= minhash_dedup.POSITIONS
    assert (1 - 0.8) ** minhash_dedup.trees(0.8) < 1e-6


def vectors(seed=2):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(60, 16))
    out = [*draw.normal(size=(150, 16))]
    for b in base:
        out += [b + draw.normal(scale=s, size=16) for s in (0.1, 0.2, 0.3, 0.4)]
    out += [out[0]] * 5 + [out[1] * 3, -out[2]]
    out = [np.float32(v).tolist() for v in out]
    return out + [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [1.0, None] + [1.0] * 14, [1.0] * 5]


def frame(spark, data):
    table = [(i, v, i % 3) for i, v in enumerate(data)]
    return spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int").repartition(4)


def test_linked_vectors(spark):
    data = vectors()
    able = {i: np.array(v) for i, v in enumerate(data) if v and len(v) == 16 and None not in v
            and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in able.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    counts = Counter(x for link in links for x in link)
    named = components(range(len(data)), links)
    got = embedding_dedup.linked(frame(spark, data)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (i, counts[i], named[i], named[i] == i) for i in range(len(data))]


def test_tiles_do_not_change_links(spark, monkeypatch):
    data = frame(spark, vectors(4))
    whole = sorted(embedding_dedup.linked(data).collect())
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    assert sorted(embedding_dedup.linked(data).collect()) == whole


def test_chunks_meet_without_a_shuffle_and_go(spark, monkeypatch):
    plans, staged = {}, embedding_dedup.staged

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    data = frame(spark, vectors(4))
    whole = sorted(embedding_dedup.linked(data).collect())
    for name, value in (("staged", noted), ("TILE", 20), ("FEW", 20), ("ROUND_BYTES", 1)):
        monkeypatch.setattr(embedding_dedup, name, value)
    assert sorted(embedding_dedup.linked(data).collect()) == whole
    assert "Exchange" not in plans["found"] and "CartesianProduct" in plans["found"]
    root = Path(checkpoint_root(spark).removeprefix("file:"))
    assert list(root.glob("issuelens-*/found-*")) and not list(root.glob("issuelens-*/chunks-*"))


def test_vectors_at_one_place_of_an_axis_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 8)
    draw = np.random.default_rng(1)
    data = [np.float32([1 + k % 2, *draw.normal(scale=0.02, size=3)]).tolist() for k in range(40)] + [[0.0, 0.0, 0.0, 1.0]]
    slabs = embedding_dedup.Slabs(np.array([0.5] * 30 + [1.0]), 5)
    assert max(slabs.parts) == 5
    unit = [np.array(v) / np.linalg.norm(v) for v in data]
    counts = [sum(a @ b >= 0.9 for b in unit) - 1 for a in unit]
    got = embedding_dedup.linked(frame(spark, data)).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == list(enumerate(counts))


def test_a_tile_of_near_alike_vectors_keeps_no_pairs():
    draw = np.random.default_rng(3)
    n = 4000
    x = 1 + draw.normal(scale=0.05, size=(n, 16))
    spaces = embedding_dedup.Subspaces(x, 16, 0.9, 8)
    turned = np.ascontiguousarray(spaces.rotated(x))
    packed = pa.array([v.tobytes() for v in turned], pa.binary())
    side = lambda home: pa.table({
        "block": pa.array([0] * n), "home": pa.array([home] * n), "id": pa.array(range(n)),
        "n": pa.array([1 + i % 2 for i in range(n)]), "vector": packed})
    table = pa.concat_tables([side(True), side(False)])
    tracemalloc.start()
    got = embedding_dedup._tile(table, spaces)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = ((turned[:, None, :2] - turned[None, :, :2]) ** 2).sum(2) <= spaces.budgets[0]
    assert near.mean() > 0.9 and (turned @ turned.T).min() > 0.9
    counts = (near * (1 + np.arange(n) % 2)).sum(1) - 1 - np.arange(n) % 2
    found = {r["id"]: r["links"] for r in got.to_pylist() if r["edge"] is None}
    assert found == {i: c for i, c in enumerate(counts.tolist()) if c}
    assert {r["edge"] for r in got.to_pylist()} == {None, min(found)}
    # half of the pairs are linked: two identifiers each would be more
    assert most < 16 * near.sum() / 2


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIVOTS", (8, 16))
    monkeypatch.setattr(topk, "TILE", 50)
    data = vectors(6)
    able = {i: np.floor(64 * np.array(v)).astype(int) for i, v in enumerate(data)
            if v and len(v) == 16 and None not in v and np.isfinite(v).all()}
    expected = []
    for q in able:
        if q % 20 == 0:
            ranked = sorted((-int(able[q] @ able[i]), i) for i in able if i != q)[:20]
            expected += [(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)]
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, data)).collect())
    assert got == sorted(expected)


@pytest.mark.parametrize("tile", [50, 8192])
def test_rows_under_a_query_id_take_no_place(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "PIVOTS", (8, 16))
    monkeypatch.setattr(topk, "TILE", tile)
    data = [(i, v) for i, v in enumerate(vectors(6)) if v and len(v) == 16 and None not in v and np.isfinite(v).all()]
    at = dict(data)
    more = [(20, at[20])] + [(40, at[40])] * 29
    # high-ranking other vectors under an asker's id, repeated candidates, and one least id for two vectors
    more += [(60, [x * (1 + k / 10) for x in at[60]]) for k in range(1, 35)]
    more += [(81, [3 * x for x in at[80]])] * 25 + [(100, at[100])] * 3 + [(120, at[100])] * 30
    more += [(0, at[160]), (0, at[180])]
    rows = data + more
    whole = [(i, tuple(np.floor(64 * np.array(np.float32(v), float)).astype(int).tolist())) for i, v in rows]
    expected = []
    x = np.array([v for _, v in whole])
    for q in sorted({i for i, _ in whole if i % 20 == 0}):
        asked = {v for i, v in whole if i == q}
        ranked = sorted((-int(s), i) for v in asked for (i, _), s in zip(whole, x @ np.array(v)) if i != q)[:20]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(table).collect())
    assert got == sorted(expected)
    assert all(sum(g[0] == q for g in got) == 20 for q in (0, 20, 40, 60, 80, 100, 120))


def test_empty_and_unusable_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_dedup.linked(none).count() == 0
    assert topk.top_k(none).count() == 0
    odd = spark.createDataFrame([(0, None), (None, [1.0, 2.0]), (1, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(str(tuple(r)) for r in embedding_dedup.linked(odd).collect()) == [
        "(0, 0, 0, True)", "(1, 0, 1, True)", "(None, 0, None, True)"]
    assert topk.top_k(odd).count() == 0


def test_components_of_a_path_a_hub_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 299)]
    got = dict(connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(200, 260)}, 300: 299}
