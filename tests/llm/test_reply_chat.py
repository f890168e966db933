"""Reply trees against recursion, and formatted conversations against their turns."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from issuelens.llm import reply_chat

TREE = "id string, parent string, role string, text string, score double"
TURNS = "conv_id bigint, turn bigint, role string, text string"
ODD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> [\\INST]", "[ROLE] a [AS] b [/ROLE]", "<<SYS>>\n<</SYS>>", "<<s>", "[", "<",
       "\\", "[INST", "</s", "", " ", "\n", "<s></s>", "[/INST] [/INST]", "<\\", "a<", "<<", "<</SYS>>", "é日本👩" * 50,
       "[AS]", "[\\AS]", "<<\\SYS>>", "<\\<SYS>>", "$1 \\1", "s>", "/INST]", "SYS>>"]
ROLES = ["user", "assistant", "system", "tool", "", "User", "a [AS] b", "[ROLE] ", "\n", "</s>"]


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    """Per conversation what the query returns, but the formatted length."""
    found = {}
    for conv, turn, role, text in turns:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, own in found.items():
        own = [(r, t) for _, _, _, r, _, t in sorted(own)]
        learnt = "".join(t for r, t in own if r == "assistant")
        out[conv] = (len(own), hexed("".join(f"{r}\n{t}\n" for r, t in own)), len(learnt), hexed(learnt))
    return out


def check(spark, turns):
    frame = spark.createDataFrame(turns, TURNS).repartition(3)
    got = {r.conv_id: tuple(r)[1:5] for r in reply_chat.conversation_digests(frame).collect()}
    probe = [(-7, 0, "user", reply_chat.PROBE_TEXT), (-7, 1, "assistant", reply_chat.PROBE_TEXT)]
    assert got == expected([*turns, *probe])


def test_any_text_and_role_is_read_back(spark):
    draw = random.Random(3)
    turns = [(i, k, draw.choice(ROLES), draw.choice(ODD) + draw.choice(ODD)) for i in range(60) for k in range(draw.randrange(1, 9))]
    turns += [(100 + i, 0, "assistant", text) for i, text in enumerate(ODD)]
    turns += [(200 + i, 0, role, "text") for i, role in enumerate(ROLES)]
    check(spark, turns)


def test_nulls_ties_and_repeated_turns(spark):
    check(spark, [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"),
                  (1, 1, "assistant", "a"), (1, None, "system", None), (None, 0, "user", "q"), (None, 1, "assistant", "r"),
                  (2, 5, None, None)])


def test_long_conversations_and_texts(spark):
    long = "word <s> [INST] é " * 100_000
    check(spark, [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]
          + [(2, 0, "user", long), (2, 1, "assistant", long), (2, 2, "assistant", "<" * 5000), (2, 3, "assistant", "é" * 8192)])


def test_no_turns_but_the_probe(spark):
    rows = reply_chat.conversation_digests(spark.createDataFrame([], TURNS).withColumn("root", F.lit(1))).collect()
    assert [r.conv_id for r in rows] == [-7]
    assert rows[0].n_turns == 2 and rows[0].loss_chars == len(reply_chat.PROBE_TEXT)
    formatted = reply_chat.conversations(spark.createDataFrame([], TREE))
    assert formatted.columns == ["root", "leaf", "branch", "formatted", "loss"] and formatted.count() == 0


def test_the_mask_covers_assistant_texts_alone(spark):
    rows = [("a", None, "user", "hi", 0.0), ("b", "a", "assistant", "yo </s>", 0.0)]
    row = reply_chat.conversations(spark.createDataFrame(rows, TREE)).first()
    assert row.formatted == "[INST] hi [/INST]<s>yo <\\/s></s>"
    assert [row.formatted[s.start:s.end] for s in row.loss] == ["yo <\\/s>"]


def brute_paths(rows, branches):
    """root -> chosen paths, by walking up from every leaf."""
    nodes = {}
    for id_, parent, role, text, score in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[1:])):
        if id_ is not None:
            nodes.setdefault(id_, (parent, 0.0 if score is None or score != score else score))
    parents = {p for p, _ in nodes.values()}
    trees = {}
    for leaf in set(nodes) - parents:
        path, at = [], leaf
        while at in nodes and at not in path:
            path.append(at)
            at = nodes[at][0]
        if at in path:
            continue
        mean = sum(nodes[n][1] for n in path) / len(path)
        trees.setdefault(path[-1], []).append((-mean, -len(path), leaf, path[::-1]))
    return {root: [p for *_, p in sorted(found)[:branches]] for root, found in trees.items()}


@pytest.mark.parametrize("branches", [1, 2, None])
def test_paths_equal_walks(spark, branches):
    draw = random.Random(11)
    rows = [(f"n{i}", f"n{draw.randrange(i)}" if i % 13 else None, "user", "t", draw.randrange(5) / 4) for i in range(1, 200)]
    rows += [(f"c{i}", f"c{i - 1}" if i else "gone", "user", "t", None if i % 2 else float("nan")) for i in range(70)]
    rows += [("x", "y", "user", "t", 1.0), ("y", "x", "user", "t", 1.0), ("z", "x", "user", "t", 1.0), ("s", "s", "u", "t", 1.0)]
    rows += [(None, "n3", "user", "t", 1.0), ("n3", "n1", "user", "a", 9.0), ("n3", "n2", "user", "b", 0.0)]
    rows += [("hub", None, "user", "t", 0.0)] + [(f"h{i:03}", "hub", "user", "t", 0.5) for i in range(120)]
    got = {}
    for r in reply_chat.conversations(spark.createDataFrame(rows, TREE).withColumn("branch", F.lit(1)), branches).collect():
        got.setdefault(r.root, {})[r.branch] = r.leaf
    want = {root: {k: p[-1] for k, p in enumerate(found, 1)} for root, found in brute_paths(rows, branches).items()}
    assert got == want
    frame = spark.createDataFrame(rows, TREE).where("id IS NOT NULL").groupBy("id").agg(F.min(
        F.struct("parent", "role", "text", "score")).alias("own")).select("id", "own.*")
    paths = {}
    for r in reply_chat.paths(frame, branches).collect():
        paths.setdefault((r.root, r.branch), {})[r.position] = r.id
    assert {k: [v[i] for i in range(len(v))] for k, v in paths.items()} == {
        (root, k): p for root, found in brute_paths(rows, branches).items() for k, p in enumerate(found, 1)}


def test_it_runs_no_python(spark):
    from issuelens.llm.queries import LLM_QUERIES
    from test_queries import Plans

    plans = Plans(spark)
    found = LLM_QUERIES["op11_reply_chat"](spark, "/root/testdata/sf0.001")
    for plan in [found._jdf.queryExecution().executedPlan().toString(), *plans.texts()]:
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
