"""Shared texts and brute-force helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(texts, start=0):
    return [(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts, start)]


def corpus(seed=5, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, and odd ones."""
    draw = random.Random(seed)
    words = [f"w{draw.randrange(10**6)}" for _ in range(400)] + ["der", "the", "é", "日本", "of"]
    sentence = lambda k: " ".join(draw.choice(words) for _ in range(k))
    text = lambda: "\n".join(sentence(draw.randrange(3, 14)) for _ in range(draw.randrange(1, 9)))
    passage = sentence(30) + "\n" + sentence(12) + "\n" + sentence(9)
    texts = [text() for _ in range(n)]
    for i in range(0, n, 6):
        texts.append(texts[i])
    for i in range(1, n, 7):
        own = texts[i].split(" ")
        own[draw.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    for i in range(2, n, 5):
        texts.append(texts[i][:40] + "\n" + passage + "\n" + text())
    texts += [passage, passage + "\n" + passage, None, "", " ", "\n\n\n", "\n\n\n", "a", "a b", "A  B", "x" * 500,
              "x" * 450, "ab" * 300, passage * 3, "\t" + text() + "\r\n", "é" * 130, "one two three"]
    texts.append(" ".join(draw.choice(words) for _ in range(20_000)))
    return texts


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
