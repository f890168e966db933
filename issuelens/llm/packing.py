"""Packing by powers of two.

Every document is cut into pieces whose lengths are powers of two: as many of
the greatest length as fit, then the binary digits of the rest, greatest
first. A piece is a sequence of its own, so no sequence crosses documents and
none is padded; pieces of equal length share a bucket, from which batches of
one shape are drawn.

A null text counts as empty and gives the one piece of its end id; rows with
equal or null ids are packed each on their own; an empty table gives none.
Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.bpe import byte_characters
from issuelens.llm.bytetext import slices
from issuelens.llm.deploy import deployed

VOCABULARY = "word_bpe_49k.json"
MAX_LENGTH = 2048
END_ID = 1
#: Words and pieces of words remembered by a Python worker before it starts afresh.
REMEMBERED = 1_000_000
#: Characters at which the tokenizer's own pattern certainly splits, and drops them.
WORDS = re.compile(r"[^ \t-\r]+")
#: Words of ASCII and Latin-1 letters: already in normal form, one lower-case letter each.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own split, over the characters of PLAIN.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordEncoder:
    """Ids of a text by a tokenizer that drops white space, word by word.

    Since no token reaches over white space, a text's ids are those of its
    words in turn, and a word is encoded once per worker. A plain word is
    lowered and split here and merged by the tokenizer's BPE model; any other
    goes through the whole tokenizer.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.plain = path in (None, public_tokenizers.path(VOCABULARY))
        self.model = self.tokenizer.model
        self.letters = {i: c for i, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            mapped = part.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            self.parts[part] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        rest = []
        for word in words:
            if self.plain and PLAIN.fullmatch(word) and "<|" not in word:
                self.known[word] = b"".join(map(self._part, PARTS.findall(word.lower())))
            else:
                rest.append(word)
        for word, own in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.known[word] = np.array(own.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        split = [WORDS.findall(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        self._learn([w for w in set(chain.from_iterable(split)) if w not in self.known])
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def encoder(path: str | None) -> WordEncoder:
    return WordEncoder(path)


def binary_pieces(n_tokens: np.ndarray, max_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these sizes, in order."""
    bits = max_length.bit_length() - 1
    counts = np.zeros((len(n_tokens), bits + 1), np.int64)
    counts[:, 0] = n_tokens // max_length
    for i in range(bits):
        counts[:, i + 1] = n_tokens >> (bits - 1 - i) & 1
    sizes = np.broadcast_to(max_length >> np.arange(bits + 1), counts.shape)
    length = np.repeat(sizes.ravel(), counts.ravel())
    document = np.repeat(np.arange(len(n_tokens)), counts.sum(1))
    before = np.cumsum(length) - length
    first = np.cumsum(n_tokens) - n_tokens
    return document, before - first[document], length


def pack(docs: DataFrame, path: str | None = None, max_length: int = MAX_LENGTH,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids (binary, little-endian unsigned 32-bit).

    ``sequence_id`` is unique; ``bucket`` is the binary logarithm of the length.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    deployed(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for rows, _, _ in slices(batches):
            texts = ["" if t is None else t for t in rows.column(1).to_pylist()]
            ids = [x + end for x in own.encode(texts)]
            n_tokens = np.array([len(x) // 4 for x in ids], np.int64)
            document, start, length = binary_pieces(n_tokens, max_length)
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            yield pa.RecordBatch.from_arrays([
                rows.column(0).take(pa.array(document)), pa.array(start), pa.array(length),
                pa.Array.from_buffers(pa.binary(), len(length), [
                    None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(ids))]),
                pa.array(n_tokens[document])],
                names=["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = source.mapInArrow(
        run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )


def piece_digests(docs: DataFrame) -> DataFrame:
    """Per piece: its place in document and sequence, and the checksum of its ids."""
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")
