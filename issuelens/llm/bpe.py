"""Byte-level BPE encoding and decoding by a sentencepiece model.

A rank file (base64 token and rank per line) becomes a sentencepiece BPE model
without training: every token is written as a piece of byte-mapped characters
whose score is its negative rank, with identity normalisation, and the model
message is serialised field by field. sentencepiece merges the best-scored
neighbours first, leftmost among equals, which is the merge order of the ranks.
A pre-token that is itself a token is that token, as the ranks' own library
does it. Decoding maps ids back to their bytes.

Nulls count as empty texts, empty texts give no ids, repeated rows are encoded
each on their own, and an empty table gives an empty result. Other columns are
passed on untouched, except that a column named like an output is replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.bytetext import slices
from issuelens.llm.deploy import deployed

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The white space of the pre-token pattern (property White_Space).
WHITE = "\t-\r \x85\xa0  -     　"
#: Pre-tokens never reach over these units: a run without white space and the
#: one blank before it, or what the pattern takes of a white run.
UNITS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Units and pre-tokens remembered by a Python worker before it starts afresh.
REMEMBERED = 300_000


def ranks(path: str | None = None) -> list[bytes]:
    """Token bytes by rank; ranks must run from 0 without a gap."""
    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        known = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [known[i] for i in range(len(known))]


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _integer(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised ModelProto: pieces (field 1), trainer (2) and normaliser (3)."""
    letters = byte_characters()
    pieces = [_message(1, _message(1, "".join(letters[b] for b in token).encode())
                       + struct.pack("<Bf", 2 << 3 | 5, -float(rank)) + _integer(3, 1))
              for rank, token in enumerate(tokens)]
    unknown = _message(1, _message(1, b"<unk>") + struct.pack("<Bf", 2 << 3 | 5, 0.0) + _integer(3, 2))
    # model_type BPE, vocab_size, unk_id, and no begin, end or padding ids
    none = 2**64 - 1
    trainer = (_integer(3, 2) + _integer(4, len(tokens) + 1) + _integer(40, len(tokens))
               + _integer(41, none) + _integer(42, none) + _integer(43, none))
    # identity, no dummy prefix, white space neither dropped nor escaped
    normaliser = _message(1, b"identity") + _integer(3, 0) + _integer(4, 0) + _integer(5, 0)
    return b"".join(pieces) + unknown + _message(2, trainer) + _message(3, normaliser)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids, and back to bytes."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.tokens = ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes(self.tokens))
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.units = UNITS if pattern in (None, public_tokenizers.PATTERN) else None
        self.letters = {i: c for i, c in enumerate(byte_characters())}
        self.whole = {token: struct.pack("<I", rank) for rank, token in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}
        self.pretokens: dict[str, bytes] = {}
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths

    def _learn_pretokens(self, new: list[str]) -> None:
        rest = []
        for pretoken in new:
            raw = pretoken.encode()
            if raw in self.whole:
                self.pretokens[pretoken] = self.whole[raw]
            else:
                rest.append(pretoken)
        mapped = [p.encode().decode("latin-1").translate(self.letters) for p in rest]
        for pretoken, ids in zip(rest, self.model.encode(mapped, num_threads=1)):
            self.pretokens[pretoken] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = (self.units or self.pattern).findall
        units = [split(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.pretokens) > REMEMBERED:
            self.pretokens.clear()
        new = [u for u in set(chain.from_iterable(units)) if u not in self.known]
        if new:
            parts = [self.pattern.findall(u) for u in new]
            self._learn_pretokens([p for p in set(chain.from_iterable(parts)) if p not in self.pretokens])
            for unit, own in zip(new, parts):
                self.known[unit] = b"".join(map(self.pretokens.__getitem__, own))
        return [b"".join(map(self.known.__getitem__, own)) for own in units]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return np.zeros(0, np.uint8)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.bytes[at]


@lru_cache(maxsize=2)
def codec(path: str | None, pattern: str | None) -> Codec:
    return Codec(path, pattern)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def _appended(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` without a column that the new one would clash with, and the result's schema."""
    deployed(df.sparkSession)
    kept = df.drop(*[c for c in df.columns if c.lower() == name.lower()])
    return kept, kept.withColumn(name, F.lit(b"").cast("binary")).schema


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Replace the text column by ``ids_col``: binary, little-endian unsigned 32-bit ids."""
    kept, schema = _appended(docs, ids_col)
    position = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for rows, _, _ in slices(batches, text_col):
            texts = ["" if t is None else t for t in rows.column(position).to_pylist()]
            columns = [c for i, c in enumerate(rows.columns) if i != position]
            yield pa.RecordBatch.from_arrays([*columns, _binary(own.encode(texts))], names=names)

    fields = [f for f in schema.fields if f.name != text_col]
    names = [f.name for f in fields]
    return kept.mapInArrow(run, type(schema)(fields))


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids",
           out_col: str = "decoded") -> DataFrame:
    """Append ``out_col``: the bytes that the ids stand for (empty for null)."""
    kept, schema = _appended(encoded, out_col)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, None)
        for rows, data, offsets in slices(batches, ids_col):
            ids = np.frombuffer(data, "<u4") if len(data) else np.zeros(0, "<u4")
            ends = np.concatenate([[0], np.cumsum(own.lengths[ids])])[offsets // 4]
            out = own.decode(ids)
            texts = pa.Array.from_buffers(
                pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*rows.columns, texts], names=names)

    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the decoded bytes."""
    ids = encode(docs.select("doc_id", "text"), path)
    return decode(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
