"""Quality classifier: a factorisation machine over words and structure.

Inputs are hashed words (damped counts, unit length per text), and structure
statistics of the bytes, words and lines, cut into bins at fixed edges, with
the stated number of characters as the one piece of metadata. Every pair of
inputs interacts through low-rank factors; scores take linear time, since the
sum over pairs is half the square of the sum less the sum of squares.

The machine is fitted on at most about ``FIT_ROWS`` labelled rows, which is its
only bound; scoring reads every whole text. A null or empty text has no words
and is scored by its structure. A null number of characters is taken from the
text. Rows with equal ids are scored each on their own, and fitted once, with
the least label and text. Without labels every score is 0.5;
an empty table gives an empty result. Other columns are passed on, except
that one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm import bytetext
from issuelens.llm.deploy import deployed

WORD_BUCKETS = 2048
FACTORS = 8
#: Labelled rows to fit on (expected number), and the part of labels kept from fitting.
FIT_ROWS, FOLDS, HELD_OUT = 6000, 4, 2
THRESHOLD = 0.7
EPOCHS, BATCH, RATE, DECAY, SEED = 25, 256, 0.02, 1e-5, 7
#: Rows whose inputs are held as one dense block.
ROWS = 256

CLASSES = {
    "lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A),
    "blank": b" \t", "line": b"\n", "bar": b"|", "loud": b"!", "stop": b".,;:?'\"()-",
    "sign": b"%&$#*@^~<>{}[]=+_\\/`", "wide": range(0x80, 0x100),
}
BYTE_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _bytes in enumerate(CLASSES.values()):
    BYTE_CLASS[list(_bytes)] = _i
N_CLASSES = len(CLASSES) + 1
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20
SHARES = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
SIZES = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384, 65536])
LENGTHS = np.array([1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14, 20])
BINS = len(SHARES) + 1
N_STATISTICS = N_CLASSES + 9
WIDTH = WORD_BUCKETS + N_STATISTICS * BINS


def inputs(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """The dense input block of the texts, one row each."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    of_byte = np.repeat(np.arange(rows) * N_CLASSES, sizes)
    counts = np.bincount(of_byte + BYTE_CLASS[data], minlength=rows * N_CLASSES).reshape(rows, N_CLASSES)
    lowered = LOWERED[data]
    starts, ends, first = bytetext.words(lowered, offsets)
    hashes = bytetext.word_hashes(lowered, starts, ends)
    n_words = np.diff(first)
    row = np.repeat(np.arange(rows), n_words)
    bucket = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
    table = np.bincount(row * WORD_BUCKETS + bucket, minlength=rows * WORD_BUCKETS).reshape(rows, WORD_BUCKETS)
    lengths = np.bincount(row, weights=ends - starts, minlength=rows)
    longest = np.zeros(rows)
    if len(starts):
        np.maximum.at(longest, row, ends - starts)

    stops = np.flatnonzero(data == 0x0A)
    line_from = np.sort(np.concatenate([offsets[:-1], stops + 1]), kind="stable")
    line_row = np.searchsorted(offsets[1:], line_from, side="right")
    inside = line_row < rows
    line_from, line_row = line_from[inside], line_row[inside]
    line_to = np.append(line_from[1:], len(data))
    lines = np.bincount(line_row, minlength=rows)
    keys = bytetext.word_hashes(data, line_from, line_to) if len(data) else np.zeros(len(line_from), np.uint64)
    distinct = np.unique(np.stack([line_row.astype(np.uint64), keys]), axis=1)[0].astype(np.int64)
    distinct_lines = np.bincount(distinct, minlength=rows)

    of = lambda part, whole: part / np.maximum(whole, 1)
    letters = counts[:, 0] + counts[:, 1]
    statistics = [(of(counts[:, i], sizes), SHARES) for i in range(N_CLASSES)] + [
        (of(counts[:, 1], letters), SHARES), (of((table > 0).sum(1), n_words), SHARES),
        (of(table.max(1), n_words), SHARES), (1 - of(distinct_lines, lines), SHARES),
        (n_words, SIZES), (n_chars, SIZES), (longest, SIZES),
        (of(lengths, n_words), LENGTHS), (of(n_words, lines), SIZES),
    ]
    out = np.zeros((rows, WIDTH), np.float32)
    damped = np.log1p(table)
    out[:, :WORD_BUCKETS] = damped / np.maximum(np.sqrt((damped**2).sum(1, keepdims=True)), 1e-9)
    for i, (values, edges) in enumerate(statistics):
        out[np.arange(rows), WORD_BUCKETS + i * BINS + np.digitize(values, edges)] = 1.0
    return out


@dataclass
class Machine:
    """bias + x.w + (|xV|^2 - x^2.V^2) / 2, read as a logit."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        sums = x @ self.factors
        squares = (x * x) @ (self.factors**2).sum(1)
        return self.bias + x @ self.linear + 0.5 * ((sums**2).sum(1) - squares)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x).astype(np.float64), -30, 30)))


def gradients(model: Machine, x: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Slopes of the mean logistic loss, with DECAY / 2 times the squared weights, in linear time as well."""
    error = ((model.scores(x) - labels) / len(labels)).astype(x.dtype)
    sums = x @ model.factors
    return (float(error.sum()), x.T @ error + DECAY * model.linear,
            x.T @ (error[:, None] * sums) - ((x * x).T @ error)[:, None] * model.factors + DECAY * model.factors)


def fit(cells: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Adam on the logistic loss over sparse rows (columns, values)."""
    draw = np.random.default_rng(SEED)
    model = Machine(0.0, np.zeros(WIDTH, np.float32),
                    draw.normal(0, 0.01, (WIDTH, FACTORS)).astype(np.float32))
    if not len(labels):
        model.factors[:] = 0
        return model
    model.bias = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    first = [np.zeros_like(model.linear), np.zeros_like(model.factors)]
    second = [np.zeros_like(model.linear), np.zeros_like(model.factors)]
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            x = np.zeros((len(own), WIDTH), np.float32)
            for i, k in enumerate(own):
                x[i, cells[k][0]] = cells[k][1]
            for_bias, for_linear, for_factors = gradients(model, x, labels[own])
            step += 1
            for k, (value, slope) in enumerate(((model.linear, for_linear), (model.factors, for_factors))):
                first[k] += 0.1 * (slope - first[k])
                second[k] += 0.001 * (slope * slope - second[k])
                value -= RATE * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            model.bias -= RATE * for_bias
    return model


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with their input block; text and __chars are the columns read."""
    for rows, data, offsets in bytetext.slices(batches, "__text"):
        chars = rows.column(rows.schema.get_field_index("__chars")).to_numpy(zero_copy_only=False)
        for at in range(0, len(rows), ROWS):
            part = offsets[at:at + ROWS + 1]
            own = rows.slice(at, ROWS)
            yield own, inputs(data[part[0]:part[-1]], part - part[0], chars[at:at + ROWS])


def _read(docs: DataFrame, text_col: str, chars_col: str | None) -> DataFrame:
    deployed(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.length(text)
    if chars_col and chars_col in docs.columns:
        chars = F.coalesce(F.col(chars_col), chars)
    return docs.withColumns({"__text": text, "__chars": chars.cast("double")})


def held_out(id_col: str = "doc_id"):
    """Whether the label of this id is kept from fitting."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id",
          label_col: str = "quality", text_col: str = "text", chars_col: str | None = "n_chars") -> Machine:
    """Fit on labelled rows whose id is not held out, at most about ``fit_rows`` of them."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where(
        F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out("__id"))
    known = known.groupBy("__id").agg(F.min("__label").alias("__label"))
    share = min(1.0, fit_rows / max(1, known.count()))
    # a share of fine parts of the hash space, so that some rows are left of any number
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 50)) < int(share * (1 << 50)))
    chosen = F.broadcast(chosen.limit(2 * fit_rows))  # bounded by its parameter
    texts = docs.withColumn("__id", F.col(id_col)).join(chosen, "__id")
    read = _read(texts, text_col, chars_col).groupBy("__id", "__label").agg(
        F.min(F.struct("__text", "__chars")).alias("x")).select("__id", "__label", "x.__text", "x.__chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in blocks(batches):
            own = [np.flatnonzero(line) for line in x]
            yield pa.RecordBatch.from_arrays([
                rows.column(0).cast(pa.int64()), rows.column(1).cast(pa.float64()),
                pa.array([at.astype("<u2").tobytes() for at in own], pa.binary()),
                pa.array([line[at].tobytes() for line, at in zip(x, own)], pa.binary())],
                names=["id", "label", "columns", "values"])

    rows = read.mapInArrow(run, "id long, label double, columns binary, values binary").collect()
    rows.sort(key=lambda r: (r["id"], r["columns"], r["values"]))
    cells = [(np.frombuffer(r["columns"], "<u2"), np.frombuffer(r["values"], np.float32)) for r in rows]
    return fit(cells, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Machine, text_col: str = "text", chars_col: str | None = "n_chars",
          out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs``, or the columns ``keep`` of it, with ``out_col``, the probability of label 1."""
    keep = [c for c in keep or docs.columns if c.lower() != out_col.lower()]
    read = _read(docs, text_col, chars_col).select(*keep, "__text", "__chars")
    schema = docs.select(*keep).withColumn(out_col, F.lit(0.0)).schema
    n = len(keep)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:n], pa.array(model.scores(x))], names=names)

    return read.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: fold, score and verdict."""
    read = docs.select("doc_id", "text", "n_chars")
    scored = score(read, train(read, labels), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
