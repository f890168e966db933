"""Audit of how far the sources of a language differ in their words.

A ``CountVectorizer`` with the least document frequency and the largest
vocabulary there is makes exact sparse vectors of term counts. A term is fitted
together with its language, so one model holds the vocabularies of all
languages, each with its own document frequencies. The model's vocabulary lies
on the driver and with every executor, so the terms are first dealt into shards
by their hash; small shards are joined and large ones parted until every model
sees about a million different terms at most, and its own tokens alone.

Vectors are only ever added up per source, and adding is what counting does, so
a task adds up its documents of a source before they become vectors: a row of
tokens holds words of many documents, a term that they have n times in the rows
of the binary digits that are 1 in n. Vectors times their digits' weights are
summed in every task and then per term, so a source that holds a third of all
documents is spread over its terms. With few documents of a source in a task
little is added up, and the work nears that of a vector per document.

A group gives a kept term p = 1 + floor(10^9 (count + 1) / (N + V)) with N
its count over all V kept terms of the language; the language itself likewise.

Sources are compared pair by pair without writing out the pairs of a term. In
the sum of f = floor((p - q)^2 / q) over all terms, a term that neither source
has gives the same value f0 each time, so only entries that exist are visited:
V f0, what each side's own terms add to it, and a correction for shared terms.
Terms are dealt into buckets and sources into tiles of bounded size; a bucket
adds up what its terms say on two tiles, and the buckets' sums are added.

Defined results: null text, lang and source are ''. Terms are maximal runs of
ASCII letters and of characters beyond ASCII, A to Z lower-cased. A group
without terms has p of its own from a count of 0; a language that keeps no term
gives pairs of 0 and no terms. Repeated ids and rows count as documents of their
own. Equal values rank by their item's UTF-8 bytes. An empty table gives an
empty result; other columns play no part. Products that 64 bits do not hold are
decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm import bytetext
from issuelens.llm.deploy import deployed
from issuelens.session import scratch_path, settings, staged

MIN_DOCS, VOCABULARY = 3, 2**31 - 1
#: Terms listed of a group.
TERMS = 200
#: Different terms in a shard, entries in a bucket of terms, sources in a tile, shared pairs held at once.
SHARD_TERMS, BUCKET_ENTRIES, TILE, HELD_PAIRS = 1 << 20, 200_000, 256, 1 << 20
#: Terms, and sums of terms and sources, that a task holds before it says so, bytes of text
#: to a different term and of the smallest shard, and folders that a task writes to at once.
HELD_WORDS, HELD_ENTRIES, TERM_BYTES, LEAST_SHARD, OPEN_FILES = 1 << 20, 1 << 20, 256, 1 << 24, 32
#: Bytes of words that a task holds, words in a row for a model, rows read and sent at once, and sums sent at once.
HELD_BYTES, ROW_WORDS, ROWS_READ, ROWS_SENT, SENT_ROWS = 1 << 28, 1 << 11, 512, 64, 1 << 13
LOW = 0xFFFFFFFF
COUNTS = "lang string, source string, term string, count long, all long, first boolean"
UNIT = 1_000_000_000
SEPARATOR = b"\x00"

#: Bytes of terms, lower-cased, and a space for every other one.
LETTERS = np.array([b + 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20
                    for b in range(256)], np.uint8)


def _source(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(lang, rows, bytes in lower case, offsets) of parts of a batch, each of one lang and of bounded text."""
    langs = batch.column(0).dictionary_encode()
    code = langs.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    for at, end in zip(starts, np.append(starts[1:], len(order))):
        own = batch.take(pa.array(order[at:end]))
        for rows, data, offsets in bytetext.slices([own]):
            yield langs.dictionary[code[order[at]]].as_py(), rows, LETTERS[data], offsets


def shard_count(source: DataFrame, terms: int) -> int:
    """Shards to write, as many as hold about ``terms`` different terms each in plain text."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(size // (TERM_BYTES * terms), size // LEAST_SHARD) + 1


def models(held: DataFrame, terms: int) -> list[tuple[list[int], int, int]]:
    """(shards, parts, part) of each model: shards written, joined or parted into at most about ``terms`` different terms."""
    words = held.where("kind = 1 and digit = 0").select("shard", F.explode("words").alias("word"))
    found = words.groupBy("shard").agg(F.approx_count_distinct("word", 0.02).alias("n")).orderBy("shard").collect()
    out: list[tuple[list[int], int, int]] = []
    together = 0
    for shard, n in found:
        parts = -(-n // terms)
        if out and parts == 1 and together + n <= terms:
            out[-1][0].append(shard)
            together += n
        else:
            out += [([shard], parts, part) for part in range(parts)]
            together = n if parts == 1 else terms
    return out


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, document, term, count): the different terms of some texts, and every document's counts."""
    starts, ends, first = bytetext.words(data, offsets)
    ends = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = data[data != 0x20]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs = np.sort(np.repeat(np.arange(len(offsets) - 1), np.diff(first)) * size + coded.indices.to_numpy())
    at = np.flatnonzero(np.diff(pairs, prepend=-1))
    return coded.dictionary, pairs[at] // size, pairs[at] % size, np.diff(np.append(at, len(pairs)))


def _summed_keys(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, each with the sum of its counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(count[order], at) if len(at) else count


def _row_starts(key: np.ndarray) -> np.ndarray:
    """Where rows of one key and at most ``ROW_WORDS`` words start in sorted keys."""
    runs = np.flatnonzero(np.diff(key, prepend=-1))
    within = np.arange(len(key)) - np.repeat(runs, np.diff(np.append(runs, len(key))))
    return np.flatnonzero(within % ROW_WORDS == 0)


class _Held:
    """What a task has counted of its documents' words since it last said so."""

    def __init__(self) -> None:
        self.sources: dict[str, int] = {}
        #: Terms with their langs, the documents that hold each, (source, place among these terms), and counts.
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.entries, self.bytes, self.most = 0, 0, HELD_ENTRIES

    def add(self, lang: str, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        terms, doc, term, count = _counted(data, offsets)
        if not len(terms):
            return
        coded = rows.column(1).dictionary_encode()
        source = np.array([self.sources.setdefault(s, len(self.sources)) for s in coded.dictionary.to_pylist()], np.int64)
        named = pc.binary_join_element_wise(terms, pa.scalar(lang.encode(), pa.binary()), pa.scalar(SEPARATOR, pa.binary()))
        self._put(named, np.bincount(term, minlength=len(terms)), *_summed_keys(
            [source[coded.indices.to_numpy()][doc] << 32 | term], [count]))
        if self.entries >= self.most or self.bytes >= HELD_BYTES:
            self.merge()

    def _put(self, named: pa.Array, docs: np.ndarray, key: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((named, docs, key, count))
        self.entries += len(key)
        self.bytes += int(pc.binary_length(named).to_numpy().astype(np.int64)[key & LOW].sum())

    def merge(self) -> None:
        named, docs, keys, counts = zip(*self.parts)
        coded = pa.concat_arrays(named).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        ends = np.cumsum([len(x) for x in named])
        keys = [key & ~LOW | code[end - len(x):end][key & LOW] for x, end, key in zip(named, ends, keys)]
        self.parts, self.entries, self.bytes = [], 0, 0
        self._put(coded.dictionary, np.bincount(code, weights=np.concatenate(docs)).astype(np.int64),
                  *_summed_keys(keys, list(counts)))
        self.most = max(HELD_ENTRIES, 2 * self.entries)

    def full(self) -> bool:
        """Whether little is left to be gained by holding more."""
        return len(self.parts) == 1 and (len(self.parts[0][0]) >= HELD_WORDS or self.entries >= HELD_ENTRIES
                                         or 2 * self.bytes >= HELD_BYTES)

    def rows(self, shards: int, min_docs: int) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self.merge()
        named, docs, key, count = self.parts[0]
        words, names = named.cast(pa.string()), pa.array(list(self.sources), pa.string())
        ends = np.frombuffer(named.buffers()[1], np.int32)[named.offset:named.offset + len(named) + 1].astype(np.int64)
        letters = np.frombuffer(named.buffers()[2], np.uint8)
        shard = (bytetext.word_hashes(letters, ends[:-1], ends[1:]) % np.uint64(shards)).astype(np.int64)
        for kind, levels in ((0, int(count.max()).bit_length()), (1, min_docs)):
            for level in range(levels):
                # a term and a source for counting, a term alone for fitting
                own = np.flatnonzero(docs > level) if kind else key[count >> level & 1 == 1]
                group = shard[own & LOW] * len(names) + (own >> 32)
                order = np.argsort(group, kind="stable")
                group, own = group[order], own[order]
                starts = _row_starts(group)
                ends = np.append(starts, len(own))
                for k in range(0, len(starts), ROWS_SENT):
                    at, end = starts[k:k + ROWS_SENT], ends[k:k + ROWS_SENT + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[at] // len(names), pa.int32()), pa.array(np.full(len(at), kind), pa.int32()),
                         names.take(pa.array(group[at] % len(names))), pa.array(np.full(len(at), level), pa.int32()),
                         pa.ListArray.from_arrays(pa.array(end - end[0], pa.int32()),
                                                  words.take(pa.array(own[end[0]:end[-1]] & LOW)))],
                        names=["shard", "kind", "source", "digit", "words"])


def tokens(source: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(shard, kind, source, digit, words): words of one shard, each a term, a null character and the lang.

    Rows of kind 0 are for counting. A task adds up its documents of a source
    first; a term that they hold n times is a word of the rows of those digits
    that are 1 in n, so vectors times 2^digit add up to the documents' own.
    Rows of kind 1 are for fitting: a task says of a term only whether it is in
    1, 2, ... ``min_docs`` of the documents it has seen, in a row for each. Whether
    a term is in ``min_docs`` documents of all follows from that alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for part in _by_lang(batch):
                held.add(*part)
                if held.full():
                    yield from held.rows(shards, min_docs)
                    held = _Held()
        yield from held.rows(shards, min_docs)

    return source.select("lang", "source", "text").mapInArrow(
        run, "shard int, kind int, source string, digit int, words array<string>")


class _Sums:
    """Counts per place and source."""

    def __init__(self) -> None:
        self.sources: dict[str, int] = {}
        self.keys, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.entries, self.most = 0, HELD_ENTRIES

    def add(self, source: pa.Array, place: np.ndarray, count: np.ndarray, times: np.ndarray) -> None:
        """Sources that ``times`` of the places and counts belong to."""
        coded = source.dictionary_encode()
        names = np.array([self.sources.setdefault(s, len(self.sources)) for s in coded.dictionary.to_pylist()], np.int64)
        self.keys.append(place.astype(np.int64) << 32 | np.repeat(names[coded.indices.to_numpy()], times))
        self.counts.append(count)
        self.entries += len(place)
        if self.entries >= self.most:
            self.merge()

    def merge(self) -> None:
        key, count = _summed_keys(self.keys, self.counts)
        self.keys, self.counts, self.entries, self.most = [key], [count], len(key), max(HELD_ENTRIES, 2 * len(key))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(place, sources, counts, all)."""
        self.merge()
        names, key, count = pa.array(list(self.sources), pa.string()), self.keys[0], self.counts[0]
        starts = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        ends = np.append(starts, len(key))
        whole = np.add.reduceat(count, starts) if len(starts) else count
        for k in range(0, len(starts), SENT_ROWS):
            own = ends[k:k + SENT_ROWS + 1]
            at = pa.array(own - own[0], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array((key[own[:-1]] >> 32).astype(np.int32)),
                 pa.ListArray.from_arrays(at, names.take(pa.array(key[own[0]:own[-1]] & LOW))),
                 pa.ListArray.from_arrays(at, pa.array(count[own[0]:own[-1]])), pa.array(whole[k:k + SENT_ROWS])],
                names=["place", "sources", "counts", "all"])


def vector_sums(vectors: DataFrame) -> DataFrame:
    """(place, sources, counts, all): vectors, times 2^digit, summed per source, in every task and then per place."""
    schema = "place int, sources array<string>, counts array<bigint>, all bigint"

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums()
        for batch in batches:
            source, digit, places, values = batch.columns
            times = pc.list_value_length(places).to_numpy()
            held.add(source, places.flatten().to_numpy(), values.flatten().to_numpy().astype(np.int64) << np.repeat(
                digit.to_numpy().astype(np.int64), times), times)
            if len(held.keys) == 1 and held.entries >= HELD_ENTRIES:
                yield from held.rows()
                held = _Sums()
        yield from held.rows()

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums()
        for batch in batches:
            place, sources, counts, _ = batch.columns
            times = pc.list_value_length(sources).to_numpy()
            held.add(sources.flatten(), np.repeat(place.to_numpy(), times), counts.flatten().to_numpy(),
                     np.ones(int(times.sum()), np.int64))
        yield from held.rows()

    parts = vectors.select("source", "digit", "vector.indices", "vector.values").mapInArrow(partly, schema)
    return parts.repartition("place").mapInArrow(wholly, schema)


def group_counts(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang",
                 source_col: str = "source", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, term, count, all, first) of the kept terms, where the count is above 0.

    ``all`` is the term's count in its lang; one row of a term is its ``first``.
    """
    spark = deployed(docs.sparkSession)
    source = _source(docs, text_col, lang_col, source_col)
    shards = shard_count(source, shard_terms)
    path = scratch_path(spark, "tokens")
    # a file per folder is open at once, so rows need no sorting first
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES),
                          "spark.sql.execution.arrow.maxRecordsPerBatch": str(2 * ROWS_READ)}):
        tokens(source, shards, min_docs).write.partitionBy("shard", "kind").parquet(path)
    schema = "source string, digit int, words array<string>, shard int, kind int"
    held = spark.read.schema(schema).parquet(path)
    out = None
    # rows are long, so few are in memory at once
    with settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": str(ROWS_READ),
                          "spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_READ)}):
        for written, parts, part in models(held, shard_terms):
            own = held.where(F.col("shard").isin(written)).drop("shard")
            if parts > 1:
                own = own.withColumn("words", F.filter("words", lambda w: F.pmod(F.xxhash64(w), F.lit(parts)) == part))
            fitting, counting = (own.where(F.col("kind") == kind).drop("kind") for kind in (1, 0))
            model = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(min_docs),
                                    vocabSize=VOCABULARY).fit(fitting)
            folder = scratch_path(spark, "vocabulary")
            model.write().save(folder)
            vectors = model.transform(counting).select("source", "digit", F.unwrap_udt("vector").alias("vector"))
            words = spark.read.parquet(f"{folder}/data").select(F.posexplode("vocabulary").alias("place", "word"))
            named = vector_sums(vectors).join(words, "place").select(
                # a term has no such character, a lang may
                F.substr("word", F.instr("word", SEPARATOR.decode()) + 1).alias("lang"),
                F.substring_index("word", SEPARATOR.decode(), 1).alias("term"), "all",
                F.posexplode(F.arrays_zip("sources", "counts")).alias("number", "entry")).select(
                "lang", F.col("entry.sources").alias("source"), "term", F.col("entry.counts").alias("count"), "all",
                (F.col("number") == 0).alias("first"))
            named = staged(named, "counts")
            out = named if out is None else out.union(named)
    return spark.createDataFrame([], COUNTS) if out is None else out


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept))."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    held = count < (2**63 - 1) // UNIT - 1
    return F.lit(1).cast("long") + F.when(held, F.call_function("div", (count + 1) * F.lit(UNIT).cast("long"), total + kept)) \
        .otherwise(F.call_function("div", wide, (total + kept).cast("decimal(20,0)")))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _floored(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tile_sums(entries: pa.Table, width: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): sums over a bucket's entries for sources of two tiles.

    ``entries`` has side (0 or 1), place (of the source in its tile), term (null
    for the row that names a source), p and least (what the source gives a term
    it lacks). Entry (i, j) is the sum with p of i and q of j, in excess of what
    i and j give a term that neither has.
    """
    side, place, p, least = (entries.column(c).to_numpy() for c in ("side", "place", "p", "least"))
    term = entries.column("term").combine_chunks().dictionary_encode()
    named = term.indices.is_null().to_numpy(zero_copy_only=False)
    code = term.indices.fill_null(-1).to_numpy()
    bases = []
    for s in (0, 1):
        base = np.zeros(width, np.int64)
        own = named & (side == s)
        base[place[own]] = least[own]
        bases.append(base)
    at = [np.flatnonzero(base) for base in bases]
    none = np.zeros((width, width), np.int64)
    none[np.ix_(*at)] = _floored(bases[0][at[0]][:, None], bases[1][at[1]][None, :])
    total = np.zeros((width, width), np.int64)
    lists = []
    for s in (0, 1):
        own = np.flatnonzero(~named & (side == s))
        own = own[np.argsort(code[own], kind="stable")]
        lists.append((code[own], place[own], p[own]))
        # a source's terms against what the other tile gives a term it lacks
        for i in at[s]:
            values, counts = np.unique(p[own][place[own] == i], return_counts=True)
            others = bases[1 - s][at[1 - s]]
            for k in range(0, len(values), HELD_PAIRS // width):
                some, n = values[k:k + HELD_PAIRS // width, None], counts[k:k + HELD_PAIRS // width, None]
                if s == 0:
                    total[i, at[1]] += (n * (_floored(some, others[None, :]) - none[i, at[1]][None, :])).sum(0)
                else:
                    total[at[0], i] += (n * (_floored(others[None, :], some) - none[at[0], i][None, :])).sum(0)
    # terms that both have
    (left, i, pi), (right, j, pj) = lists
    first, last = np.searchsorted(right, left), np.searchsorted(right, left, side="right")
    ends = np.cumsum(last - first)
    done = 0
    while done < len(left):
        before = ends[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(ends, before + HELD_PAIRS, side="right")))
        counts = (last - first)[done:end]
        a = np.repeat(np.arange(done, end), counts)
        b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[done:end], counts)
        x, y = i[a], j[b]
        more = (_floored(pi[a], pj[b]) - _floored(pi[a], bases[1][y]) - _floored(bases[0][x], pj[b]) + none[x, y])
        np.add.at(total, (x, y), more)
        done = end
    return none, total


def _summed(entries: pa.Table) -> pa.Table:
    """Sums of one bucket and two tiles, a row per pair of sources; a tile and itself come once."""
    lang, left, right = (entries.column(c)[0].as_py() for c in ("lang", "left", "right"))
    same = left == right
    turned = entries.set_column(entries.schema.get_field_index("side"), "side", pa.array(
        1 - entries.column("side").to_numpy(), pa.int32()))
    none, total = tile_sums(pa.concat_tables([entries, turned]) if same else entries)
    i, j = np.nonzero(total)
    found = [(i + left * TILE, j + right * TILE, total[i, j])]
    if not same:
        back = tile_sums(turned)[1]
        i, j = np.nonzero(back)
        found.append((i + right * TILE, j + left * TILE, back[i, j]))
    a, b, value = (np.concatenate(x) for x in zip(*found))
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(value)],
                    names=["lang", "a", "b", "value"])


def pair_sums(entries: DataFrame, sources: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, a, b, value): the sum of f over all kept terms, for sources numbered within their lang.

    ``entries`` has (lang, term, number, p), ``sources`` (lang, number, least),
    ``terms`` (lang, kept).
    """
    buckets = F.lit(entries.count() // BUCKET_ENTRIES + 1)
    tile = F.floor(F.col("number") / TILE).cast("long")
    tiles = sources.groupBy("lang").agg((F.max(tile) + 1).alias("tiles"))
    # a row meets every tile, its own on both sides
    dealt = entries.select("lang", F.pmod(F.xxhash64("term"), buckets).alias("bucket"), "number", "term", "p",
                           F.lit(0).cast("long").alias("least"))
    named = sources.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), buckets.cast("long") - 1)).alias("bucket"),
                           "number", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "least")
    rows = dealt.union(named).join(tiles, "lang").withColumn("tile", tile)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select(
        "lang", "bucket", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"),
        (F.col("tile") > F.col("other")).cast("int").alias("side"),
        (F.col("number") % TILE).cast("int").alias("place"), "term", "p", "least")
    # the number comes first, as it sorts fastest
    parts = rows.groupBy("bucket", "lang", "left", "right").applyInArrow(_summed, "lang string, a long, b long, value long")
    more = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    one = sources.select("lang", F.col("number").alias("a"), F.col("least").alias("p"))
    two = sources.select("lang", F.col("number").alias("b"), F.col("least").alias("q"))
    # the result has a row for each of these pairs
    pairs = one.join(two, "lang").where("a <> b").join(terms, "lang", "left").join(more, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kept") * _distance(F.col("p"), F.col("q")) + F.coalesce("more", F.lit(0)), F.lit(0))
    return pairs.select("lang", "a", "b", value.cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, listed: int = TERMS, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by distance, terms by what they add to it."""
    counts = group_counts(docs, min_docs, text_col, lang_col, source_col, shard_terms)
    groups = _source(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    terms = staged(counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("count").alias("total")), "kept")
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    sources = groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "kept", "total", number.alias("number"))
    # a lang without terms has no shares; 1 stands in and is multiplied by none
    sources = staged(sources.withColumn("least", F.coalesce(_share(
        F.lit(0).cast("long"), F.col("n"), F.col("kept")), F.lit(1).cast("long"))), "sources")
    q = _share(F.col("all"), F.col("total"), F.col("kept"))
    shares = staged(counts.join(sources, ["lang", "source"]).select(
        "lang", "source", "number", "term", _share(F.col("count"), F.col("n"), F.col("kept")).alias("p"), q.alias("q")),
        "shares")
    compared = pair_sums(shares.select("lang", "term", "number", "p"), sources.select("lang", "number", "least"),
                         terms.select("lang", "kept"))
    names = sources.select("lang", "number", "source")
    pairs = compared.join(names.withColumnRenamed("number", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       _distance(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).union(_greatest(own, listed).select("*", place).where(F.col("rank") <= listed))


def _greatest(terms: DataFrame, listed: int) -> DataFrame:
    """The terms of each group that can be among its ``listed`` greatest, and few others.

    Values are counted by their powers of two; what lies below the power at
    which ``listed`` are reached is out, before anything is sorted.
    """
    power = F.length(F.bin("value"))
    counted = terms.groupBy("lang", "source", power.alias("power")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("lang", "source").orderBy(F.desc("power")).rowsBetween(Window.unboundedPreceding, -1)
    least = counted.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(
        F.col("above") < listed).groupBy("lang", "source").agg(F.min("power").alias("least"))
    return terms.join(least, ["lang", "source"]).where(power >= F.col("least")).drop("least")
