"""Secret scans: fixed patterns, and Markov models of random strings.

Three kinds come from patterns. The fourth, ``markov``, comes from two
first-order character models, one of random strings and one of ordinary
identifiers: a run of key characters is a secret when its log-likelihood ratio
is high. Both models are trained on the corpus: the samples labelled random are
the values that the patterns find, those labelled ordinary are the other long
words of the same documents. Everything is a column expression: no Python runs
on the executors.

What stays out: a random string of fewer than 20 key characters that no pattern
finds, and one that ordinary text joined to it by ``/``, ``=``, ``-`` or ``_``
averages down, since a run is scored as a whole.

Spans count code points, end exclusive. The work is linear in a text and, but
for a logarithm, in its spans. A null text counts as empty and has no
spans; rows with equal or null ids are scanned each on their own; an empty
table gives none, and models without samples are uniform. Working columns are
named so that they cannot clash with a table's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.reply_chat import under

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGNED = 6
#: Equal to the runs of 20 and 24 characters or more: a shorter run holds no match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ORDINARY = "[A-Za-z0-9+/_=-]{8,}"
#: Natural-log likelihood ratio, in total and per character step, of a secret.
TOTAL, PER_STEP = 12.0, 0.35
#: Documents (expected number) whose strings train the models.
TRAINED_ON = 20_000
#: Parts of the hash space that a share is taken of; fine enough for any number of texts.
PARTS = 1 << 50
#: Values that are combined one by one; more are combined by blocks.
BLOCK = 128
MASK = "[SECRET]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often the body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of some integers above 0, ``combine`` of all before it; 0 where there are none.

    Blocks are combined first, so that many values cost a multiple of their
    number and not its square.
    """
    def over(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), combine)

    def placed(bound: Column) -> Column:
        last = F.size(bound) - 1
        whole = F.transform(F.sequence(F.lit(0), last, F.lit(BLOCK)), lambda b: over(F.slice(bound, b + 1, F.lit(BLOCK))))
        upto = F.aggregate(whole, F.array(F.lit(0)),
                           lambda out, x: F.concat(out, F.array(combine(F.element_at(out, -1), x))))
        return _let(upto, lambda blocks: F.transform(F.sequence(F.lit(0), last), lambda i: combine(
            F.get(blocks, (i / BLOCK).cast("int")),
            over(F.slice(bound, (i - i % BLOCK + 1).cast("int"), (i % BLOCK).cast("int"))))))

    return F.when(F.size(values) > 0, _let(values, placed)).otherwise(F.array().cast("array<int>"))


def _starts(pieces: Column, matches: Column) -> Column:
    """Start of each match, from the pieces between and the matches themselves."""
    gaps = F.transform(F.slice(pieces, F.lit(1), F.size(matches)), F.length)
    lengths = F.zip_with(gaps, matches, lambda gap, m: gap + F.length(m))
    return F.zip_with(_before(lengths, lambda a, b: a + b), gaps, lambda before, gap: before + gap)


def _furthest(spans: Column) -> Column:
    """The furthest end before each span of a list by start."""
    return _before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))


def _outside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that meet none of ``base``, both by start: by binary search in the base.

    A span meets one exactly if the furthest end of those that start before it
    ends lies behind its start.
    """
    def free(bound: Column) -> Column:
        def meets(x: Column) -> Column:
            # the number of base spans that start before x ends
            def halved(at: Column, _: Column) -> Column:
                middle = ((at["low"] + at["high"]) / 2).cast("int")
                right = (at["low"] < at["high"]) & (F.get(bound["base"], middle)["start"] < x["end"])
                return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"),
                                F.when(right, at["high"]).otherwise(middle).alias("high"))

            ends = F.struct(F.lit(0).alias("low"), F.size(bound["base"]).alias("high"))
            found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), ends, halved, lambda at: at["low"])
            return F.get(bound["ends"], found) > x["start"]

        return F.filter(bound["spans"], lambda x: ~meets(x))

    ends = F.concat(_furthest(base), F.array(F.coalesce(F.array_max(F.transform(base, lambda s: s["end"])), F.lit(0))))
    searched = _let(F.struct(spans.alias("spans"), base.alias("base"), ends.alias("ends")), free)
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(searched)


def _spans(df: DataFrame, pattern: str, kind: int, out: str, keep) -> DataFrame:
    """Append ``out``: array<struct<start, kind, end>> of the matches that ``keep`` holds for."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    found = df.withColumn("__matches", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
    some = F.size("__matches") > 0
    found = found.withColumn("__pieces", F.when(some, F.split("__text", pattern, -1)))
    found = found.withColumn("__starts", F.when(some, _starts(F.col("__pieces"), F.col("__matches"))))
    kept = F.filter(F.arrays_zip(F.col("__starts").alias("s"), F.col("__matches").alias("m")),
                    lambda x: keep(x["m"]))
    spans = F.transform(kept, lambda x: F.struct(
        x["s"].alias("start"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end")))
    return found.withColumn(out, F.when(some, spans).otherwise(none)).drop(
        "__matches", "__pieces", "__starts")


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``__text`` and ``__base``, the pattern spans by start, then kind."""
    found = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    found = _spans(found, ASSIGN, 0, "__assign",
                   lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGNED)
    found = _spans(found, ACCESS, 1, "__access", lambda m: F.lit(True))
    found = _spans(found, HEX, 2, "__hex", lambda m: F.lit(True))
    return found.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex"))).drop(
        "__assign", "__access", "__hex")


def sample(docs: DataFrame, text_col: str, size: int = TRAINED_ON) -> DataFrame:
    """About ``size`` texts at most, picked by a hash of the text; a repeated text counts once."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    share = min(1.0, size / max(1, docs.count()))
    return texts.where(F.pmod(F.xxhash64("__text"), F.lit(PARTS)) < int(share * PARTS)).distinct()


def step_counts(docs: DataFrame, text_col: str = "text", size: int = TRAINED_ON) -> DataFrame:
    """(random, steps, n): how often each pair of neighbouring characters occurs in the samples."""
    labelled = base_spans(sample(docs, text_col, size).withColumnRenamed("__text", "__sample"), "__sample")
    secret = under(F.col("__text"), F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    value = F.transform(secret, lambda m: F.coalesce(
        F.nullif(F.regexp_extract(m, ASSIGN, 2), F.lit("")), m))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "__text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    strings = labelled.select(F.explode(F.concat(
        F.transform(value, lambda v: F.struct(F.lit(True).alias("random"), v.alias("string"))),
        F.transform(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)),
                    lambda v: F.struct(F.lit(False).alias("random"), v.alias("string"))))).alias("x"))
    weighted = strings.groupBy("x").count().select("x.random", "x.string", "count")
    letters = F.split("string", "")
    steps = weighted.select("random", "count", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("string") - 1, F.lit(1))),
        lambda i: F.concat(F.get(letters, i - 1), F.coalesce(F.get(letters, i), F.lit(""))))).alias("steps"))
    return steps.groupBy("random", "steps").agg(F.sum("count").alias("n"))


def log_ratios(counts: Iterable) -> list[float]:
    """Natural-log ratio per pair of ALPHABET characters, first character major.

    Each model is smoothed towards its character frequencies, and those
    towards the uniform distribution.
    """
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    models = {True: [[0.0] * n for _ in range(n)], False: [[0.0] * n for _ in range(n)]}
    for random, pair, count in counts:
        if len(pair) == 2 and pair[0] in place and pair[1] in place:
            models[random][place[pair[0]]][place[pair[1]]] += count
    logs = {}
    for label, table in models.items():
        single = [sum(table[i][j] for i in range(n)) + 1.0 for j in range(n)]
        whole = sum(single)
        logs[label] = [math.log((table[i][j] + 2 * n * single[j] / whole) / (sum(table[i]) + 2 * n))
                       for i in range(n) for j in range(n)]
    return [a - b for a, b in zip(logs[True], logs[False])]


def train(docs: DataFrame, text_col: str = "text", size: int = TRAINED_ON) -> list[float]:
    """The ratio table; its counts have at most a row per label and pair of characters."""
    pairs = step_counts(docs, text_col, size).where(F.length("steps") == 2)
    return log_ratios(pairs.where(F.col("steps").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect())


def likelihood_ratio(string: Column, ratios: list[float]) -> Column:
    """Sum of the ratios over neighbouring characters of an ALPHABET string."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(string) - 1), F.lit(0.0),
        lambda s, i: s + F.get(table, (F.get(codes, i - 1) - 1) * len(ALPHABET) + F.get(codes, i) - 1))


def scan(docs: DataFrame, text_col: str = "text", ratios: list[float] | None = None,
         out_col: str = "spans") -> DataFrame:
    """Append ``out_col``: array<struct<start, kind, end>> by start, then kind.

    ``kind`` is the place in KINDS. A markov span is only added where it meets
    no pattern span. Without ``ratios`` the models are trained on ``docs``.
    """
    ratios = train(docs, text_col) if ratios is None else ratios

    def likely(m: Column) -> Column:
        score = likelihood_ratio(m, ratios)
        return score >= F.greatest(F.lit(TOTAL), PER_STEP * (F.length(m) - 1))

    found = _spans(base_spans(docs, text_col), CANDIDATE, 3, "__markov", likely)
    free = _outside(F.col("__markov"), F.col("__base"))
    return found.withColumn(out_col, F.array_sort(F.concat("__base", free))).drop(
        "__text", "__base", "__markov")


def mask(docs: DataFrame, text_col: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by MASK."""
    found = scan(docs, text_col, ratios, "__spans")
    text = F.col(text_col)
    # text between runs of overlapping spans, and after the last
    each = F.zip_with("__spans", _furthest(F.col("__spans")), lambda s, done: F.struct(
        done.alias("start"), s["start"].alias("end")))
    last = F.struct(F.array_max(F.transform("__spans", lambda s: s["end"])).alias("start"), F.length(text).alias("end"))
    between = F.concat(F.filter(each, lambda s: s["end"] >= s["start"]), F.array(last))
    masked = F.array_join(under(text, between), MASK)
    return found.withColumn(text_col, F.when(F.size("__spans") > 0, masked).otherwise(text)).drop("__spans")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the pattern spans, their digest, and all spans as text."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
