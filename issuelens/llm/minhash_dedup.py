"""Near-duplicates by chosen paths of minwise tokens.

Every document is a set of word shingles and a signature of minwise tokens. A
tree deals the documents by the token at one signature position; a node with
few documents is compared exhaustively, a larger one branches into several
other positions, picked by the node's own path, and so on down to ``DEPTH``
tokens, unless many of it agree already, as copies of one text do. Trees are
repeated until a pair at the threshold would be missed by all of them with a
chance below ``1 - RECALL``, were they independent; as they share their
signature positions, it is some 2 in 100,000 where nodes are large all the way
down. What meets in a node and agrees in enough tokens forms clusters; a
document that merely meets a family of copies does not, or documents that share
a common phrase would tie all families into one cluster. Inside a cluster links
are confirmed on the full sets, and every pair of documents that
is not already connected is compared. Groups are the connected components of
the confirmed links.

Equal sets are one class, represented by its least id, before anything else. A
cluster larger than ``CHUNK`` is dealt into chunks that share some leaders;
only documents that this leaves outside the cluster's largest group are then
compared with all other chunks, so a large group of copies of one text costs a
multiple of its size.

Words are lower-cased (A to Z) runs of bytes other than space and 0x09 to 0x0D.
A document with fewer words than a shingle has its whole sequence as its one
shingle; one without words or text has none and is linked with nothing. A row
with a null id is linked with nothing either: its component is null and it is
kept. Rows with equal ids are compared like any others, each gets the component
of its own text. An empty table gives an empty result. Other columns are only
carried where asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import bytetext, slots
from issuelens.llm.components import components
from issuelens.session import staged

SHINGLE, SIMILARITY = 5, 0.8
#: Signature positions, positions that a large node branches into, tokens on the longest path.
POSITIONS, BRANCHES, DEPTH = 48, 2, 4
RECALL = 0.999999
#: Documents of a node that are compared exhaustively, and of a chunk of a cluster.
SMALL, CHUNK, LEADERS = 48, 256, 16
#: Documents of a node at the end of the paths that are compared exhaustively, and signature tokens compared at once.
LAST, COMPARED = 4096, 1 << 21
#: Share of a large node that has to agree with one of its documents for it to be one cluster, documents that
#: stand for the node, and those of them that the others are held against.
COHERENT, JUDGED, STANDARDS = 0.25, 64, 4
#: Bytes of shingle sets in a verification task, and of those put into one array.
SET_BYTES, ARRAY_BYTES = 16 << 20, 64 << 20
WORDS_BASE = 0xD6E8FEB86659FD93
_DRAW = np.random.default_rng(909)
MASKS = _DRAW.integers(0, 2**63, POSITIONS, dtype=np.uint64)
FACTORS = _DRAW.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20


def trees(similarity: float, recall: float = RECALL) -> int:
    """Trees after which a pair at the threshold has met with the chance ``recall``.

    On the longest path a pair meets at the first position, and then in at
    least one of the branches of each level.
    """
    below = 1.0
    for _ in range(DEPTH - 1):
        below = 1 - (1 - similarity * below) ** BRANCHES
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity * below))


def agreement(similarity: float) -> int:
    """Equal signature positions that a pair at the threshold falls short of once in a million."""
    chance, k = 0.0, 0
    while True:
        chance += math.comb(POSITIONS, k) * similarity**k * (1 - similarity) ** (POSITIONS - k)
        if chance > 1e-6:
            return k
        k += 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles, ascending, one text after another."""
    lowered = LOWERED[data]
    starts, ends, first = bytetext.words(lowered, offsets)
    hashes = bytetext.word_hashes(lowered, starts, ends)
    counts = np.diff(first)
    full = bytetext.window_hashes(hashes, shingle, WORDS_BASE)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts):
        if n >= shingle:
            own = np.sort(full[first[i]:first[i] + n - shingle + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own = own[new]
        elif n:
            own = bytetext.window_hashes(hashes[first[i]:first[i] + n], int(n), WORDS_BASE)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64),
            np.concatenate([[0], np.cumsum(sizes)]))


def _signed(documents: pa.Table, shingle: int) -> pa.Table:
    """Per row: size of its set, digest of its set, signature."""
    out = []
    for rows, data, offsets in bytetext.slices(documents.to_batches()):
        hashes, first = shingle_sets(data, offsets, shingle)
        n = np.diff(first)
        some = np.flatnonzero(n)
        at = first[:-1][some]
        signature = np.zeros((len(rows), POSITIONS), np.uint64)
        digests = np.zeros((2, len(rows)), np.uint64)
        if len(some):
            for k in range(POSITIONS):
                signature[some, k] = np.minimum.reduceat((hashes ^ MASKS[k]) * FACTORS[k], at)
            digests[0, some] = np.add.reduceat(bytetext.mixed(hashes), at)
            digests[1, some] = np.add.reduceat(bytetext.mixed(hashes ^ MASKS[0]), at)
        # half of a minwise value tells tokens apart well enough, as links are confirmed
        halves = (signature.ravel() >> np.uint64(32)).astype(np.uint32).view(np.int32)
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(halves), POSITIONS)
        out.append(pa.table([
            rows.column(0), rows.column(1), rows.column(2), pa.array(n),
            pa.array(bytetext.as_long(digests[0])), pa.array(bytetext.as_long(digests[1])),
            tokens.cast(pa.list_(pa.int32()))],
            names=["slot", "row", "doc_id", "n", "d1", "d2", "tokens"]))
    return pa.concat_tables(out)


class Groups:
    """Union of small integers, the least of a group standing for it."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.Table:
    own = a != b
    return pa.table([pa.array(a[own]), pa.array(b[own])], names=["a", "b"])


def _compared_nodes(table: pa.Table, enough: int) -> pa.Table:
    """Small nodes of a bucket, every pair compared by signature: each document and the least of its group."""
    path, ids = (table.column(c).to_numpy() for c in ("path", "doc_id"))
    tokens = table.column("tokens").combine_chunks().flatten().to_numpy().reshape(len(ids), POSITIONS)
    order = np.lexsort((ids, path))
    starts = np.flatnonzero(np.diff(path[order], prepend=path[order][0] - 1))
    a, b = [], []
    for at, end in zip(starts, np.append(starts[1:], len(order))):
        own = order[at:end]
        alike = (tokens[own][:, None, :] == tokens[own][None, :, :]).sum(2) >= enough
        if len(own) == 2:
            labels = np.array([0, 0 if alike[0, 1] else 1])
        else:
            groups = Groups(len(own))
            for i, j in zip(*np.nonzero(np.triu(alike, 1))):
                groups.join(int(i), int(j))
            labels = groups.labels()
        a.append(ids[own])
        b.append(ids[own][labels])
    return _edges(np.concatenate(a), np.concatenate(b))


def _compared_node(table: pa.Table, enough: int) -> pa.Table:
    """One node of up to ``LAST`` documents, as ``_compared_nodes`` compares them."""
    ids = table.column("doc_id").to_numpy()
    tokens = table.column("tokens").combine_chunks().flatten().to_numpy().reshape(len(ids), POSITIONS)
    order = np.argsort(ids, kind="stable")
    ids, tokens = ids[order], tokens[order]
    labels = np.arange(len(ids))
    strip = max(1, COMPARED // tokens.size)
    for at in range(0, len(ids), strip):
        alike = (tokens[at:at + strip, None, :] == tokens[None, :, :]).sum(2) >= enough
        for i, own in enumerate(alike, at):
            joined = np.unique(labels[own])
            if len(joined) > 1:
                labels[np.isin(labels, joined)] = joined[0]
    return _edges(ids, ids[labels])


def _agreement(tokens: Column | str, others: Column) -> Column:
    """Signature positions in which two documents agree."""
    return F.size(F.filter(F.zip_with(tokens, others, lambda a, b: a == b), lambda same: same))


def _families(large: DataFrame, enough: int) -> DataFrame:
    """The rows of large nodes, with ``agreed``: how far each agrees with its node's family, or NULL.

    A node has a family where many of its documents agree with one of them, as
    copies of one text do; further tokens would deal these out ever wider and
    then join them again. Documents that only share a passage agree with hardly
    any other. Up to ``JUDGED`` documents of a node stand for all.
    """
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id"))
    some = large.select("path", "doc_id", "tokens").withColumn("place", place).where(F.col("place") <= JUDGED)
    some = some.groupBy("path").agg(F.collect_list("tokens").alias("some"))

    def judged(first: Column) -> Column:
        alike = F.filter("some", lambda tokens: _agreement(tokens, first) >= enough)
        return F.struct((F.size(alike) / F.size("some")).alias("share"), first.alias("standard"))

    best = F.array_max(F.transform(F.slice("some", 1, STANDARDS), judged))
    families = staged(some.select("path", best.alias("best")).where(F.col("best.share") >= COHERENT).select(
        "path", "best.standard"), "families")
    return staged(large.join(families, "path", "left").withColumn("agreed", F.when(
        F.col("standard").isNotNull(), _agreement("tokens", F.col("standard")))).drop("standard"), "judged")


def _clusters(classes: DataFrame, similarity: float) -> DataFrame:
    """(id, component): candidate clusters, a superset of the groups."""
    count = trees(similarity)
    if count > POSITIONS:
        raise ValueError("more trees than signature positions")
    tree = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tree")
    nodes = classes.select("row", "doc_id", "tokens", tree).select(
        "row", "doc_id", F.xxhash64("tree", F.get("tokens", F.col("tree"))).alias("path"))
    edges = None
    for level in range(DEPTH):
        sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"))
        # a node of one goes no further; its rows are most of them
        members = nodes.join(sizes.where("size > 1"), "path")
        if not level:
            members = members.join(classes.select("row", "tokens"), "row")
        members = staged(members, "nodes")
        small = members.where(F.col("size") <= SMALL)
        rows = small.count()
        buckets = max(2 * slots.partitions(classes.sparkSession), rows // 20_000)
        enough = agreement(similarity)
        found = small.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets))).groupBy(
            "bucket").applyInArrow(lambda t: _compared_nodes(t, enough), "a long, b long")
        large = members.where(F.col("size") > SMALL)
        if level < DEPTH - 1:
            large = _families(large, enough)
            # what agrees with the family's standard in fewer places cannot agree enough with one of the family
            family = large.where(F.col("agreed") >= 2 * enough - POSITIONS)
            hubs = family.groupBy("path").agg(F.min("doc_id").alias("hub"))
            stars = family.join(hubs, "path")
            # the family has met all that it can agree with; the others may yet agree with each other
            large = large.where(F.coalesce(F.col("agreed") < enough, F.lit(True)))
        else:
            last = large.where(F.col("size") <= LAST)
            found = found.union(last.groupBy("path").applyInArrow(
                lambda t: _compared_node(t, enough), "a long, b long"))
            stars = large.where(F.col("size") > LAST).withColumnRenamed("least", "hub")
        found = found.union(stars.where("doc_id <> hub").select("doc_id", "hub"))
        found = staged(found.distinct(), "pairs")
        edges = found if edges is None else edges.union(found)
        if level < DEPTH - 1:
            branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
            # neighbouring picks differ, as positions are taken modulo their number
            position = (F.pmod(F.xxhash64("path"), F.lit(POSITIONS))
                        + F.col("branch") * (POSITIONS // BRANCHES)) % POSITIONS
            nodes = large.select("row", "doc_id", "tokens", "path", branch.alias("branch")).select(
                "row", "doc_id", "tokens", F.xxhash64(
                    "path", "branch", F.get("tokens", position.cast("int"))).alias("path"))
            if large.isEmpty():
                break
    return components(edges)


def _shipped(documents: pa.Table, wanted: pa.Table, shingle: int) -> pa.Table:
    """The full sets of the wanted rows, a row per place that wants them."""
    out = []
    wanted_row = wanted.column("row").to_numpy()
    order = np.argsort(wanted_row, kind="stable")
    wanted_row = wanted_row[order]
    if len(order):
        rows = documents.column("row").to_numpy()
        own = documents.take(pa.array(np.flatnonzero(np.isin(rows, wanted_row))))
        for part, data, offsets in bytetext.slices(own.to_batches()):
            hashes, first = shingle_sets(data, offsets, shingle)
            rows = part.column(1).to_numpy()
            left, right = (np.searchsorted(wanted_row, rows, side) for side in ("left", "right"))
            times = right - left
            places = order[np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())]
            sets = pa.Array.from_buffers(pa.binary(), len(rows), [
                None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(hashes)])
            taken = np.repeat(np.arange(len(rows)), times)
            # a set that many places want is many times its size, and an array holds 2 GB at most
            held = np.cumsum(8 * np.diff(first)[taken])
            cuts = np.flatnonzero(np.diff(held // ARRAY_BYTES)) + 1
            for at, own in zip(np.split(places, cuts), np.split(taken, cuts)):
                out.append(wanted.take(pa.array(at)).append_column("hashes", sets.take(pa.array(own))))
    return pa.concat_tables(out) if out else wanted.slice(0, 0).append_column("hashes", pa.array([], pa.binary()))


def _confirm(sets: list[np.ndarray], labels: np.ndarray, pivots: np.ndarray, percent: int) -> np.ndarray:
    """Labels after every pivot was compared with every set of another label, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    hashes = np.concatenate(sets)
    _, codes = np.unique(hashes, return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    for i in pivots:
        others = np.flatnonzero(labels != labels[i])
        if not len(others):
            break
        lesser, greater = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * lesser >= percent * greater]
        if not len(others):
            continue
        own = codes[starts[i]:starts[i] + sizes[i]]
        mark[own] = 1
        lengths = sizes[others]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts[others] - ends + lengths, lengths)
        common = np.add.reduceat(mark[codes[at]], ends - lengths)
        mark[own] = 0
        linked = others[100 * common >= percent * (lengths + sizes[i] - common)]
        if len(linked):
            joined = np.unique(labels[np.append(linked, i)])
            labels[np.isin(labels, joined)] = joined[0]
    return labels


def _confirmed(table: pa.Table, percent: int) -> pa.Table:
    """Every group of a bucket: its documents' links, as each one's least linked label."""
    group, ids, label = (table.column(c).to_numpy() for c in ("group", "doc_id", "label"))
    pivot = table.column("pivot").to_numpy(zero_copy_only=False)
    packed = table.column("hashes")
    order = np.lexsort((ids, group))
    starts = np.flatnonzero(np.diff(group[order], prepend=group[order][0] - 1))
    a, b = [], []
    for at, end in zip(starts, np.append(starts[1:], len(order))):
        own = order[at:end]
        sets = [np.frombuffer(packed[int(i)].as_buffer(), "<u8") for i in own]
        joined = _confirm(sets, label[own].copy(), np.flatnonzero(pivot[own]), percent)
        a.append(label[own])
        b.append(joined)
    return _edges(np.concatenate(a), np.concatenate(b))


def _verified(slotted: DataFrame, places: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links among the rows placed in the same group; places are
    (slot, row, doc_id, n, group, label, pivot)."""
    size = places.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * slots.partitions(slotted.sparkSession), 8 * size // SET_BYTES)
    dealt = places.select("slot", "row", "doc_id", "group", "label", "pivot",
                          F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket"))
    shipped = slots.with_answers(
        slotted, dealt, T.StructType([*dealt.schema.fields, T.StructField("hashes", T.BinaryType())]),
        lambda slot, d, w: _shipped(d, w, shingle))
    return shipped.groupBy("bucket").applyInArrow(lambda t: _confirmed(t, percent), "a long, b long").distinct()


def _linked(slotted: DataFrame, members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, component) of the confirmed links inside clusters; members are
    (slot, row, doc_id, n, cluster)."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    chunks = F.ceil(F.col("size") / CHUNK).cast("long")
    members = staged(members.join(sizes.withColumn("chunks", chunks), "cluster").withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))), "members")
    own = F.xxhash64("cluster", "chunk").alias("group")
    columns = ["slot", "row", "doc_id", "n"]
    first = members.select(*columns, own, F.col("doc_id").alias("label"), F.lit(True).alias("pivot"))
    several = members.where("chunks > 1")
    order = Window.partitionBy("cluster").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "row")
    leaders = several.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
    spread = leaders.select(*columns, "cluster", F.col("chunk").alias("home"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).where("chunk <> home")
    places = first.union(spread.select(*columns, own, F.col("doc_id"), F.lit(True)))
    edges = staged(_verified(slotted, places, shingle, percent), "links")
    found = components(edges)
    if several.isEmpty():
        return found
    # what is not in the largest group of a chunked cluster meets all chunks
    named = several.join(found, several["doc_id"] == found["id"], "left").select(
        *columns, "cluster", "chunk", "chunks", F.coalesce("component", "doc_id").alias("label"))
    named = staged(named, "named")
    counted = named.groupBy("cluster", "label").agg(F.count("*").alias("size"))
    largest = counted.groupBy("cluster").agg(F.max(F.struct("size", "label")).alias("top")).select(
        "cluster", F.col("top.label").alias("top"))
    others = named.join(largest, "cluster").where("label <> top").drop("top")
    amounts = others.groupBy("cluster").agg(F.count("*").alias("left"))
    parts = F.ceil(F.col("left") / CHUNK).cast("long")
    amounts = amounts.select("cluster", parts.alias("parts"))
    tile = F.xxhash64("cluster", "chunk", "part").alias("group")
    every = named.join(amounts, "cluster").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    outside = others.join(amounts, "cluster").withColumn("part", F.pmod(
        F.xxhash64("doc_id", F.lit(2)), F.col("parts"))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    places = every.select(*columns, tile, "label", F.lit(False).alias("pivot")).union(
        outside.select(*columns, tile, "label", F.lit(True)))
    more = staged(_verified(slotted, staged(places, "tiles"), shingle, percent), "links")
    return components(edges.union(more))


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id",
           text_col: str = "text", carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The slots of ``docs``, and per row (slot, row, doc_id, n_shingles, component_id, kept).

    ``kept`` holds for the rows whose id is their component's least.
    """
    percent = round(100 * similarity)
    slotted = slots.in_slots(docs, id_col, text_col, carry)
    signed = staged(slots.per_slot(
        slotted, "slot long, row long, doc_id long, n long, d1 long, d2 long, tokens array<int>",
        lambda slot, d: _signed(d, shingle)), "signatures")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    digest = ["n", "d1", "d2"]
    least = some.groupBy(*digest).agg(F.min(F.struct("doc_id", "row")).alias("at"))
    least = staged(least.select(*digest, F.col("at.doc_id").alias("same"), F.col("at.row").alias("row")), "classes")
    classes = staged(signed.select("slot", "row", "doc_id", "n", "tokens").join(
        least.select("row"), "row", "left_semi"), "sets")
    clusters = _clusters(classes.select("row", "doc_id", "tokens"), similarity)
    members = classes.join(clusters, classes["doc_id"] == clusters["id"], "left").select(
        "slot", "row", "doc_id", "n", F.coalesce("component", "doc_id").alias("cluster"))
    # a cluster of one has nothing to compare
    shared = clusters.select("component").distinct()
    members = members.join(shared, members["cluster"] == shared["component"], "left_semi")
    linked = _linked(slotted, members, shingle, percent)
    found = signed.join(least.select(*digest, "same"), digest, "left").withColumn(
        "same", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("same")))
    named = found.join(linked, found["same"] == linked["id"], "left").select(
        "slot", "row", "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component", "same", "doc_id").alias("component_id"))
    return slotted, named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are near-duplicates of a kept one.

    Of rows with the same id and component the first stored stays; rows with a
    null id and rows without words all stay.
    """
    names = docs.columns
    slotted, named = groups(docs, shingle, similarity, id_col, text_col, names)
    one = named.where("kept").withColumn("key", F.when(
        F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("doc_id")))
    loose = one.where("key IS NULL").select("slot", "row")
    first = one.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("row", "slot")).alias("at")).select(
        "at.slot", "at.row")

    def stay(slot: int, documents: pa.Table, wanted: pa.Table) -> pa.Table:
        chosen = np.isin(documents.column("row").to_numpy(), wanted.column("row").to_numpy())
        own = documents.filter(pa.array(chosen))
        return pa.table([own.column(f"carry_{c}") for c in names], names=names)

    return slots.with_answers(slotted, loose.union(first), docs.schema, stay)


def group_rows(docs: DataFrame) -> DataFrame:
    """Per document of three-word shingles, alike from 85 in 100: set size, component and whether it stays."""
    _, named = groups(docs.select("doc_id", "text"), 3, 0.85)
    return named.select("doc_id", "n_shingles", "component_id", "kept")
