"""Reply trees as conversations, by DataFrame operations only.

Messages point to the message they answer. ``paths`` finds the ways from a root
to a leaf by iterative self-joins that double what a pointer spans: after round
k a message knows its ancestor 2^k steps up and the sum of the scores between,
so a tree of depth d takes log2(d) rounds, not d. Branches, one per leaf, are
ranked by the mean score of their messages; only the chosen ones are written
out, again by doubling. ``formatted`` then makes each chosen path one
conversation: text, and the spans of it that count for the loss.

The template marks every turn at both ends: ``[INST] user [/INST]``,
``<s>assistant</s>``, ``<<SYS>>\\nsystem\\n<</SYS>>`` and, for any other role,
``[ROLE] role [AS] text [/ROLE]``. Inside texts and role names a control string
gets a backslash behind its first character, and one more where it has some
already, so no text holds a control string and ``unescaped`` takes back exactly
what was added. ``read_back`` cuts a formatted text at its marks again.

Offsets count characters (code points). Work is linear in a text: lengths are
summed by a window, and spans are read from blocks of the text, so neither
thousands of turns nor long ones cost the square.

Defined results: a null text or role is empty. Messages whose parent is null or
unknown are roots. Of messages with one id the least by (parent, role, text,
score) stays; a null id is no message. Messages that lead into a cycle have no
root and belong to no path. A null or NaN score counts as 0; equal scores go to the
longer path, then to the smaller leaf. In a table of turns, turns with one
number stand in the order of their role and text, a null number stands first,
and rows with a null conversation id form one conversation. An empty table gives
an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.session import staged

BRANCHES = 1
#: Characters of a block from which spans are read.
BLOCK = 4096

#: What stands before and after a turn's text.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>")}
OTHER = ("[ROLE] ", " [AS] ", " [/ROLE]")
#: A control string: its first character, backslashes, and the rest.
CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|AS\])"
TURN = (r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>\n.*?\n<</SYS>>"
        r"|\[ROLE\] .*? \[AS\] .*? \[/ROLE\]")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def paths(messages: DataFrame, branches: int | None = BRANCHES) -> DataFrame:
    """(root, leaf, branch, position, id) of the chosen ways through reply trees.

    ``messages`` has id, parent and score (one message per id). ``branch`` is
    the place of a path among those of its tree; ``branches`` of None keeps all.
    """
    nodes = staged(messages.where(F.col("id").isNotNull()).select(
        "id", "parent", F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score")),
        "messages")
    known = nodes.select(F.col("id").alias("up"))
    # (id, up, span, total): up is the ancestor ``span`` steps above, null above a root; total sums id's own
    # score and those below up
    state = staged(nodes.join(known, nodes["parent"] == known["up"], "left").select(
        "id", "up", "score", F.col("score").alias("total"), F.lit(1).cast("long").alias("span"),
        F.when(F.col("up").isNull(), F.col("id")).alias("root")), "pointers")
    jumps, limit, reach = [], nodes.count(), 1
    while True:
        open_ = state.where("root IS NULL")
        # a way longer than the number of messages runs in a circle
        if reach > limit or open_.isEmpty():
            break
        jumps.append(open_.select("id", "up"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"),
                             F.col("span").alias("steps"), F.col("root").alias("top"))
        moved = open_.drop("root").join(above, "up").select(
            "id", F.col("next").alias("up"), "score", (F.col("total") + F.col("more")).alias("total"),
            (F.col("span") + F.col("steps")).alias("span"), F.col("top").alias("root"))
        state = staged(state.where("root IS NOT NULL").select(*moved.columns).union(moved), "pointers")
        reach *= 2
    parents = nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    leaves = state.where("root IS NOT NULL").join(parents, "id", "left_anti").select(
        "root", F.col("id").alias("leaf"), "span", (F.col("total") / F.col("span")).alias("mean"))
    order = Window.partitionBy("root").orderBy(F.desc("mean"), F.desc("span"), "leaf")
    chosen = leaves.withColumn("branch", F.row_number().over(order))
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    placed = staged(chosen.select("root", "leaf", "branch", F.col("leaf").alias("id"),
                                  (F.col("span") - 1).alias("position")), "chosen")
    for k, jump in enumerate(jumps):
        higher = placed.join(jump, "id").select(
            "root", "leaf", "branch", F.col("up").alias("id"), (F.col("position") - (1 << k)).alias("position"))
        # whoever stands 2^k above the first 2^k messages of a path is one of the next 2^k
        placed = staged(placed.union(higher), "placed")
    return placed


def formatted(turns: DataFrame, *keys: str) -> DataFrame:
    """One row per conversation: keys, ``formatted``, and ``loss``, its spans that count for the loss.

    ``turns`` has the keys, position, role and text. A span is (start, end) in
    characters and covers one assistant text, without its marks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = role.isin(*MARKS)
    opened, closed = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (before, after) in MARKS.items():
        opened, closed = (F.when(role == name, F.lit(mark)).otherwise(other)
                          for mark, other in ((before, opened), (after, closed)))
    marked = turns.select(*keys, "position", (role == "assistant").alias("counts"), opened.alias("opened"),
                          escaped(text).alias("body"), closed.alias("closed"))
    size = F.length("opened") + F.length("body") + F.length("closed")
    before = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    pieces = marked.select(
        *keys, "position", "counts", F.concat("opened", "body", "closed").alias("piece"),
        (F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long"))
         + F.length("opened")).alias("start"), F.length("body").alias("length"))
    whole = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("position", "counts", "start", "length", "piece"))).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["counts"]), lambda p: F.struct(
        p["start"].alias("start"), (p["start"] + p["length"]).alias("end")))
    return whole.select(*keys, F.array_join("pieces.piece", "").alias("formatted"), spans.alias("loss"))


def _turn(piece: Column) -> Column:
    """(role, text) of one marked turn."""
    def inside(before: str, after: str) -> Column:
        return F.substring(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(after))

    name = F.regexp_extract(piece, r"(?s)^\[ROLE\] (.*?) \[AS\] ", 1)
    body = F.substring(piece, F.length(name) + len(OTHER[0]) + len(OTHER[1]) + 1,
                       F.length(piece) - F.length(name) - sum(map(len, OTHER)))
    role, text = unescaped(name), body
    for own, (before, after) in MARKS.items():
        role, text = (F.when(piece.startswith(before), a).otherwise(b)
                      for a, b in ((F.lit(own), role), (inside(before, after), text)))
    return F.struct(role.alias("role"), unescaped(text).alias("text"))


def read_back(formatted_text: Column) -> Column:
    """The (role, text) pairs that a formatted conversation was made of."""
    return F.transform(F.regexp_extract_all(formatted_text, F.lit(TURN), F.lit(0)), _turn)


def under(formatted_text: Column, spans: Column) -> Column:
    """The texts of ``spans``, each read from the blocks it lies in."""
    def read(bound: Column) -> Column:
        def span(s: Column) -> Column:
            first, last = (s["start"] / BLOCK).cast("int"), (s["end"] / BLOCK).cast("int")
            return F.array_join(F.transform(F.sequence(first, last), lambda b: F.substring(
                F.coalesce(F.get(bound["blocks"], b), F.lit("")),
                (F.greatest(s["start"] - b.cast("long") * BLOCK, F.lit(0)) + 1).cast("int"),
                (F.least(s["end"] - b.cast("long") * BLOCK, F.lit(BLOCK))
                 - F.greatest(s["start"] - b.cast("long") * BLOCK, F.lit(0))).cast("int"))), "")
        return F.transform(bound["spans"], span)

    # bound to a name once, or every span would cut the text anew
    blocks = F.regexp_extract_all(formatted_text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.transform(F.array(F.struct(spans.alias("spans"), blocks.alias("blocks"))), read)[0]


def chains(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of a table of turns: each answers the one before it in its conversation."""
    order = Window.partitionBy(id_col).orderBy(turn_col, "role", "text")
    numbered = turns.select(F.col(id_col).alias("conv"), F.row_number().over(order).cast("long").alias("n"),
                            "role", "text")
    return numbered.select(
        F.struct("conv", "n").alias("id"),
        F.when(F.col("n") > 1, F.struct(F.col("conv"), (F.col("n") - 1).alias("n"))).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"))


def conversations(messages: DataFrame, branches: int | None = BRANCHES) -> DataFrame:
    """(root, leaf, branch, formatted, loss) of reply trees: id, parent, role, text, score."""
    rest = F.struct("parent", "role", "text", "score")
    single = messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(rest).alias("own")).select("id", "own.*")
    return _conversations(staged(single, "replies"), branches)


def _conversations(messages: DataFrame, branches: int | None) -> DataFrame:
    chosen = paths(messages, branches)
    turns = chosen.join(messages.select("id", "role", "text"), "id")
    return formatted(turns, "root", "leaf", "branch")


#: A conversation of nothing but control strings, formatted with all others.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, the probe among them: digests of what its formatted text says."""
    spark = turns.sparkSession
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    source = turns.select(*[F.col(c).cast(probe.schema[c].dataType) for c in probe.columns]).union(probe)
    made = staged(_conversations(staged(chains(source), "replies"), BRANCHES), "conversations")
    said = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns_read = F.size(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0))).cast("long")
    learnt = F.array_join(F.transform(under(F.col("formatted"), F.col("loss")), unescaped), "")
    return made.select(
        F.col("root.conv").alias("conv_id"), turns_read.alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
