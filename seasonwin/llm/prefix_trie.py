"""Prefix trie of conversations by recursive halving of depth (operator 13), after the van Emde Boas layout.

A stretch of 2L turns is cut in the middle. The prefixes that end at the cut
are named by a digest; what stands above is a trie of depth L, what stands
below is one trie of depth L under each named prefix, and all of them are cut
again, side by side, until they hold one turn. Every round thus handles all stretches of one
length, half as many rows per round towards the top; as many rounds are needed as
the longest conversation can be halved.

Totals are grafted the other way: a trie's total is that of its upper part plus
those of the lower ones hung on its cuts, and each cut's total is a weight on the whole
path above it, which halves with the path.

No step gathers a conversation, a prefix or its members: stretches are rows,
equal ones are added up before they are shuffled.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonwin.llm.common import SPACES, with_groups
from seasonwin.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROOT, _NONE = "root", "none"
_WORD = f"[^{SPACES}]+"
#: Members' ids are strung together this many at a time.
_PIECE = 1_000


def _name(*parts: Column) -> Column:
    """A digest of 32 bytes of columns that hold binary or null."""
    sized = [F.coalesce(F.concat(F.lit("+"), F.lower(F.hex(p))), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*sized).cast("binary"), 256))


def _fixed(text: str) -> Column:
    return F.unhex(F.sha2(F.lit(text).cast("binary"), 256))


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, i, name, words``: turns numbered from 0 within each conversation.

    ``name`` is a digest of role and text, null ones as empty texts; ``words``
    counts the words of the text. Turns ascend, null first; equal ones by role,
    then by the SHA-256 digest of the text. Rows without a conversation's id belong to none and are left out.

    Numbers come from ranges of (conversation, turn) and counts per range, so
    that a conversation of any length is not ordered by one task.
    """
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("_turn"), role_.alias("_role"),
        F.unhex(F.sha2(text_.cast("binary"), 256)).alias("_text"), F.octet_length(role_).alias("_bytes"),
        F.regexp_count(text_, F.lit(_WORD)).cast("long").alias("words"),
    ).where("conv is not null")
    rows = pin(rows.select(
        "conv", "_turn", "_role", "_text", "words",
        F.unhex(F.sha2(F.concat(F.col("_bytes").cast("string"), F.lit(":"), "_role", F.hex("_text")).cast("binary"), 256)).alias("name"),
    ), "turns").withColumn("_read", F.monotonically_increasing_id())
    keys = [F.col("conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("_read")]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "name", "words")
    ranges = pin(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33).cast("int")
    runs = ranges.groupBy("conv", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # A row for every conversation, and one more for each further range that it reaches into.
    before = F.sum("_rows").over(Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    found = ranges.withColumn("_part", part).join(runs, ["conv", "_part"])
    return found.select("conv", (F.col("_before") + F.col("_at") - F.col("_first")).alias("i"), "name", "words")


def rebuilt(seqs: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that borrow their beginning: the ids of all, and ``conv, i, name, words`` of the new turns.

    Of conversation c the first h = crc32(c as text) mod ``most`` turns are those of conversation
    c - c % ``every``, all if it has fewer, none if there is none; c's own turns from its h-th on follow.
    """
    conv = F.col("conv")
    ids = pin(seqs.where("i = 0").select("conv", (F.crc32(conv.cast("string").cast("binary")) % most).alias("h"), (conv - conv % every).alias("base")), "ids")
    # At most ``most`` - 1 turns of one in ``every`` conversations are lent, each to at most ``every`` - 1 others.
    lent = seqs.where(F.col("i") < most - 1).where(conv % every == 0)
    lent = lent.select(F.col("conv").alias("base"), "i", "name", "words").join(ids, "base").where("i < h")
    taken = lent.groupBy("conv").agg(F.count(F.lit(1)).alias("lent"))
    shift = ids.join(taken, "conv", "left").select("conv", "h", F.coalesce("lent", F.lit(0)).alias("lent"))
    own = seqs.join(shift, "conv").where("i >= h").select("conv", (F.col("i") - F.col("h") + F.col("lent")).alias("i"), "name", "words")
    return ids.select("conv"), lent.select("conv", "i", "name", "words").unionByName(own)


def _blocks(seqs: DataFrame) -> list[DataFrame]:
    """Names of all aligned stretches of 1, 2, 4, ... turns, up to one for each conversation.

    ``conv, b, name, left, right, turns``: ``left`` and ``right`` name the halves, and ``right``
    is null where the conversation ends in the left one.
    """
    none = F.lit(None).cast("binary")
    level = pin(seqs.select("conv", F.col("i").alias("b"), "name", none.alias("left"), none.alias("right"), F.lit(1).cast("long").alias("turns"), "words"), "blocks")
    levels, half = [level], F.col("b") % 2
    while levels[-1].agg(F.max("b")).first()[0]:
        pairs = levels[-1].groupBy("conv", F.shiftright("b", 1).alias("b")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"), F.sum("turns").alias("turns")
        )
        levels.append(pin(pairs.select("conv", "b", _name(F.col("left"), F.col("right")).alias("name"), "left", "right", "turns"), "blocks"))
    return levels


def _stretches(levels: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Cut all stretches down to single turns. Returns these, and the cut stretches of each round, longest first.

    A stretch is one of a trie's paths: it hangs below the prefix ``root``,
    ``depth`` turns deep, and ``block`` names its turns. ``n`` conversations go along it, ``conv`` being the
    smallest; ``tip`` names the prefix at its end if it has all its turns, and
    ``ends`` the whole sequence if that ends in it.
    """
    top = len(levels) - 1
    whole = F.col("turns") == F.lit(1 << top)
    rows = levels[top].groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("turns").alias("turns"))
    rows = rows.select(
        _fixed(_ROOT).alias("root"), F.col("name").alias("block"), F.lit(0).cast("long").alias("depth"), "n", "conv",
        F.when(whole, _name(_fixed(_ROOT), F.col("name"))).alias("tip"), F.col("name").alias("ends"),
    )
    cuts = []
    for level in range(top, 0, -1):
        length = 1 << (level - 1)
        halves = levels[level].select("conv", (F.col("b") * (2 * length)).alias("depth"), "left", "right", "turns")
        # The smallest conversation stands for the stretch, so both sides have each key once.
        cut = F.when(F.col("turns") >= length, _name(F.col("root"), F.col("left")))
        rows = pin(rows.join(halves, ["conv", "depth"]).withColumn("cut", cut), "cuts")
        cuts.append(rows)
        shorter = F.col("right").isNull()
        upper = rows.groupBy("root", F.col("left").alias("block"), "depth").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("cut").alias("tip"), F.max(F.when(shorter, F.col("ends"))).alias("ends")
        )
        lower = rows.where(~shorter).select(
            F.col("cut").alias("root"), F.col("right").alias("block"), (F.col("depth") + length).alias("depth"), "n", "conv", "tip", "ends"
        )
        rows = upper.unionByName(lower)
    return pin(rows, "turn_nodes"), cuts


def _grafted(nodes: DataFrame, cuts: list[DataFrame], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Totals of ``values`` below each node of single turns: ``conv, depth`` and the sums; and those below the root.

    ``nodes`` has ``root, conv, depth`` and the values.
    """
    sums = [F.sum(v).alias(v) for v in values]
    below = [pin(nodes.groupBy("root").agg(*sums), "below")]
    for rows in reversed(cuts):
        hung = rows.where("cut is not null and right is not null").select(F.col("root").alias("_up"), F.col("cut").alias("root")).distinct()
        moved = below[-1].join(hung, "root", "left").select(F.coalesce("_up", "root").alias("root"), *values)
        below.append(pin(moved.groupBy("root").agg(*sums), "below"))
    weights = nodes.select("conv", "depth", *(F.lit(0).cast("long").alias(v) for v in values))
    for i, rows in enumerate(cuts):
        level = len(cuts) - 1 - i
        rows = rows.select("root", "left", "right", "depth", "conv", "cut")
        if i == 0:
            rows = rows.select("*", *(F.lit(0).cast("long").alias(v) for v in values))
        else:
            rows = pin(rows.join(weights, ["conv", "depth"]), "weighted")
        upper = rows.groupBy("root", "left", "depth").agg(F.min("conv").alias("conv"), F.max("cut").alias("cut"), *sums)
        more = below[level].select(F.col("root").alias("cut"), *(F.col(v).alias(f"_{v}") for v in values))
        # A path that ends before the cut has nothing hung on it.
        cut, short = upper.where("cut is not null").join(more, "cut", "left"), upper.where("cut is null")
        cut = cut.select("conv", "depth", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
        lower = rows.where("right is not null").select("conv", (F.col("depth") + F.lit(1 << level)).alias("depth"), *values)
        weights = cut.unionByName(short.select(cut.columns)).unionByName(lower)
    return weights, below[-1]


def _ends(whole: DataFrame) -> DataFrame:
    """``ends, ends_sha256`` from ``conv, ends``: the digest of each group's ids, ascending, comma-joined.

    Ids are joined in pieces by ranges of (group, id); a digest then reads its
    pieces in order, one at a time, so that it holds no more than a piece of any group.
    """
    keys = ["ends", "conv"]
    ranges = pin(whole.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys), "members")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            heads, first, ids, start = [], [], [], 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[start] or i - start == _PIECE:
                    heads.append(names[start])
                    first.append(convs[start])
                    ids.append(",".join(map(str, convs[start:i])))
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], ["ends", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["ends", "ends_sha256"])

        for batch in batches:
            done = []
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = now, hashlib.sha256(ids.encode("ascii"))
                else:
                    state.update(f",{ids}".encode("ascii"))
            yield rows(done)
        if state is not None:
            yield rows([(name, state.hexdigest())])

    pieces = ranges.mapInArrow(join, "ends binary, first long, ids string")
    dealt = pieces.repartition("ends").sortWithinPartitions("ends", "first").select("ends", "ids")
    return dealt.mapInArrow(digest, "ends binary, ends_sha256 string")


def trie(ids: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``seqs`` (``conv, i, name, words``, with i from 0 without gaps); ``ids`` names all conversations.

    ``conv_id``, the smallest member, and ``depth``; ``parent_conv_id``, null
    of the root; ``n_convs`` members, of which those that end here give ``ends_sha256``;
    ``n_children``; ``n_leaves``, the nodes without children in its subtree, itself
    included; ``saved_tokens``, summed over the subtree: words of a node's turn
    times the members beyond the first. Conversations without turns end at the
    root. No conversations give no rows, not even the root.
    """
    ids = pin(ids, "conversations")
    smallest, count = ids.agg(F.min("conv"), F.count(F.lit(1))).first()
    levels = _blocks(pin(seqs, "sequences"))
    stretches, cuts = _stretches(levels)
    words = levels[0].select("conv", F.col("b").alias("depth"), "words")
    nodes = stretches.join(words, ["conv", "depth"])
    children = pin(nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n_children")), "children")
    nodes = nodes.join(children.withColumnRenamed("root", "tip"), "tip", "left").select(
        "root", "tip", "depth", "conv", "n", "ends", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
    )
    nodes = pin(nodes, "nodes")
    values = ["n_leaves", "saved_tokens"]
    weights, below = _grafted(nodes, cuts, values)
    weights = weights.select("conv", "depth", *(F.col(v).alias(f"_{v}") for v in values))
    nodes = nodes.join(weights, ["conv", "depth"]).withColumns({v: F.col(v) + F.col(f"_{v}") for v in values})
    whole = levels[-1].select("conv", F.col("name").alias("ends"))
    whole = ids.join(whole, "conv", "left").select("conv", F.coalesce("ends", _fixed(_NONE)).alias("ends"))
    root = _root(ids, smallest, count, children, below)
    nodes = nodes.withColumn("depth", F.col("depth") + 1).select(root.columns).unionByName(root)
    nodes = pin(nodes, "totals")
    parents = pin(nodes.where("n_children > 0").select(F.col("tip").alias("root"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("_rows")), "parents")
    nodes = with_groups(nodes.where("root is not null"), parents, ["root"], "_rows").drop("_rows").unionByName(
        nodes.where("root is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    nodes = pin(nodes.select("ends", F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", *values), "with_parents")
    inner = nodes.where("ends is null").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    ended = nodes.where("ends is not null").join(_ends(whole), "ends", "left")
    ended = ended.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return inner.unionByName(ended).drop("ends")


def _root(ids: DataFrame, smallest: int | None, count: int, children: DataFrame, below: DataFrame) -> DataFrame:
    """The node without a turn, as a frame of one row; of none if there is no conversation."""
    none = F.lit(None).cast("binary")
    row = ids.sparkSession.createDataFrame([(smallest, count)], "conv long, n long").where("n > 0").select(
        none.alias("root"), _fixed(_ROOT).alias("tip"), F.lit(0).cast("long").alias("depth"), "conv", "n", _fixed(_NONE).alias("ends")
    )
    row = row.join(children.withColumnRenamed("root", "tip"), "tip", "left").join(below.withColumnRenamed("root", "tip"), "tip", "left")
    return row.select(
        "root", "tip", "depth", "conv", "n", "ends", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
    )


def conversation_trie(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``trie`` of the rebuilt conversations; every row and whole text of ``turns`` counts, other columns are not read."""
    ids, seqs = rebuilt(pin(sequences(turns), "numbered"), every, most)
    return trie(ids, seqs)
