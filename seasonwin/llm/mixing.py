"""Mixing of sources to target weights by weighted fair queueing (operator 9), in DataFrame functions only.

Each source's documents are shuffled and queue behind each other, pass after
pass. A document's virtual finish time is the number of its source's words up
to its end, divided by the source's target: sources are served in proportion to
their targets, and at time 1 each has been given its target. All items are
sorted by that time over all sources; the last word of the budget is that at time 1.

The shuffle is the order of a hash. Running sums go by ranges of that hash
within a source, then over the ranges, so that a source of any size is as many
tasks as there are ranges; likewise the global order is cut into ranges of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonwin.llm.common import SPACES, fresh
from seasonwin.session import pin

_WORD = f"[^{SPACES}]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 of null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def shuffle_hash(doc_id: Column, seed: int) -> Column:
    """32 hexadecimal digits that any SQL engine can compute."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most_passes: int = 3, share: float = 1.0) -> DataFrame:
    """Targets of sources from ``source, source_size``: adds ``target``, and ``goal``, the target in whole words.

    Sources in order of their code points, null last, weigh ``weights`` in
    turn and share ``share`` of all words. No target is above ``most_passes``
    times its source; what is above that goes to the others by weight. That
    is one level L with target = min(cap, L * weight): caps per weight
    ascend, and the first sources up to which L is above stay at their cap.
    One row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (position % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most_passes)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_weights"))
    )
    # The first source whose cap the level doesn't reach sets the level for itself and all after it.
    open_at = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_capped"))).over(whole)
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct("_capped", "_level"))).over(whole)["_level"]
    target = F.when(open_at.isNull() | (F.col("_level") * F.col("_weight") > F.col("_cap")), F.col("_cap").cast("double"))
    rows = rows.withColumn("target", F.least(target.otherwise(level * F.col("_weight")), F.col("_cap").cast("double")))
    # Largest remainders: the sources that rounding down costs most get a word each until the goals add up to the targets.
    down = F.floor("target")
    left = F.round(F.sum("target").over(whole)).cast("long") - F.sum(down).over(whole)
    by_rest = Window.orderBy((F.col("target") - down).desc(), F.col("source").asc_nulls_last())
    goal = down + F.when(F.row_number().over(by_rest) <= left, 1).otherwise(0)
    return rows.withColumn("goal", goal).drop("_weight", "_cap", "_capped", "_weights", "_budget", "_level")


def queue(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most_passes: int = 3, share: float = 1.0, seed: int = 9,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", ranges: int = 256,
) -> DataFrame:
    """One row per document with its place in its source's queue.

    ``doc_id, source, size, source_size, target, goal, row_key`` and ``before``, the
    words that its source's queue holds before it in the first pass. Rows that
    repeat an id queue one after the other; null sources are one source; null
    texts have no words. ``row_key`` is unique.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"),
    )
    rows = pin(
        rows.withColumn("_hash", shuffle_hash(F.col("doc_id"), seed)).withColumn(
            "_range", F.pmod(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"), F.lit(1 << 32)) * ranges / F.lit(1 << 32)
        ).withColumn("_range", F.floor("_range").cast("int")),
        "sizes",
    )
    in_ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"))
    by_source = Window.partitionBy("source")
    ahead = by_source.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    in_ranges = in_ranges.withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).withColumn(
        "source_size", F.sum("_words").over(by_source)
    )
    in_ranges = pin(in_ranges, "ranges")
    targets = source_targets(in_ranges.select("source", "source_size").distinct(), weights, most_passes, share)
    in_ranges = in_ranges.join(targets.withColumnRenamed("source", "_s").drop("source_size"), F.col("source").eqNullSafe(F.col("_s")))
    in_ranges = in_ranges.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), "_ahead", "source_size", "target", "goal"
    )
    queued = Window.partitionBy("source", "_range").orderBy("_hash", "doc_id", "size")
    before = F.sum("size").over(queued.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.withColumn("_before", before).withColumn("_number", F.row_number().over(queued))
    joined = placed.join(in_ranges, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "goal", (F.col("_ahead") + F.col("_before")).alias("before"),
        F.struct("_range", "_number").alias("row_key"),
    )


def serve(queued: DataFrame, most_passes: int = 3, ranges: int = 64) -> DataFrame:
    """All items in the order of their virtual finish times, cut at the budget.

    One row per document and pass that is served: the columns of ``queue``,
    ``pass``, ``served`` (words; the item in service when its source reaches
    its target is cut there), ``finish`` and ``position`` (words before it in
    the whole mix). Equal times are ordered by source, then by place.
    """
    start = F.col("before") + F.col("pass") * F.col("source_size")
    items = (
        queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))))
        .withColumn("_start", start)
        .withColumn("served", F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("_start"))))
        .where(F.col("served") > 0)
        .withColumn("finish", F.least(F.lit(1.0), (F.col("_start") + F.col("served")) / F.col("target")))
        .withColumn("_slot", F.least(F.lit(ranges - 1), F.floor(F.col("finish") * ranges).cast("int")))
    )
    slots = items.groupBy("_slot").agg(F.sum("served").alias("_words"))
    # As many rows as there are ranges of time.
    ahead = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("_slot", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    order = Window.partitionBy("_slot").orderBy("finish", F.col("source").asc_nulls_last(), "_start")
    within = F.sum("served").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("served")
    placed = items.withColumn("_within", within).join(F.broadcast(slots), "_slot")
    return placed.withColumn("position", F.col("_ahead") + F.col("_within")).drop("_slot", "_within", "_ahead", "_start")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Words that the mix takes of each document: ``doc_id, size, source_size, target, taken``; options as in ``queue``.

    Every row of ``docs`` gives one row, also those of which nothing is taken. No rows give none.
    """
    passes = options.get("most_passes", 3)
    queued = pin(queue(docs, **options), "queue")
    taken = serve(queued, passes).groupBy("source", "row_key").agg(F.sum("served").alias("_taken"))
    taken = taken.select(F.col("source").alias("_s"), F.col("row_key").alias("_k"), "_taken")
    out = queued.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("row_key") == F.col("_k")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents of the mix with all their columns, a document taken k times as k rows.

    A document is taken as often as the words served of it make whole copies,
    counting a last part from half its words on. Rows are told apart by a hash of
    all their columns; rows that are equal in all share what they take evenly.
    """
    identity, copies = fresh(docs, "_identity", "_copies")
    named = docs.withColumn(identity, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    taken = mix(named, **{**options, "doc_id": identity}).groupBy("doc_id").agg(
        F.sum("taken").alias("_taken"), F.sum("size").alias("_size")
    )
    often = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(F.lit(0)).cast("int")
    taken = taken.select(F.col("doc_id").alias(identity), often.alias(copies)).where(F.col(copies) > 0)
    spread = named.join(taken, identity).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return spread.select(*(F.col(f"`{c}`") for c in docs.columns))
