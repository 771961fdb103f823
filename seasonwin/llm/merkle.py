"""Merkle manifest of a dataset by cogrouped subtree exchange (operator 11).

Every row is a leaf. The leaves of a group in the order of their ids are cut
into superblocks, subtrees of a fixed depth. Superblocks reduce to their tops
side by side; the tops are the leaves of the same problem again, smaller by the
size of a superblock, until each group has one top, and the tops of the groups
are the leaves of the last tree. On the way back each superblock meets the
outer nodes that lead from its top to the root: a cogroup of both finishes the
local levels, joins the proofs and folds the leaves to the root.

A place among the leaves comes from a range partitioning and counts per
partition, so that no group, however large, is ordered by one task.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonwin.llm.common import lower_ascii, with_groups
from seasonwin.session import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a document's leaf is computed from, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels of a superblock.
ARITY, LEVELS = 8, 3
_BLOCK = ARITY**LEVELS
_TOP = "_all"
_PATH = "path binary, places array<int>, sizes array<int>"


def _encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_encoded(v) for v in values)).cast("binary"), 256))


def lowered_text(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The drill's tampering: which rows, and what becomes of their text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False)), lower_ascii(text)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text", tamper=None) -> DataFrame:
    """``grp, id, digest, seen``: the leaf of every row, and what a reader sees of it.

    ``grp`` is the group as a text in which null sorts first; ``seen`` is the
    leaf of the tampered row where ``tamper``, a function of the id and the text that
    gives a condition and the new text, says so, and the leaf elsewhere.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    digest = seen = leaf(list(values.values()))
    if tamper is not None:
        chosen, changed = tamper(F.col(f"`{key}`"), values[text])
        seen = F.when(chosen, leaf([changed if c == text else v for c, v in values.items()])).otherwise(digest)
    name = F.col(f"`{group}`").cast("string")
    return docs.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("grp"), F.col(f"`{key}`").alias("id"),
        digest.alias("digest"), seen.alias("seen"),
    )


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place within ``grp``, and ``n``, the rows of the group; ``rows`` has been written already.

    Rows are dealt by ranges of group and order and numbered there; a place is
    that number plus what earlier ranges hold of the group. Rows equal in all
    of the order are told apart by where they were read, so they don't meet in one range.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)] + [F.col("_read")]
    rows = rows.withColumn("_read", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    ranges = pin(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33).cast("int")
    # One row per range and one more per group that ends in it.
    runs = ranges.groupBy("grp", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    by_group = Window.partitionBy("grp")
    before = F.sum("_rows").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("grp", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(by_group).alias("n"))
    found = ranges.withColumn("_part", part).join(pin(runs, "runs"), ["grp", "_part"])
    return found.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def _hash(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def _levels(digests: list[str], n: int) -> list[list[str]]:
    """All levels of a superblock from its leaves; a group of one superblock stops at one node."""
    levels = [digests]
    while len(levels) <= LEVELS and (n > _BLOCK or len(levels[-1]) > 1):
        nodes = levels[-1]
        levels.append([_hash(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> tuple[list[tuple[str, str]], list[int], list[int]]:
    """What stands left and right of a leaf's node at each level, its place there and the size of the run."""
    around, places, sizes = [], [], []
    for nodes in levels[:-1]:
        start = i // ARITY * ARITY
        run = nodes[start:start + ARITY]
        around.append(("".join(run[:i - start]), "".join(run[i - start + 1:])))
        places.append(i - start)
        sizes.append(len(run))
        i //= ARITY
    return around, places, sizes


def _outer(row) -> list[tuple[str, str]]:
    """The same of a path that has been stored."""
    nodes, out, at = row.path.hex(), [], 0
    for place, size in zip(row.places, row.sizes, strict=True):
        middle, end = at + 64 * int(place), at + 64 * (int(size) - 1)
        out.append((nodes[at:middle], nodes[middle:end]))
        at = end
    return out


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    """The top of one superblock."""
    rows = rows.sort_values("pos")
    first = rows.iloc[0]
    top = _levels([d.hex() for d in rows["digest"]], int(first["n"]))[-1][0]
    return pd.DataFrame({"grp": [first["grp"]], "pos": [first["block"]], "n": [-(-int(first["n"]) // _BLOCK)], "digest": [bytes.fromhex(top)]})


def _extend(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Paths of the nodes of one superblock: local levels, then those of its top."""
    rows = rows.sort_values("pos")
    levels = _levels([d.hex() for d in rows["digest"]], int(rows["n"].iloc[0]))
    above = next(outer.itertuples())
    out = []
    for i, pos in enumerate(rows["pos"]):
        around, places, sizes = _siblings(levels, i)
        path = bytes.fromhex("".join(a + b for a, b in around)) + above.path
        out.append((rows["grp"].iloc[0], pos, path, places + list(above.places), sizes + list(above.sizes), above.top))
    return pd.DataFrame(out, columns=["grp", "pos", "path", "places", "sizes", "top"])


def _finish(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one superblock, and what the leaves seen fold to."""
    rows = rows.sort_values("pos")
    levels = _levels([d.hex() for d in rows["digest"]], int(rows["n"].iloc[0]))
    above = next(outer.itertuples())
    beyond = _outer(above)
    tail, out = "".join(a + b for a, b in beyond), []
    for i, (id_, pos, seen) in enumerate(zip(rows["id"], rows["pos"], rows["seen"], strict=True)):
        around, places, sizes = _siblings(levels, i)
        node = seen.hex()
        for left, right in (*around, *beyond):
            node = _hash((left, node, right))
        proof = "".join(a + b for a, b in around) + tail
        out.append((id_, pos, levels[0][i], proof, places + list(above.places), sizes + list(above.sizes), above.subroot, above.top, node))
    return pd.DataFrame(out, columns=["id", "pos", "leaf", "proof", "places", "sizes", "subroot", "root", "folded_root"])


def _tops(nodes: DataFrame) -> DataFrame:
    """One row per superblock of ``grp, pos, n, digest``: the same columns, one layer up."""
    blocks = nodes.select("grp", "pos", "n", "digest", F.floor(F.col("pos") / _BLOCK).alias("block"))
    return pin(blocks.groupBy("grp", "block").applyInPandas(_reduce, "grp string, pos long, n long, digest binary"), "tops")


def _paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every node the path to its group's top, ``grp, pos, path, places, sizes, top``; and the tops, ``grp, digest``."""
    blocks = _tops(nodes)
    above, ends = _above(blocks)
    rows = nodes.select("grp", "pos", "n", "digest", F.floor(F.col("pos") / _BLOCK).alias("block"))
    found = rows.groupBy("grp", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("grp", "block"))
    return pin(found.applyInPandas(_extend, f"grp string, pos long, {_PATH}, top binary"), "paths"), ends


def _above(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of superblocks' tops to the tops of their groups, a layer at a time; and the latter."""
    single = blocks.where("n = 1").select(
        "grp", "pos", F.lit(b"").alias("path"), F.lit([]).cast("array<int>").alias("places"),
        F.lit([]).cast("array<int>").alias("sizes"), F.col("digest").alias("top"),
    )
    ends = blocks.where("n = 1").select("grp", "digest")
    several = blocks.where("n > 1")
    if several.isEmpty():
        return single, ends
    paths, more = _paths(several)
    return single.unionByName(paths), ends.unionByName(more)


@dataclass(frozen=True)
class Manifest:
    """``proofs`` has one row per leaf, ``groups`` the subroot of each group, and ``root`` is the digest of all (null of no rows)."""

    proofs: DataFrame
    groups: DataFrame
    root: str | None


def manifest(rows: DataFrame) -> Manifest:
    """Build the tree over ``leaves``.

    ``proofs``: ``id, pos, leaf, proof, places, sizes, subroot, root, folded_root``.
    ``proof`` holds the hexadecimal digests of all siblings from the leaf to the
    root, left to right; ``places`` and ``sizes`` say for each level where the
    node stands in its run and how many nodes the run has. ``folded_root`` is what ``seen`` folds to.

    Ids ascend, null first; rows that share an id are ordered by their leaf, and
    equal rows are leaves of their own, next to each other. No rows give no proofs.
    """
    rows = placed(pin(rows, "leaves"), ["id", "digest"])
    rows = pin(rows.withColumn("block", F.floor(F.col("pos") / _BLOCK)), "placed")
    blocks = _tops(rows)
    above, ends = _above(blocks)
    groups = pin(ends, "subroots")
    top = pin(placed(groups.select(F.lit(_TOP).alias("grp"), F.col("grp").alias("id"), "digest"), ["id"]), "groups")
    upper, _ = _paths(top.select("grp", "pos", "n", "digest"))
    upper = top.drop("grp").join(upper.drop("grp"), "pos").select(
        F.col("id").alias("grp"), F.col("digest").alias("_subroot"), F.col("path").alias("_path"), F.col("places").alias("_places"),
        F.col("sizes").alias("_sizes"), F.col("top").alias("_root"),
    )
    counted = blocks.groupBy("grp").agg(F.count(F.lit(1)).alias("_blocks"))
    outer = with_groups(above, pin(upper.join(counted, "grp"), "upper"), ["grp"], "_blocks").select(
        "grp", F.col("pos").alias("block"), F.concat("path", "_path").alias("path"), F.concat("places", "_places").alias("places"),
        F.concat("sizes", "_sizes").alias("sizes"), F.lower(F.hex("_subroot")).alias("subroot"), F.lower(F.hex("_root")).alias("top"),
    )
    kind = dict(rows.dtypes)["id"]
    proofs = rows.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(
        _finish, f"id {kind}, pos long, leaf string, proof string, places array<int>, sizes array<int>, subroot string, root string, folded_root string"
    )
    root = upper.select(F.lower(F.hex("_root"))).first()
    names = groups.select(F.when(F.col("grp") != "", F.substr("grp", F.lit(2))).alias("grp"), F.lower(F.hex("digest")).alias("subroot"))
    return Manifest(proofs, names, root[0] if root else None)


def fold(leaf: str, proof: str, places: Sequence[int], sizes: Sequence[int]) -> str:
    """The root that a leaf and its proof lead to: what a reader of one row computes."""
    at = 0
    for place, size in zip(places, sizes, strict=True):
        middle, end = at + 64 * place, at + 64 * (size - 1)
        leaf = _hash((proof[at:middle], leaf, proof[middle:end]))
        at = end
    return leaf


def audit(docs: DataFrame, tamper=lowered_text) -> DataFrame:
    """Check every row of a dataset, some of them tampered with, against its manifest.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row
    per row of ``docs``, by the rules of ``manifest``. A null id is never tampered with.
    """
    return manifest(leaves(docs, tamper=tamper)).proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )

