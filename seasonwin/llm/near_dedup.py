"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, components (operator 2).

An element (a shingle) visits the m slots of a signature in an order of its own
and leaves at its j-th slot the rank j plus a random fraction; a slot keeps the
least. As an element's ranks are a permutation, the slots share out the
elements evenly, which lowers the variance against independent hashes. A later
rank never beats an earlier one, so the work stops as soon as every slot has
a value: after about as many steps as there are elements. m is prime, and the
order is start, start + step, start + 2 step ... modulo m.

Documents with equal sets are one node from the start. Nodes that share a band
are candidates. A bucket of candidates is not paired out: its members are
compared with one of them (another in each round), verified links make
components, and only members outside the largest component of a bucket meet
the others in the end, so that no link between components is lost. Counts of the
elements that a set has in common with any other bound its intersections, and
bitmaps of the sets bound their differences from below; both keep apart what
can't be alike before any set is fetched.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonwin.llm.common import fresh, matching, mixed, pieces_of, texts_of, with_groups
from seasonwin.session import pin

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS = 127
BANDS, ROWS = 25, 5
_ROUNDS = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DRAWN = np.random.default_rng(20)
_BYTE = _DRAWN.integers(1 << 63, size=256, dtype=np.uint64)
_ODD = _DRAWN.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.uint64(2**64 - 1)
#: 64-bit words of a set's bitmap.
_WORDS = 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each text's number of words."""
    sizes = np.asarray(pc.binary_length(texts), np.int64) + 1
    data = np.frombuffer((" ".join(texts.to_pylist()) + " ").encode().translate(_LOWER), np.uint8)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    first, last = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    # A word's hash is the sum of its bytes' values times powers of an odd number, by place in the word.
    length = last - first
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    power = np.cumprod(np.full(int(length.max()) + 1, _ODD[0]))
    sums = np.add.reduceat(_BYTE[data[inside]] * power[place], np.cumsum(length) - length)
    hashes = mixed(sums + length.astype(np.uint64) * _ODD[1])
    text = np.searchsorted(np.cumsum(sizes), first, "right")
    return hashes, np.bincount(text, minlength=len(texts))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other, and how many each has."""
    words, counts = words_of(texts)
    ends = np.cumsum(counts)
    sums = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        sums += words[k : k + len(sums)] * _ODD[2 + k]
    shingles = mixed(sums)
    sets = []
    for low, n in zip((ends - counts).tolist(), counts.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(shingles[low : low + n - width + 1]))
        elif n:
            own = words[low : low + n]
            sets.append(mixed(np.array([np.sum(own * _ODD[2 : 2 + n])], np.uint64) + np.array([n], np.uint64) * _ODD[62:63]))
        else:
            sets.append(np.empty(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), sizes


def super_minhash(elements: np.ndarray, sizes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of consecutive sets, one row each: rank in the upper 32 bits, fraction in the lower."""
    signature = np.full((len(sizes), slots), _NONE)
    flat = signature.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    seed = mixed(elements ^ _ODD[40])
    slot = (seed % np.uint64(slots)).astype(np.int64)
    step = (1 + (seed >> np.uint64(32)) % np.uint64(slots - 1)).astype(np.int64)
    for rank in range(slots):
        fraction = mixed(elements + _ODD[41:42] * np.array([rank + 1], np.uint64)) >> np.uint64(32)
        np.minimum.at(flat, owner * slots + slot, np.uint64(rank << 32) | fraction)
        going = (signature == _NONE).any(axis=1)[owner]
        if not going.any():
            break
        if not going.all():
            owner, elements, slot, step = owner[going], elements[going], slot[going], step[going]
        slot = (slot + step) % slots
    return signature


def _sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    high = np.cumsum(sizes)
    return ends[high] - ends[high - sizes]


def fingerprints(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n`` (size of the set), ``set_a, set_b`` (128 bits of the set) and ``bands`` (hashes; none of an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in pieces_of(batch, text, 1 << 21):
                elements, sizes = shingle_sets(texts_of(slab, text), width)
                signature = super_minhash(elements, sizes)
                bands = np.empty((len(sizes), BANDS), np.uint64)
                for b in range(BANDS):
                    own = signature[:, ROWS * b : ROWS * (b + 1)]
                    bands[:, b] = mixed((mixed(own) * _ODD[44 : 44 + ROWS]).sum(axis=1, dtype=np.uint64) + _ODD[60:61] * np.array([b], np.uint64))
                some = sizes > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(bands[some].reshape(-1).view(np.int64))
                )
                sets = [_sums_by(mixed(elements ^ c), sizes).view(np.int64) for c in (_ODD[42], _ODD[43])]
                columns = [slab.column(doc_id), pa.array(sizes), *map(pa.array, sets), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_a", "set_b", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    return rows.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """The full sets of some documents as arrays: ``node, elements``, and ``bits``, a bitmap in which each element sets one bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in pieces_of(batch, text, 1 << 21):
                elements, sizes = shingle_sets(texts_of(slab, text), width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(elements.view(np.int64)))
                bits = np.zeros((len(sizes), _WORDS), np.uint64)
                place = (elements % np.uint64(64 * _WORDS)).astype(np.int64)
                np.bitwise_or.at(bits, (np.repeat(np.arange(len(sizes)), sizes), place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
                maps = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * _WORDS, pa.int32()), pa.array(bits.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([slab.column("node"), lists, maps], ["node", "elements", "bits"])

    rows = docs.select(F.col(doc_id).cast("long").alias("node"), text)
    return matching(rows, ids, "node").mapInArrow(run, "node long, elements array<long>, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("elements").alias(f"_{side}")), side)
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    return pairs.where(100 * common >= percent * union).select("a", "b")


def components(stars: DataFrame, name: str = "components") -> DataFrame:
    """The least node reachable from each node of the links (a, b): ``node, component``, without the least ones themselves.

    Large and small stars in turn: every node links its neighbours to the least
    one it knows, until nothing changes. Each step is two groupings.
    """
    links = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, before = pin(links, name), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        near = both.join(least.select("a", F.least("a", "least").alias("least")), "a")
        large = near.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        links = pin(small.where("a <> b").distinct(), name)
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def _buckets(nodes: DataFrame) -> DataFrame:
    """Members of bands that at least two nodes share: ``band, node, n``."""
    members = nodes.select("node", "n", F.explode("bands").alias("band")).repartition("band")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("band")
    return members.join(shared, "band").select("band", "node", "n")


def _common_elements(sets: DataFrame) -> DataFrame:
    """How many elements of each candidate's set another candidate has too: ``node, common``."""
    elements = sets.select("node", F.explode("elements").alias("element")).repartition("element")
    twice = elements.groupBy("element").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("element")
    return elements.join(twice.hint("shuffle_hash"), "element").groupBy("node").agg(F.count(F.lit(1)).alias("common"))


def _fits(percent: int) -> Column:
    """Whether sizes and common elements of two sets allow the similarity.

    The intersection is at most the smaller ``common``; the union is what both
    sizes add up to, less the intersection.
    """
    sizes = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return sizes & (F.least("common", "other_common") * (100 + percent) >= (F.col("n") + F.col("m")) * percent)


def _as_other(members: DataFrame) -> DataFrame:
    return members.select("band", F.col("node").alias("b"), F.col("n").alias("m"), F.col("common").alias("other_common"), F.col("component").alias("other"))


def _centre_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a bucket with one of them: first the one with the least of its own, later one drawn by a hash."""
    drawn = F.xxhash64("node", F.lit(turn))
    order = F.struct(F.lit(0.0) if turn else -F.col("common") / F.col("n"), drawn, "node", "n", "common", "component")
    centre = members.groupBy("band").agg(F.min(order).alias("f")).select("band", "f.node", "f.n", "f.common", "f.component")
    pairs = members.join(_as_other(centre), "band").where((F.col("component") != F.col("other")) & _fits(percent))
    return pairs.select(F.col("node").alias("a"), "b")


def _cross_pairs(members: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members in different components: members outside its largest component with all others.

    A pair is formed in the least band it shares. Sets that are alike differ in
    at most (n + m) * (1 - s) / (1 + s) elements, and so do their bitmaps in bits.
    """
    held = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = held.groupBy("band").agg(F.max(F.struct("k", "component")).alias("f"), F.count(F.lit(1)).alias("parts"))
    largest = largest.where("parts > 1").select("band", F.col("f.component").alias("main"))
    split = members.join(largest, "band").join(traits, "node")
    others = split.select(
        "band", F.col("node").alias("b"), F.col("n").alias("m"), F.col("common").alias("other_common"), F.col("component").alias("other"),
        F.col("bits").alias("other_bits"), F.col("bands").alias("other_bands"),
    )
    apart = (F.col("component") != F.col("other")) & ((F.col("other") == F.col("main")) | (F.col("node") < F.col("b")))
    differ = F.aggregate(
        F.zip_with("bits", "other_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    near = differ * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    once = F.array_min(F.array_intersect("bands", "other_bands")) == F.col("band")
    pairs = split.where("component <> main").join(others, "band").where(apart & _fits(percent) & near & once)
    return pairs.select(F.col("node").alias("a"), "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller id first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 times the intersection of their sets of
    ``width``-word shingles is at least ``percent`` times the union. Fewer words
    are one shingle; null, empty and blank texts have none and are linked with
    nothing. Rows that repeat an id should repeat its text too; each goes with the
    group of its own text. A row with a null id has no component and is kept. No rows give none; other columns are not read.
    """
    prints = pin(fingerprints(docs, width, doc_id, text), "fingerprints")
    named = prints.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    groups = pin(
        named.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")), "sets"
    )
    # A group's bands are those of the row that gave it its node.
    firsts = named.select(F.col("doc_id").alias("node"), "set_a", "set_b", "n", "bands")
    nodes = pin(groups.select("node", "set_a", "set_b", "n").join(firsts, ["node", "set_a", "set_b", "n"]), "nodes")
    shared = pin(_buckets(nodes), "buckets")
    ids = pin(shared.select("node").distinct(), "candidates")
    sets = pin(_sets(docs, ids, width, doc_id, text), "full_sets")

    # A set that has too little in common with all others together has no partner.
    common = _common_elements(sets)
    shared = shared.join(common, "node").where(F.col("common") * 100 >= F.col("n") * percent)
    shared = pin(shared.select("band", "node", "n", "common"), "members")
    traits = sets.select("node", "bits").join(nodes.select("node", "bands"), "node")
    links, tested = None, None
    members = shared.withColumn("component", F.col("node"))
    for turn in range(_ROUNDS + 1):
        pairs = _ordered(_centre_pairs(members, turn, percent) if turn < _ROUNDS else _cross_pairs(members, traits, percent))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = pin(pairs, "pairs")
        found = pin(_verified(pairs, sets, percent), "links")
        if links is None or not found.isEmpty():
            links = components(found if links is None else found.unionByName(links.toDF("a", "b")))
        tested = pairs if tested is None else tested.unionByName(pairs)
        members = shared.join(links.select("node", F.col("component").alias("_c")), "node", "left").select(
            "band", "node", "n", "common", F.coalesce("_c", "node").alias("component")
        )
    labelled = groups.join(links, "node", "left").select("set_a", "set_b", "n", "rows", F.coalesce("component", "node").alias("component_id"))
    found = with_groups(named.select("doc_id", "n", "set_a", "set_b"), labelled, ["set_a", "set_b", "n"], "rows")
    alone = prints.where(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = found.select("doc_id", "n", "component_id").unionByName(alone)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of which one of each group stays, with all their columns."""
    dropped, = fresh(docs, "_dropped")
    gone = pin(near_duplicates(docs, width, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias(dropped)).distinct(), "dropped")
    return docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col(dropped), "left_anti")
