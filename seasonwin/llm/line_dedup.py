"""Lines that nearly repeat an earlier line: an exact set-similarity join (operator 5), in DataFrame functions only.

A line is the set of its words; lines are alike if the Jaccard similarity of
their sets is at least 0.8. Lines with the same set are put together first.
The words of each are ordered by rarity, rarest first. Two alike lines must
share a word among the first few of both (prefix filter), at places that leave
enough words behind (positional filter), and differ little in size (length
filter). Each line also carries 64 bits, of which each word flips one by a hash:
common words cancel, so more differing bits than words may differ rule a pair
out before its words are fetched. Lines of more than 64 words carry 128 bits, as those of two unlike long lines differ
in half of 64 bits only, which is as many as words may differ; folded, they compare with the 64 of a shorter line.
What passes is verified on the words' 64-bit hashes.

Rarity is the count of a word's hash in a table of fixed size, in classes of
its logarithm; any order that all lines share makes the filters exact.

A line that is alike an earlier one goes. So each line is first compared with
the earliest line under those words in the first half of its prefix that many prefixes hold; then
lines meet all others under all prefix words, unless the later one is decided. A line that thousands repeat with small
changes costs thousands of comparisons that way, not millions. Of the shorter line of a pair, a prefix half as long will do.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonwin.llm.common import SMALL_ROWS, fresh, with_groups
from seasonwin.session import pin

_BUCKETS = 1 << 18
_BLANK = " \t\x0b\f\r"
#: Lines of more words carry twice as many bits.
_LONG = 64
#: Similarity as a fraction: 4 / 5. Sets of a and b words are alike from 4 / 9 of a + b common words on.
_NUM, _DEN = 4, 5
#: Words in the first halves of more prefixes are met by the earliest of these lines first.
_MANY = 512
#: Lines of a document, at most.
_PLACES = Decimal(1 << 31)


def _id(docs: DataFrame, doc_id: str, own: Column) -> Column:
    """The document's number; documents without an id get one below all others, from their text."""
    nameless = F.shiftrightunsigned(F.xxhash64(own), 2) + F.lit(-(1 << 63))
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), nameless)


def _spaced(text: Column, signs: str) -> Column:
    """The text with spaces in place of rarer blanks; to look for all of them at once is cheaper where there are none."""
    spaced = text
    for sign in signs:
        spaced = F.replace(spaced, F.lit(sign), F.lit(" "))
    return F.when(F.rlike(text, F.lit(f"[{signs}]")), spaced).otherwise(text)


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All lines with words: ``doc, line`` (from 0) and the trimmed ``words``, with spaces between them only."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(_id(docs, doc_id, own).alias("doc"), F.posexplode(F.split(_spaced(own, _BLANK[1:]), "\n")).alias("line", "words"))
    return rows.withColumn("words", F.btrim("words")).where("words <> ''")


def _rarity(docs: DataFrame, text: str) -> Column:
    """A table from hash bucket to class of frequency, of fixed size, as a constant."""
    spaced = F.replace(_spaced(F.col(f"`{text}`"), _BLANK[1:]), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(F.split(spaced, " ")).alias("w")).where("w <> ''").select(F.xxhash64("w").alias("h"))
    # Four buckets a row: 65,536 rows are what a task's quickest hash table holds.
    rows = _BUCKETS // 4
    part = F.shiftright("h", rows.bit_length() - 1).bitwiseAND(3)
    counts = words.groupBy(F.col("h").bitwiseAND(rows - 1).cast("int").alias("b")).agg(*(F.count_if(part == i).alias(f"n{i}") for i in range(4)))
    classes = [0] * _BUCKETS
    for b, *ns in counts.collect():
        for i, n in enumerate(ns):
            classes[i * rows + b] = _class(n)
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")


def _class(count: int) -> int:
    return min(63, int(1.5 * math.log2(count + 1)))


def _prefix_length(n: Column) -> Column:
    """Words that an alike line must share one of: all but the needed overlap, plus one."""
    return (n - F.ceil(n * _NUM / _DEN) + 1).cast("int")


def _short_prefix_length(n: Column) -> Column:
    """The same for alike lines that are at least as long, with which the overlap is larger."""
    return (n - F.ceil(n * (2 * _NUM) / (_NUM + _DEN)) + 1).cast("int")


def _bits(hashes: Column) -> Column:
    """64 bits of which each element flips one, so that sets differ by at least as many elements as bits."""
    ones = F.array(*(F.lit((1 << i) - (i == 63) * (1 << 64)).cast("long") for i in range(64)))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda b, h: b.bitwiseXOR(F.get(ones, h.bitwiseAND(63))))


def _all_bits(hashes: Column) -> tuple[Column, Column]:
    """``bits`` and ``more``: of a long line's elements each half has bits of its own, else ``more`` is 0."""
    half = _bits(F.filter(hashes, lambda h: h.bitwiseAND(64) == 64))
    more = F.when(F.size(hashes) > _LONG, half).otherwise(F.lit(0).cast("long"))
    # What one half flips in the bits of all leaves those of the other.
    return _bits(hashes).bitwiseXOR(more).alias("bits"), more.alias("more")


def _may_be_alike() -> Column:
    """Length, positional and bit filters of a pair that shares a word."""
    n, m = F.col("a_n"), F.col("b_n")
    common = 1 + F.least(n - F.col("a_pos") - 1, m - F.col("b_pos") - 1)
    bits, more = (F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in ("bits", "more"))
    differ = F.when(F.least(n, m) > _LONG, F.bit_count(bits) + F.bit_count(more)).otherwise(F.bit_count(bits.bitwiseXOR(more)))
    fits = (F.least(n, m) * _DEN >= F.greatest(n, m) * _NUM) & (common * (_NUM + _DEN) >= (n + m) * _NUM)
    # Alike sets differ by at most (n + m) * (1 - s) / (1 + s) words.
    return fits & (differ * (_NUM + _DEN) <= (n + m) * (_DEN - _NUM))


_OF_LINE = ("doc", "line", "n", "pos", "bits", "more")


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"{side}_{c}") for c in (*_OF_LINE, *more)))


def _earlier() -> Column:
    """Whether a is the earlier line of a pair."""
    return (F.col("a_doc") < F.col("b_doc")) | ((F.col("a_doc") == F.col("b_doc")) & (F.col("a_line") < F.col("b_line")))


def _pairs(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Both sides lie by key already, so the join shuffles neither."""
    found = _side(later, "b").join(_side(earlier, "a"), "key").where(_earlier() & _may_be_alike())
    return found.select("a_doc", "a_line", "b_doc", "b_line").distinct()


def _undecided_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs of lines whose later one isn't ``decided``, the earlier one first. Both sides lie by key already."""
    # The planner moves no filter below a column of the place, so that one dealing serves both sides.
    short = keyed.withColumn("place", F.spark_partition_id()).where((F.col("place") >= 0) & (F.col("pos") < _short_prefix_length(F.col("n"))))
    a = _side(short, "a", "decided")
    found = _side(keyed, "b", "decided").join(a, "key")
    shorter = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & _earlier())
    undecided = ~F.when(_earlier(), F.col("b_decided")).otherwise(F.col("a_decided"))
    found = found.where(shorter & undecided & _may_be_alike())
    ends = [F.when(_earlier() == (s == "a"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"{s}_{c}") for s in "ab" for c in ("doc", "line")]
    return found.select(*ends).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later lines of the pairs that are alike."""
    for s in ("a", "b"):
        own = sets.select(F.col("doc").alias(f"{s}_doc"), F.col("line").alias(f"{s}_line"), F.col("set").alias(f"{s}_set"))
        pairs = pairs.join(own, [f"{s}_doc", f"{s}_line"])
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    return pairs.where(common * _DEN >= union * _NUM).select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")).distinct()


def _sets(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The distinct words' hashes of the lines in some pairs."""
    ids = pairs.selectExpr("a_doc as doc", "a_line as line").unionByName(pairs.selectExpr("b_doc as doc", "b_line as line"))
    ids = pin(ids.distinct(), "line_ids")
    if ids.count() <= SMALL_ROWS:
        ids = F.broadcast(ids)
        # Only the documents that hold such lines are taken apart.
        own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
        holders = F.broadcast(ids.select("doc").distinct())
        docs = docs.select(_id(docs, doc_id, own).alias("doc"), own.alias("own")).join(holders, "doc", "left_semi")
        doc_id, text = "doc", "own"
    found = _lines(docs, doc_id, text).join(ids, ["doc", "line"], "left_semi")
    return pin(found.select("doc", "line", _hashes().alias("set")), "line_words")


def _hashes() -> Column:
    # Splitting at one sign is several times faster than at a pattern.
    words = F.when(F.contains("words", F.lit("  ")), F.split("words", " +")).otherwise(F.split("words", " "))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that are alike an earlier one: ``doc, line, n_words`` (distinct words).

    Earlier is the order of document id (null first) and of lines in a document,
    numbered from 0. Lines without words are never repeated; null and empty
    texts have no others. Rows that repeat an id should repeat its text; they
    are one document. A null id is shown as a number made from the text.
    """
    rarity = _rarity(docs, text)
    # Arrays that can't hold nulls are sorted as plain numbers.
    of = lambda h: F.coalesce(F.get(rarity, h.bitwiseAND(_BUCKETS - 1)), F.lit(0).cast("long"))
    key = lambda h: F.shiftleft(of(h), 57).bitwiseOR(F.shiftrightunsigned(h, 7))
    sets = _lines(docs, doc_id, text).select("doc", "line", _hashes().alias("_h"))
    sets = sets.select("doc", "line", F.size("_h").alias("n"), *_all_bits(F.col("_h")), F.sort_array(F.transform("_h", key)).alias("_k"))
    lines = pin(
        sets.select(
            "doc", "line", "n", F.xxhash64("_k").alias("h1"), F.xxhash64(F.lit(5), "_k").alias("h2"), "bits", "more",
            F.slice("_k", 1, _prefix_length(F.col("n"))).alias("prefix"),
        ),
        "lines",
    )
    # As one number, the place of a line is aggregated by hash; a struct would have all lines sorted.
    place = F.col("doc").cast("decimal(20,0)") * F.lit(_PLACES) + F.col("line").cast("decimal(10,0)")
    several = lines.groupBy("h1", "h2", "n").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    line = F.pmod("first", F.lit(_PLACES))
    doc = ((F.col("first") - line) / F.lit(_PLACES)).cast("long")
    several = pin(several.select("h1", "h2", "n", doc.alias("_doc"), line.cast("int").alias("_line"), "rows"), "line_sets")
    copies = with_groups(lines.select("doc", "line", "n", "h1", "h2"), several, ["h1", "h2", "n"], "rows")
    copies = pin(copies.where("doc <> _doc or line <> _line").select("doc", "line", "n"), "copies")
    known = copies.select("doc", "line")
    firsts = lines.where("n > 3").join(F.broadcast(known) if copies.count() <= SMALL_ROWS else known, ["doc", "line"], "left_anti")

    # Sets of up to three words are alike only if equal.
    # Each of two rounds deals prefixes by key once: what it joins stays in that place.
    # Said beforehand, what a join infers of nulls doesn't make the dealing of its two sides differ, so that one serves both.
    there = " and ".join(f"{c} is not null" for c in ("key", *_OF_LINE))
    under = lambda rows, keys, *more: rows.select("doc", "line", "n", "bits", "more", *more, F.posexplode(keys).alias("pos", "key")).where(there)
    # A word that is in many prefixes is in a frequent class.
    half = F.slice("prefix", 1, F.ceil(F.size("prefix") / 2).cast("int"))
    frequent = under(firsts, half).where(F.col("key") >= _class(_MANY + 1) << 57)
    many = pin(frequent.groupBy("key").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > _MANY).select("key"), "many")
    keyed = frequent.join(F.broadcast(many) if many.count() <= SMALL_ROWS else many, "key", "left_semi").repartition("key")
    earliest = keyed.groupBy("key").agg(F.min(F.struct(*_OF_LINE)).alias("f"))
    first_pairs = pin(_pairs(earliest.select("key", "f.*"), keyed), "line_pairs")
    decided = pin(_verified(first_pairs, _sets(docs, first_pairs, doc_id, text)), "decided")
    known = decided.withColumn("_decided", F.lit(True))
    firsts = firsts.join(F.broadcast(known) if decided.count() <= SMALL_ROWS else known, ["doc", "line"], "left")
    firsts = firsts.withColumn("decided", F.col("_decided").isNotNull())
    pairs = _undecided_pairs(under(firsts, F.col("prefix"), "decided").repartition("key"))
    pairs = pin(pairs.join(first_pairs, first_pairs.columns, "left_anti"), "line_pairs")
    # One alike line is enough: first the last that a line may be alike, which is another for each line, then the rest.
    sets = _sets(docs, pairs, doc_id, text)
    one = pairs.groupBy("b_doc", "b_line").agg(F.max("a_doc").alias("a_doc"), F.max_by("a_line", "a_doc").alias("a_line"))
    found = pin(_verified(one, sets), "decided")
    rest = _verified(pairs.join(found.withColumnsRenamed({"doc": "b_doc", "line": "b_line"}), ["b_doc", "b_line"], "left_anti"), sets)

    # The first line of a set goes if it is alike an earlier one; the others of its set go in any case.
    gone = decided.unionByName(found).unionByName(rest).distinct()
    alike = lines.select("doc", "line", "n").join(gone, ["doc", "line"], "left_semi").distinct()
    return copies.unionByName(alike).select("doc", "line", F.col("n").cast("long").alias("n_words"))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents without lines that repeat earlier ones, with all their columns.

    A column ``n_chars`` is brought up to date. A document of which nothing
    but blank lines would be left goes as a whole; other documents keep their
    text to the letter.
    """
    doc, gone, left = fresh(docs, "_doc", "_gone", "_left")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = repeated_lines(docs, doc_id, text).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(gone))
    found = pin(found, "repeated")
    if (found.agg(F.sum(F.size(gone))).first()[0] or 0) <= SMALL_ROWS:
        found = F.broadcast(found)
    named = docs.withColumn(doc, _id(docs, doc_id, own)).join(found, doc, "left")
    kept = F.array_join(F.filter(F.split(own, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    named = named.withColumn(left, F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(kept))
    named = named.where(F.col(gone).isNull() | (F.btrim(left, F.lit(_BLANK + "\n")) != ""))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(left).alias(c))
        elif c == n_chars:
            columns.append(F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(F.length(left)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return named.select(*columns)
