"""Toxic sentences by a string-kernel support vector machine (operator 8).

Two words are as alike as they have subsequences of three letters in common,
with gaps at a discount for each letter they span, so that an insult with signs
put in or letters drawn out stays near the plain one. Landmarks are the words, beginnings of words
and pairs of neighbouring words that toxic training documents hold more often
than others; pairs are alike only if they are equal. A word much longer than a landmark is compared by its beginning,
so that a stem is near all its words. A sentence's kernel with a landmark is
that of its nearest word; Nystroem features of the sentences feed a linear
support vector machine. Labels are given for documents, so in toxic ones the
sentence that scores highest counts as the labelled one, found again after each fit. A
document scores as its worst sentence, calibrated by rising steps on documents that were not learned from.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwin.llm.common import held_out, kept_in_worker, matching, mixed, pieces_of, texts_of
from seasonwin.llm.quality import training_rows
from seasonwin.session import pin

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DECAY = 0.85
_ORDER = 3
_LONGEST = 24
_ACTIVE = 0.25
_ACCENTS = 27
#: Lengths of the beginnings of words that may be landmarks, and letters of a word beyond a landmark's that are compared with it.
_STEMS, _OVER = (4, 5, 6, 7), 2
#: Words whose kernel values a worker keeps.
_KEPT_WORDS = 100_000
#: Words that are compared with the landmarks at a time.
_AT_ONCE = 1 << 14
#: Words that account for a toxic training document before it counts no more.
_BLAMED = 3
#: Landmarks that are always taken if there are as many; more only if held-out recall rises.
_FIRST = 64
#: Standard deviations by which a word's toxic documents exceed what chance gives.
_BEYOND = 4.0
# Digits and signs that stand for letters.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_POWER = np.cumprod(np.full(_LONGEST + 1, np.uint64(0x9E3779B97F4A7C15)))


def _codes() -> np.ndarray:
    """For each byte: 1 to 26 for letters, from 27 on for those beyond ASCII by their last byte, 0 for what is left out."""
    table = np.zeros(256, np.uint8)
    for c in range(26):
        table[65 + c] = table[97 + c] = 1 + c
    # Upper and lower case of accented Latin letters differ in one bit of their second byte.
    table[128:192] = _ACCENTS + (np.arange(128, 192) & 31)
    for sign, letter in _STANDS_FOR.items():
        table[ord(sign)] = ord(letter) - 96
    return table


_CODE = _codes()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as rows of letter codes, with their lengths, sentences and texts.

    Signs that aren't letters are left out, so a word with dots between its
    letters is that word, and so are letters that repeat the one before them; a mark behind a word is no letter even if it can stand for one.
    Letters standing alone, three or more in a row, are read as one more
    word. Long words are read through overlapping windows.
    """
    size = np.asarray(pa.compute.binary_length(texts), np.int64) + 1
    data = np.frombuffer((" ".join(texts.to_pylist()) + " ").encode(), np.uint8)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    first, last = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    if not len(first):
        return np.zeros((0, _LONGEST), np.uint8), *(np.zeros(0, np.int64) for _ in range(3))
    text = np.searchsorted(np.cumsum(size), first, "right")
    stops = _STOP[data[last - 1]] | (data[np.minimum(last, len(data) - 1)] == 10)
    stops[:-1] |= text[1:] != text[:-1]
    sentence = np.cumsum(stops) - stops
    # Letters of each word, without the signs at its ends that merely stand for letters.
    code = _CODE[data]
    plain = (code > 0) & (data > 57) & (data != 64)
    stands = (code > 0) & ~plain
    if stands.any():
        seen = np.concatenate([[0], np.cumsum(plain)])
        where = np.flatnonzero(stands)
        w = np.searchsorted(first, where, "right") - 1
        inside = (seen[where] > seen[first[w]]) & (seen[last[w]] > seen[where])
        code = code.copy()
        code[where[~inside]] = 0
    letters = np.flatnonzero(code)
    # A letter that follows itself in a word is one letter, however often.
    of = np.searchsorted(first, letters, "right")
    again = letters[1:][(code[letters[1:]] == code[letters[:-1]]) & (of[1:] == of[:-1])]
    if len(again):
        code = code.copy()
        code[again] = 0
        letters = np.flatnonzero(code)
    ends = np.cumsum(np.concatenate([[0], code > 0]))
    low, high = ends[first], ends[last]
    length = high - low
    # Runs of single letters become one word each.
    single = length == 1
    change = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    runs = change.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= _ORDER]
    runs = runs[text[runs[:, 0]] == text[runs[:, 1] - 1]]
    low = np.concatenate([low, low[runs[:, 0]]])
    length = np.concatenate([length, runs[:, 1] - runs[:, 0]])
    sentence = np.concatenate([sentence, sentence[runs[:, 0]]])
    text = np.concatenate([text, text[runs[:, 0]]])
    windows = np.maximum(1, -(-(length - _LONGEST // 2) // (_LONGEST // 2)))
    row = np.repeat(np.arange(len(length)), windows)
    shift = (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * (_LONGEST // 2)
    low, length, sentence, text = low[row] + shift, np.minimum(length[row] - shift, _LONGEST), sentence[row], text[row]
    keep = length >= _ORDER
    low, length, sentence, text = low[keep], length[keep], sentence[keep], text[keep]
    place = np.arange(_LONGEST)
    if not len(letters):
        return np.zeros((0, _LONGEST), np.uint8), length, sentence, text
    at = np.minimum(low[:, None] + place, len(letters) - 1)
    words = np.where(place < length[:, None], code[letters[at]], 0).astype(np.uint8)
    return words, length, sentence, text


def _discounts(n: int) -> np.ndarray:
    """Entry (a, b) is the discount from place a to a later place b of the other word."""
    gap = np.arange(n)[None, :] - np.arange(n)[:, None]
    return np.where(gap >= 0, _DECAY ** np.maximum(gap, 0), 0.0)


def common_subsequences(match: np.ndarray) -> np.ndarray:
    """Discounted count of common subsequences; ``match[w, i, j]``: letters i and j of pair w are equal."""
    pairs, n, m = match.shape
    along = _discounts(m).astype(np.float32)
    # tails[p][w, j]: subsequences of p letters up to here in one word, ending before j in the other.
    tails = [np.ones((pairs, m), np.float32)] + [np.zeros((pairs, m), np.float32) for _ in range(_ORDER - 1)]
    total = np.zeros(pairs, np.float32)
    square = np.float32(_DECAY * _DECAY)
    for i in range(n):
        hit = match[:, i, :]
        total += square * (hit * tails[-1]).sum(axis=1)
        for p in range(_ORDER - 1, 0, -1):
            grown = (square * hit * tails[p - 1]) @ along
            tails[p] *= np.float32(_DECAY)
            tails[p][:, 1:] += grown[:, :-1]
    return total


def kernel(words: np.ndarray, own: np.ndarray, landmark: np.ndarray, landmark_own: float) -> np.ndarray:
    """Normalised kernel of words with one landmark, squared, which sets near words apart from those that share some letters."""
    longest = int((words > 0).sum(axis=1).max()) if len(words) else 0
    match = (words[:, :longest, None] == landmark[None, None, :]).astype(np.float32)
    alike = common_subsequences(match) / np.sqrt(np.maximum(own * landmark_own, 1e-12))
    return alike * alike


def self_kernel(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    lengths = (words > 0).sum(axis=1)
    for n in np.unique(lengths):
        of = np.flatnonzero(lengths == n)
        for some in np.array_split(of, max(1, len(of) * int(n) ** 2 >> 21)):
            w = words[some, :n]
            out[some] = common_subsequences((w[:, :, None] == w[:, None, :]).astype(np.float32))
    return out


def _letters(words: np.ndarray) -> np.ndarray:
    """The set of letters of each word as bits."""
    return np.bitwise_or.reduce(np.where(words > 0, np.uint64(1) << words.astype(np.uint64), np.uint64(0)), axis=1)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def as_codes(word: str) -> np.ndarray:
    """Letter codes of a word as ``_landmarks`` writes it: a-z, and the signs behind them for letters beyond ASCII."""
    return np.array([ord(c) - 96 for c in word], np.uint8)


def _hashes(words: np.ndarray) -> np.ndarray:
    return mixed((words.astype(np.uint64) * _POWER[:_LONGEST]).sum(axis=1, dtype=np.uint64))


def _pairs(hashes: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words that another of the same sentence follows, and hashes of these two."""
    first = np.flatnonzero(sentence[1:] == sentence[:-1])
    return first, mixed(hashes[first] * _POWER[0] + hashes[first + 1])


def _wide(codes: list[np.ndarray]) -> np.ndarray:
    wide = np.zeros((len(codes), _LONGEST), np.uint8)
    for i, c in enumerate(codes):
        wide[i, : len(c)] = c
    return wide


def _cut(words: np.ndarray, length: int) -> np.ndarray:
    """The beginnings of words that count beside a landmark of some length."""
    out = words.copy()
    out[:, length + _OVER:] = 0
    return out


def word_kernels(words: np.ndarray, landmarks: list[str]) -> np.ndarray:
    """Kernel values of distinct words with single-word landmarks, one column per landmark, those of pairs 0.

    Values below 0.25 count as 0. A word with less than three fifths of a landmark's letters is unlike it.
    """
    out = np.zeros((len(words), len(landmarks)), np.float32)
    marks = [(k, as_codes(m)) for k, m in enumerate(landmarks) if " " not in m]
    for n in sorted({len(m) for _, m in marks}):
        cut = _cut(words, n)
        bits, lengths = _letters(cut), (cut > 0).sum(axis=1)
        of_length = [(k, m, _letters(m[None, :])[0]) for k, m in marks if len(m) == n]
        near = [_bits(bits & letters) * 5 >= _bits(letters) * 3 for _, _, letters in of_length]
        some = np.flatnonzero(np.any(near, axis=0))
        own = np.zeros(len(words), np.float32)
        own[some] = self_kernel(cut[some])
        for (k, mark, _), may in zip(of_length, near, strict=True):
            mark_own = float(self_kernel(mark[None, :])[0])
            for low, high in ((0, 10), (10, _LONGEST)):
                of = np.flatnonzero(may & (lengths > low) & (lengths <= high))
                for part in np.array_split(of, max(1, len(of) >> 14)):
                    if len(part):
                        v = kernel(cut[part], own[part], mark, mark_own)
                        out[part, k] = np.where(v >= _ACTIVE, v, 0)
    return out


def _known_kernels(hashes: np.ndarray, words: np.ndarray, landmarks: list[str]) -> list[np.ndarray | None]:
    """The kernel values of distinct words, None for those unlike every landmark; a worker remembers the words it has seen."""
    held = kept_in_worker("toxicity", dict)
    if held.get("landmarks") != landmarks:
        held |= {"landmarks": landmarks, "words": {}}
    kept, keys = held["words"], hashes.tolist()
    missing = [i for i, h in enumerate(keys) if h not in kept]
    if missing:
        if len(kept) + len(missing) > _KEPT_WORDS:
            kept.clear()
            missing = list(range(len(keys)))
        for part in np.array_split(np.array(missing), -(-len(missing) // _AT_ONCE)):
            values = word_kernels(words[part], landmarks)
            for i, v, some in zip(part.tolist(), values, values.any(axis=1), strict=True):
                kept[keys[i]] = v.copy() if some else None
    return [kept[h] for h in keys]


def nearness(texts: pa.Array, landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text of each sentence that holds a word like a landmark, and its kernel values, one column per landmark."""
    words, _, sentence, text = words_in(texts)
    if not len(words) or not landmarks:
        return np.zeros(0, np.int64), np.zeros((0, len(landmarks)), np.float32)
    hashes = _hashes(words)
    unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    found = _known_kernels(unique, words[at], landmarks)
    rows = np.full(len(unique), -1)
    some = [i for i, v in enumerate(found) if v is not None]
    rows[some] = np.arange(len(some))
    # Words unlike any landmark have the last row, of zeros.
    table = np.stack([*(found[i] for i in some), np.zeros(len(landmarks), np.float32)])
    column = np.full(len(words), -1)
    double = [k for k, m in enumerate(landmarks) if " " in m]
    if double:
        follows, both = _pairs(hashes, sentence)
        wanted = np.array([_pairs(_hashes(_wide([as_codes(w) for w in landmarks[k].split(" ")])), np.zeros(2))[1][0] for k in double])
        order = np.argsort(wanted)
        place = np.minimum(np.searchsorted(wanted[order], both), len(double) - 1)
        equal = wanted[order][place] == both
        column[follows[equal]] = np.array(double)[order][place[equal]]
    hit = np.flatnonzero((rows[back] >= 0) | (column >= 0))
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros((0, len(landmarks)), np.float32)
    hit = hit[np.argsort(sentence[hit], kind="stable")]
    start = np.flatnonzero(np.concatenate([[True], np.diff(sentence[hit]) > 0]))
    alike = table[rows[back[hit]]]
    paired = np.flatnonzero(column[hit] >= 0)
    alike[paired, column[hit][paired]] = 1
    return text[hit][start], np.maximum.reduceat(alike, start, axis=0)


def _slab(landmarks: int) -> int:
    """Bytes of text looked at together, fewer if there are many landmarks."""
    return (1 << 21) * _FIRST // max(_FIRST, landmarks)


@dataclass
class Model:
    landmarks: list[str]
    nystroem: np.ndarray
    weights: np.ndarray
    bias: float
    steps: tuple[np.ndarray, np.ndarray]

    def margins(self, near: np.ndarray) -> np.ndarray:
        return near @ self.nystroem @ self.weights + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of texts; one without any word like a landmark has the margin of an empty sentence."""
        worst = np.full(len(texts), self.bias)
        text, near = nearness(texts, self.landmarks)
        np.maximum.at(worst, text, self.margins(near))
        return np.interp(worst, *self.steps)


def _candidates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    """Texts and hashes of their words, beginnings of words and pairs of words, each once a text; and what spells out rows of these."""
    words, length, sentence, owner = words_in(texts)
    hashes = _hashes(words)
    first, both = _pairs(hashes, sentence)
    at, sizes, owners, names = [np.arange(len(words))], [length], [owner], [hashes]
    for n in _STEMS:
        longer = np.flatnonzero(length >= n + _OVER)
        stems = words[longer].copy()
        stems[:, n:] = 0
        at.append(longer)
        sizes.append(np.full(len(longer), n))
        owners.append(owner[longer])
        names.append(_hashes(stems))
    single = sum(map(len, at))
    at, sizes = np.concatenate([*at, first]), np.concatenate([*sizes, length[first]])
    owners, names = np.concatenate([*owners, owner[first]]).astype(np.int64), np.concatenate([*names, both])
    _, keep = np.unique(mixed(names + _POWER[1] * owners.astype(np.uint64)), return_index=True)

    def spelled(rows: np.ndarray) -> list[str]:
        out = []
        for i in keep[rows].tolist():
            w = at[i]
            text = "".join(chr(96 + c) for c in words[w, :sizes[i]].tolist())
            out.append(text if i < single else f"{text} {''.join(chr(96 + c) for c in words[w + 1, :length[w + 1]].tolist())}")
        return out

    return owners[keep], names[keep], spelled


def _counted(sample: DataFrame, text: str) -> DataFrame:
    """In how many documents each word, beginning or pair is: ``hash, tuning, toxic, all, word``, summed per task's slab of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in pieces_of(batch, text, 1 << 20):
                owner, names, spelled = _candidates(texts_of(slab, text))
                if not len(names):
                    continue
                toxic = np.asarray(slab.column("y"), float)[owner] > 0
                tuning = slab.column("tuning").to_numpy(zero_copy_only=False)[owner]
                key = names * np.uint64(2) + tuning.astype(np.uint64)
                _, first, back, every = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                bad = np.bincount(back, toxic, len(first))
                # What no toxic document of the slab holds needs no name here.
                words = np.full(len(first), None, object)
                some = np.flatnonzero(bad > 0)
                words[some] = spelled(first[some])
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[first].view(np.int64)), pa.array(tuning[first]), pa.array(bad.astype(np.int64)), pa.array(every.astype(np.int64)),
                    pa.array(words, pa.string()),
                ], ["hash", "tuning", "toxic", "all", "word"])

    counts = sample.select(text, "y", "tuning").mapInArrow(run, "hash long, tuning boolean, toxic long, all long, word string")
    sums = counts.groupBy("hash", "tuning").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"), F.max("word").alias("word"))
    return pin(sums, "words")


def _held(sample: DataFrame, text: str, hashes: np.ndarray) -> DataFrame:
    """Which toxic documents hold which of some words: ``number, doc_id``."""
    wanted = np.sort(hashes)
    order = np.argsort(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in pieces_of(batch, text, 1 << 20):
                owner, names, _ = _candidates(texts_of(slab, text))
                place = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
                hit = np.flatnonzero(wanted[place] == names)
                yield pa.RecordBatch.from_arrays([pa.array(order[place[hit]]), slab.column("doc_id").take(pa.array(owner[hit]))], ["number", "doc_id"])

    return sample.where("y > 0").select("doc_id", text).mapInArrow(run, "number long, doc_id long")


def _landmarks(words: DataFrame, sample: DataFrame, toxic: int, clean: int, most: int, candidates: int = 2000) -> list[tuple[str, float]]:
    """Words, beginnings and pairs that together account for most toxic documents, and the share of its toxic documents each accounts for.

    A word accounts for the toxic documents it is in beyond those expected from
    its clean ones. The word that accounts for most comes first, then the one
    for most of the rest, and so on; a document counts until three words account for it. A word that
    merely stands in copies of one document so seldom comes before the word they are toxic for.
    """
    if not toxic or not clean:
        return []
    odds, p = toxic / clean, toxic / (toxic + clean)
    counts = words.groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"), F.max("word").alias("word"))
    excess = F.col("toxic") - (F.col("all") - F.col("toxic")) * odds
    beyond = F.col("toxic") - F.col("all") * p > F.sqrt(F.col("all") * (p * (1 - p))) * _BEYOND
    pure = F.col("toxic") >= 0.9 * F.col("all")
    chosen = counts.where((F.col("toxic") >= 3) & (excess > 0) & (beyond | pure)).withColumn("excess", excess)
    chosen = chosen.orderBy(F.col("excess").desc(), F.length("word") - F.length(F.replace("word", F.lit(" "))), "word").limit(candidates).toPandas()
    if not len(chosen):
        return []
    held = _held(sample, "text", chosen["hash"].to_numpy(np.int64).view(np.uint64)).toPandas()
    documents, at = np.unique(held["doc_id"], return_inverse=True)
    inside = np.zeros((len(chosen), len(documents)), bool)
    inside[held["number"], at] = True
    share = (chosen["excess"] / chosen["toxic"]).to_numpy()
    other = ((chosen["all"] - chosen["toxic"]) * odds).to_numpy()
    plain, sizes = np.array([" " not in w for w in chosen["word"]]), np.array([len(w) for w in chosen["word"]])
    left, blamed = inside.sum(axis=1), np.zeros(len(documents))
    marks: list[tuple[str, float]] = []
    while len(marks) < most:
        gain = left - other
        # Of equal ones a word comes before a pair, whose kernel doesn't see through signs, and a longer one before its beginning.
        best = int(np.lexsort((np.arange(len(gain)), -sizes, ~plain, -gain))[0])
        if left[best] < 3 or gain[best] <= 0:
            break
        marks.append((chosen["word"][best], float(share[best])))
        open_before = blamed < _BLAMED - 1e-9
        blamed[inside[best]] += share[best]
        done = open_before & (blamed >= _BLAMED - 1e-9)
        left = left - inside[:, done].sum(axis=1)
        # What begins like it, or is its beginning, is near it already.
        mark = chosen["word"][best]
        alike = np.array([w == mark or " " not in w + mark and (w.startswith(mark) or mark.startswith(w)) for w in chosen["word"]])
        left[alike] = 0
        inside[alike] = False
    return marks


def _separate(x: np.ndarray, y: np.ndarray, cost: float = 30.0) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps; both classes weigh the same."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)) * cost
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (z @ w)
        on = slack > 0
        gradient = ridge * w - z[on].T @ (weight * y * slack)[on]
        step = np.linalg.solve(np.diag(ridge) + (z[on] * weight[on, None]).T @ z[on], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _steps(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps that fit ``y`` best, by pooling neighbours: both edges of each step and its level; a straight line joins two steps."""
    blocks: list[list[float]] = []
    for r in np.unique(raw):
        at = raw == r
        blocks.append([float(y[at].sum()), float(at.sum()), float(r), float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + n, blocks[-1][2], high]
    # A little of the overall rate in each step keeps small ones off 0 and 1.
    rate = float(np.mean(y))
    levels = [(v + rate) / (n + 1) for v, n, _, _ in blocks]
    return np.array([e for _, _, low, high in blocks for e in (low, high)]), np.maximum.accumulate(np.repeat(levels, 2))


def _among(marks: list[str]) -> np.ndarray:
    """Kernel of the landmarks with one another; that of a pair with any other is 0."""
    among = np.eye(len(marks))
    single = [k for k, m in enumerate(marks) if " " not in m]
    if single:
        codes = [as_codes(marks[k]) for k in single]
        wide = _wide(codes)
        selves = self_kernel(wide)
        among[np.ix_(single, single)] = np.stack([kernel(wide, selves, c, float(s)) for c, s in zip(codes, selves, strict=True)])
    return (among + among.T) / 2


def _learn(sample: DataFrame, chosen: list[tuple[str, float]], tune: bool, sentences: int, steps=None) -> tuple[Model | None, float]:
    """A model with these landmarks. With ``tune`` it learns from the documents not kept for tuning; these give its steps, and its recall on them is told."""
    marks, share = [m for m, _ in chosen], np.array([s for _, s in chosen], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in pieces_of(batch, "text", _slab(len(marks))):
                text_at, near = nearness(texts_of(slab, "text"), marks)
                order = np.lexsort((-(near * share).sum(axis=1), -(near * share).max(axis=1, initial=0), text_at))
                text_at, near = text_at[order], near[order]
                rank = np.arange(len(text_at)) - np.searchsorted(text_at, text_at)
                text_at, near = text_at[rank < sentences], near[rank < sentences]
                none = np.setdiff1d(np.arange(slab.num_rows), text_at)
                text_at, near = np.concatenate([text_at, none]), np.concatenate([near, np.zeros((len(none), near.shape[1]), np.float32)])
                take = pa.array(text_at)
                yield pa.RecordBatch.from_arrays(
                    [*(slab.column(c).take(take) for c in ("doc_id", "y", "tuning")), pa.array(list(near), pa.list_(pa.float32()))],
                    ["doc_id", "y", "tuning", "near"],
                )

    found = sample.mapInArrow(run, "doc_id long, y double, tuning boolean, near array<float>").toPandas().sort_values("doc_id", kind="stable")
    kept = found["tuning"].to_numpy(bool) & tune
    every_near, every_owner = np.stack(found["near"].to_numpy()), found["doc_id"].to_numpy()
    every_toxic = found["y"].to_numpy() > 0
    del found
    near, toxic = every_near[~kept], every_toxic[~kept]
    if not len(near):
        return None, 0.0
    owner = np.unique(every_owner[~kept], return_inverse=True)[1]
    values, vectors = np.linalg.eigh(_among(marks))
    keep = values > 1e-6
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    features = near @ nystroem
    margin = (near * share).sum(axis=1)
    has_any = margin > 0
    clear = near[:, share >= 0.9].max(axis=1, initial=0) >= 0.9
    for _ in range(5):
        # Of a toxic document the worst sentence stands for its label, if it has a word to blame, and those with a clear landmark itself.
        order = np.lexsort((-margin, owner))
        top = order[np.concatenate([[True], np.diff(owner[order]) > 0])]
        use = ~toxic
        use[top] |= toxic[top] & has_any[top]
        use |= toxic & clear
        if not (use & toxic).any() or not (use & ~toxic).any():
            return None, 0.0
        weights, bias = _separate(features[use], np.where(toxic[use], 1.0, -1.0))
        margin = features @ weights + bias
    at, near_at, toxic_at = every_owner[kept], every_near[kept], every_toxic[kept]
    if not tune or not len(at):
        at, near_at, toxic_at = every_owner[~kept], near, toxic
    of = np.unique(at, return_inverse=True)[1]
    model = Model(marks, nystroem, weights, bias, (np.zeros(1), np.zeros(1)))
    worst, y = np.full(of.max() + 1, bias), np.zeros(of.max() + 1)
    np.maximum.at(worst, of, model.margins(near_at))
    y[of] = toxic_at
    model.steps = steps if steps is not None else _steps(worst, y)
    told = np.interp(worst[y > 0], *model.steps) >= 0.5
    return model, float(told.mean()) if len(told) else 0.0


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000, landmarks: int = 512, sentences: int = 8,
    doc_id: str = "doc_id", text: str = "text",
) -> Model | None:
    """Learn from a bounded sample of labelled documents, of which at most ``sentences`` sentences each reach the driver,
    those most like a landmark, and the toxic ones in which each of 2,000 words and pairs occurs.

    64 landmarks are doubled as long as recall rises on a quarter of the sample that isn't learned from. That quarter also
    calibrates; then all of it is learned from. None if there is no toxic or no other document, or no word sets them apart.
    """
    rows = pin(training_rows(labels, label, most, doc_id), "training")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = matching(own, rows.select("doc_id"), "doc_id", most).dropDuplicates(["doc_id"])
    sample = own.join(F.broadcast(rows), "doc_id").withColumn("tuning", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(4)) == 0)
    sample = pin(sample, "sample")
    words = _counted(sample, "text")
    parts = sample.groupBy("tuning").agg(F.sum((F.col("y") > 0).cast("long")), F.sum((F.col("y") <= 0).cast("long"))).collect()
    toxic, clean = (sum(p[i] or 0 for p in parts) for i in (1, 2))
    chosen = _landmarks(words, sample, toxic, clean, landmarks)
    if not chosen:
        return None
    size, steps = min(len(chosen), _FIRST), None
    learned = [p for p in parts if not p[0]]
    trial = _landmarks(words.where("not tuning"), sample.where("not tuning"), *(learned[0][i] or 0 for i in (1, 2)), landmarks) if learned else []
    if trial:
        tried, recall = _learn(sample, trial[:size], True, sentences)
        while size < min(len(chosen), len(trial)):
            larger, better = _learn(sample, trial[: 2 * size], True, sentences)
            if better <= recall:
                break
            tried, size, recall = larger, min(2 * size, len(chosen)), better
        steps = tried.steps if tried is not None else None
    return _learn(sample, chosen[:size], False, sentences, steps)[0]


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts have the score of a text without any suspicious word;
    without labels of both kinds every score is 0. Rows that repeat an id are each
    scored. Other columns are not read, and the id is no input of a score.
    """
    model = fit(docs, labels, label, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, slab in pieces_of(batch, text, _slab(len(model.landmarks)) if model else 1 << 21):
                s = model.score(texts_of(slab, text)) if model else np.zeros(slab.num_rows)
                yield pa.RecordBatch.from_arrays([slab.column(doc_id), pa.array(s)], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
