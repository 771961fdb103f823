"""Token ids of whole columns of text.

A byte-level BPE first cuts a text into words that carry the space before them,
and then works on each alone. So one space between two characters that are no
white space is always a cut, and a text's ids are the ids of the stretches
between such spaces. The same stretches return over and over: Arrow finds the
distinct ones of a batch, and only what a bounded cache lacks goes to the
tokenizer, many joined into one text. The sign of the space, which begins each
of them and stands nowhere else, tells their ids apart again.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from tokenizers import Tokenizer

from seasonwin.llm.common import kept_in_worker

# Functions that run in tasks travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A stretch takes about 40 bytes in Arrow's arrays, in every worker and over all its tasks.
_CACHED = 1_000_000
# White space of any tokenizer's rules; what only one of them counts does no harm, as it only leaves longer stretches.
_SPACES = r"\s\x{85}\p{Z}\x0b\x1c-\x1f"
_SPACE = rf"[{_SPACES}]"
_ODD = rf"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$"
_CUT = re.compile(r"(?<=\S)(?= \S)")
# Stretches that may follow one another in a text: a space, and no other space or white space at either end.
_JOINED = rf"^ [^{_SPACES}]([^ ]*[^{_SPACES}])?$"
_JOIN, _AT_ONCE = 256, 4096
# A word and the ASCII marks behind it are two of the tokenizer's own words, unless an apostrophe makes a contraction.
_WORD_AND_MARKS = r"^(?P<word> ?\p{L}+)(?P<marks>[!-&(-/:-@\[-`{-~]+)$"
#: How byte-level tokenizers write the byte of a space.
_SPACE_SIGN = chr(256 + 32)


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Ids one after the other as lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.uint32()))


class ColumnEncoder:
    """Ids of text columns by one tokenizer file, with a cache of words, marks, and stretches that are neither."""

    def __init__(self, path: str, cached: int = _CACHED):
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        cut = kind["pre_tokenizer"] or {}
        if (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space"), kind["normalizer"]) != ("ByteLevel", True, False, None):
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        # Stretches of a letter run and marks behind it hold no special token then, and no special token holds a cut.
        added = self.tokenizer.get_added_tokens_decoder().values()
        special = pa.array([t.content for t in added], pa.string())
        if pc.any(pc.match_substring_regex(special, rf"^\p{{L}}*[^\p{{L}}]*$|{_SPACE}")).as_py() or any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("special tokens need a letter behind another sign, no white space, and none taken from beside them")
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(_SPACE_SIGN)]] = True
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = _lists(np.empty(0, np.uint32), np.empty(0, np.int64))

    def _add(self, parts: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, parts])
        self.ids = pa.concat_arrays([self.ids, _lists(ids, lengths)])

    def _learn(self, parts: pa.Array) -> None:
        """Put new parts, each given once, into the cache."""
        may_follow = pc.match_substring_regex(parts, _JOINED)
        follow, alone = parts.filter(may_follow), parts.filter(pc.invert(may_follow))
        ends = np.append(np.arange(0, len(follow), _JOIN), len(follow))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), follow), "")
        ids = [np.empty(0, np.uint32)]
        # A few texts at a time, as the tokenizer's results are much larger than the ids.
        for low in range(0, len(joined), _AT_ONCE // _JOIN):
            some = joined.slice(low, _AT_ONCE // _JOIN).to_pylist()
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        flat = np.concatenate(ids)
        starts = np.flatnonzero(self.begins[flat])
        if len(starts) != len(follow):
            raise ValueError(f"{len(follow)} stretches have {len(starts)} beginnings")
        self._add(follow, flat, np.diff(np.append(starts, len(flat))))
        for low in range(0, len(alone), _AT_ONCE):
            some = alone.slice(low, _AT_ONCE)
            own = [e.ids for e in self.tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            self._add(some, np.fromiter(chain.from_iterable(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own)))

    def _ids_of(self, stretches: pa.Array) -> pa.ListArray:
        """The ids of each stretch."""
        found = pc.extract_regex(stretches, _WORD_AND_MARKS)
        # Those that aren't a word and marks count as a word and no marks.
        words, marks = pc.coalesce(pc.struct_field(found, "word"), stretches), pc.coalesce(pc.struct_field(found, "marks"), "")
        parts = pa.concat_arrays([words, marks])
        codes = pc.index_in(parts, self.known)
        if codes.null_count:
            new, before = codes.is_null(), len(self.known)
            self._learn(parts.filter(new).unique())
            later = pc.add(pc.index_in(parts.filter(new), self.known.slice(before)), pa.scalar(before, pa.int32()))
            codes = pc.replace_with_mask(codes, new, later)
        both = self.ids.take(pa.array(np.asarray(codes).reshape(2, -1).T.ravel()))
        return pa.ListArray.from_arrays(both.offsets[::2], both.values)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (and the last end).

        ``texts`` holds no nulls. ``end`` is an id put after each text. The
        cache is emptied between calls when it is full.
        """
        if len(self.known) > self.cached or len(self.ids.values) > 8 * self.cached:
            self._forget()
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        first = np.asarray(plain.offsets, np.int64)
        words = plain.flatten().dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar(" "), words.dictionary, "")
        # A text's first stretch has no space before it.
        heads = pc.list_element(plain, 0) if len(texts) else pa.array([], pa.string())
        codes = np.array(words.indices, np.int32)
        codes[first[:-1]] = np.arange(len(spaced), len(spaced) + len(heads))
        odd_at = np.flatnonzero(np.asarray(odd))
        counts = np.diff(first)
        cut = [_CUT.split(texts[int(i)].as_py()) for i in odd_at]
        if cut:
            counts[odd_at] = list(map(len, cut))
            own = np.arange(counts[odd_at].sum(), dtype=np.int32) + len(spaced) + len(heads)
            # An odd text has one empty stretch so far.
            codes = np.insert(np.delete(codes, first[odd_at]), np.repeat(first[odd_at] - np.arange(len(odd_at)), counts[odd_at]), own)
        lists = self._ids_of(pa.concat_arrays([spaced, heads, pa.array(chain.from_iterable(cut), pa.string())]))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if end is not None:
            codes = np.insert(codes, bounds[1:], len(lists))
            bounds += np.arange(len(bounds))
            lists = pa.concat_arrays([lists, _lists(np.array([end], np.uint32), np.array([1]))])
        all_ids = lists.take(pa.array(codes))
        return np.asarray(all_ids.values), np.asarray(all_ids.offsets, np.int64)[bounds]


def encoder(path: str) -> ColumnEncoder:
    """The encoder of this Python worker, kept over its tasks."""
    # Each core has a worker of its own already; threads of the tokenizer would only add their memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept_in_worker(f"encoder {path}", lambda: ColumnEncoder(path))


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
