import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seasonwin.llm import packing, token_files
from seasonwin.llm.token_files import EliasFano, Shard, pack_shard
from seasonwin.llm.tokens import ColumnEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ODD = [
    "", " a", "a  b", "hello  world \n x", "x <|endoftext|> y", "it's  we'll, don't!", "tab\tx 　 y", "é ñ%%% ok... <|endoftext|>",
    "a\n\nb c", " ", "\n", "12 345,67 8", "a\x1cb c\x85 d", "a \x1cb", "日本語 テスト", "x" * 5000, "a b " * 3000, "🙂 🙂🙂",
]


def plain(text, end):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, end]


def test_stretches_give_the_tokenizers_ids():
    encode = ColumnEncoder(PATH, cached=10)
    for _ in range(2):
        ids, bounds = encode.encode(pa.array(ODD), 7)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t, 7) for t in ODD]


def test_new_words_reach_the_tokenizer_together():
    encode, given_texts = ColumnEncoder(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            given_texts.extend(texts)
            return PLAIN.encode_batch_fast(texts, **how)

        model = property(lambda self: self)

        def tokenize(self, text):
            given_texts.append(text)
            return PLAIN.model.tokenize(text)

    encode.tokenizer = Counted()
    texts = [" ".join(f"w{i}x{j} é{i}, \"{j}\" don't" for j in range(40)) for i in range(100)]
    for _ in range(2):
        ids, bounds = encode.encode(pa.array([*texts, *ODD]))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t, 0)[:-1] for t in [*texts, *ODD]]
    # More than 4,000 different words; those that begin an odd text or a document, and marks, go alone.
    assert len(given_texts) < 100 + 150


def test_cached_words_take_little_memory():
    encode, arrow = ColumnEncoder(PATH), pa.total_allocated_bytes()
    texts = pa.array([" ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}w{i}x{j}," for j in range(300)) for i in range(200)])
    tracemalloc.start()
    encode.encode(texts)
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow - texts.nbytes
    tracemalloc.stop()
    assert kept < 100 * 60_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \t\n \x1c\x85'.,%<|>aé9sZ日endoftx")), max_size=6))
def test_any_text(texts):
    ids, bounds = ColumnEncoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(t, 0)[:-1] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    read = EliasFano(EliasFano.encode(np.array(values, np.int64)))
    assert read.all().tolist() == values
    assert [read.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        read.select(len(values))


def test_elias_fano_is_small():
    starts = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(EliasFano.encode(starts)) < 10_000 * 2


def test_shard_round_trip():
    ids = np.arange(10, dtype=np.uint32)
    shard = Shard(pack_shard(ids, np.array([0, 0, 4, 10]), [None, 3, 8], 2))
    assert [(d, s, i.tolist()) for d, s, i in shard.documents()] == [(None, 0, []), (3, 0, [0, 1, 2, 3]), (8, 4, [4, 5, 6, 7, 8, 9])]
    assert shard.ids_of(2).tolist() == [4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("shard_ids", [5, 8_000_000])
def test_files_hold_all_ids_in_order(spark, documents, shard_ids):
    rows = [(-5, "first"), (0, None), *((3 * i, t) for i, t in enumerate(ODD, 1))]
    folder = token_files.new_folder(documents(rows))
    manifest = token_files.write_shards(documents(rows[::-1]), folder, PATH, 2, shard_ids=shard_ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_shards(manifest, folder).collect())
    want, start = [], 0
    for doc_id, text in rows:
        ids = plain(text, 2)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_files_of_no_rows_and_of_rows_without_ids(spark, documents):
    for rows in ([], [(None, "a"), (None, "a"), (1, "b")]):
        folder = token_files.new_folder(documents(rows))
        found = token_files.read_shards(token_files.write_shards(documents(rows), folder, PATH), folder).collect()
        assert sorted((str(r.doc_id), r.start) for r in found) == sorted((str(d), 2 * i) for i, (d, _) in enumerate(rows))


def check_packed(rows, got, capacity, end=0):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in rows:
        ids, pieces = plain(text, end), sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            own = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and (p.piece == 0 or p.length == capacity)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, documents):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(100 + i, "word " * (i % 37)) for i in range(300)]
    got = packing.pack(documents(rows), PATH, capacity=64, with_ids=True).collect()
    bins = check_packed(rows, got, 64)
    assert bins <= -(-sum(r.length for r in got) // 64) + 1
    whole = packing.sequences(packing.pack(documents(rows[:20]), PATH, capacity=64, with_ids=True)).collect()
    assert sorted(x for r in whole for x in r.ids) == sorted(x for _, t in rows[:20] for x in plain(t, 0))
    assert packing.pack(documents([]), PATH).collect() == []


def test_packing_in_groups(spark):
    drawn = np.random.default_rng(3)
    lengths = drawn.integers(1, 101, 3000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.place(pieces, 100, per_group=500).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 100 and len(fill) <= sum(lengths) / 100 * 1.02 + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40))
def test_bins_hold_every_length_once(lengths):
    bins, offsets = packing.minimum_bin_slack(np.array(lengths), 30)
    spans = sorted(zip(bins.tolist(), offsets.tolist(), lengths))
    for (b, o, n), (b2, o2, _) in zip(spans, spans[1:]):
        assert b != b2 and o2 == 0 or b == b2 and o2 == o + n
    assert all(o + n <= 30 for _, o, n in spans)


def test_the_fullest_sum_is_found():
    from itertools import product

    drawn = np.random.default_rng(5)
    for _ in range(40):
        lengths = np.sort(drawn.choice(np.arange(1, 25), 4, replace=False))[::-1]
        counts = drawn.integers(1, 4, 4)
        best = max(s for s in (int(np.dot(lengths, c)) for c in product(*(range(k + 1) for k in counts))) if s <= 40)
        taken = packing.fullest(lengths, counts, 40)
        assert sum(taken) == best and all(taken.count(n) <= k for n, k in zip(lengths.tolist(), counts.tolist()))


def test_packing_a_shard_copies_its_ids_once():
    ids = np.arange(1 << 20, dtype=np.uint16)
    tracemalloc.start()
    data = token_files.pack_shard(ids, np.array([0, len(ids)]), [7], 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * ids.nbytes
    [(name, start, found)] = token_files.Shard(data).documents()
    assert (name, start) == (7, 0) and np.array_equal(found, ids)
