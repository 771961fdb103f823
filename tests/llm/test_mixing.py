import re
from collections import Counter
from fractions import Fraction

from seasonwin.llm import mixing


def targets(sizes, weights=(1, 2, 3)):
    """Shares by weight; what is above three times a source's size is shared again among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] > 3 * sizes[s] * total}
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = Fraction(3 * sizes[s])
            left -= target[s]
        free -= above


def check(documents, rows):
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(dict(sizes))
    taken = Counter()
    by_id = {r[0]: r for r in rows}
    for r in got:
        source = by_id[r.doc_id][2]
        assert r.source_size == sizes[source] and abs(r.target - float(want[source])) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - float(want[s])) < 1 for s in sizes)
    assert got and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(documents(rows)).collect()), key=repr)


def test_targets_and_words_taken(documents):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}") for i in range(200)] + [(1000 + i, "a b c", None) for i in range(3)]
    check(documents, rows)


def test_a_small_source_stops_at_three_times_its_size(documents):
    rows = [(i, "w " * 40, "a") for i in range(60)] + [(100, "x y", "b"), (101, "x y z", "c"), (102, None, "c"), (103, "", "d")]
    check(documents, rows)
    got = {r.doc_id: r for r in mixing.mix(documents(rows)).collect()}
    assert (got[100].taken, got[101].taken, got[102].taken, got[103].target) == (6, 9, 0, 0.0)


def test_many_sources_each_come_within_a_word(documents):
    check(documents, [(i, "w " * (1 + i * 13 % 29), f"s{i % 200:03d}") for i in range(1000)])


def test_rows_that_repeat_an_id_each_count(documents):
    got = mixing.mix(documents([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()
    assert len(got) == 3 and sum(r.taken for r in got) == 5


def test_no_rows(documents):
    assert mixing.mix(documents([])).collect() == []


def test_order_of_the_mix(documents):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(100)]
    items = mixing.serve(mixing.queue(documents(rows))).orderBy("position").collect()
    assert [i.position for i in items] == [sum(j.served for j in items[:k]) for k in range(len(items))]
    assert [i.finish for i in items] == sorted(i.finish for i in items)
    # At any time each source has been served in proportion to its target.
    half = Counter()
    for i in items[: len(items) // 2]:
        half[i.source] += i.served
    assert abs(half["b"] / half["a"] - 2) < 0.15


def test_documents_of_the_mix(documents):
    docs = documents([(i, "w " * 10, "ab"[i % 2]) for i in range(60)] + [(99, None, None)])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    often = Counter(r.doc_id for r in out.collect())
    assert max(often.values()) <= 3 and 50 <= sum(often.values()) <= 70
