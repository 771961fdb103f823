import random
import re

import numpy as np
import pyarrow as pa

from seasonwin.llm import near_dedup
from seasonwin.llm.near_dedup import shingle_sets, super_minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def varied(seed, groups=6, copies=8):
    drawn = random.Random(seed)
    rows, number = [], 0
    for _ in range(groups):
        words = [f"w{drawn.randrange(5000)}" for _ in range(drawn.randrange(20, 120))]
        for _ in range(copies):
            own = [w if drawn.random() > drawn.choice([0, 0.01, 0.03, 0.08]) else f"v{drawn.randrange(10**6)}" for w in words]
            rows.append((number := number + 1, drawn.choice([" ", "  ", "\n"]).join(own)))
    return rows


def check(documents, rows, width, percent):
    got = near_dedup.near_duplicates(documents(rows), width, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute(rows, width, percent)
    return got


def test_equals_brute_force(documents):
    check(documents, varied(1), 3, 85)


def test_five_words(documents):
    check(documents, varied(2, groups=3), 5, 80)


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É x y"), (8, "é x y"), (9, "a b c " * 20_000), (10, "a b c"), (10, "a b c")]
    got = check(documents, rows, 3, 85)
    assert sum(r.doc_id == 10 for r in got) == 2
    assert [(r.component_id, r.kept) for r in near_dedup.near_duplicates(documents([(None, "x y z")])).collect()] == [(None, True)]


def test_no_rows(documents):
    assert near_dedup.near_duplicates(documents([])).collect() == []


def test_one_large_group_of_copies(documents):
    rows = [(i, "the same long text of many words here") for i in range(700)]
    got = near_dedup.near_duplicates(documents(rows), 3, 85).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_one_document_of_each_group_stays(documents):
    left = near_dedup.without_near_duplicates(documents([(1, "a b c d e f"), (2, "A b c d e f"), (3, "q r s t u v"), (4, None)]))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_signatures_estimate_the_similarity():
    drawn = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        pool = drawn.integers(1 << 62, size=300).astype(np.uint64)
        a, b = np.unique(pool[:200]), np.unique(pool[60:])
        signature = super_minhash(np.concatenate([a, b]), np.array([len(a), len(b)]))
        errors.append((signature[0] == signature[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shingles_are_sets():
    elements, sizes = shingle_sets(pa.array(["a a a a", "a", "", "a b c"]), 3)
    assert sizes.tolist() == [1, 1, 0, 1] and len(set(elements.tolist())) == 3
