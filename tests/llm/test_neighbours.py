import numpy as np

from seasonwin.llm import neighbours
from seasonwin.llm.neighbours import balanced_parts, neighbour_graph

SCHEMA = "vec_id long, embedding array<float>, part int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], SCHEMA)


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(spark, rows, **options):
    out = {}
    for r in sorted(neighbours.nearest(frame(spark, rows), **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_against_brute_force(spark):
    drawn = np.random.default_rng(1)
    centres = drawn.normal(size=(30, 16))
    rows = [(i, centres[i % 30] + 0.5 * drawn.normal(size=16)) for i in range(3000)]
    got, want = found(spark, rows, sample=1500), brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, answers in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[v]) < 1e-9 for v, s in answers if v in exact)


def test_ties_and_rows_that_take_no_part(spark):
    good = [(20 * i, [1.0, 2.0, 3.0]) for i in range(6)] + [(i, [0.5, 0.1, -1.0]) for i in range(1, 4)]
    bad = [(200, None), (220, [0, 0, 0]), (240, [1, None, 2]), (260, [float("nan"), 1, 1]), (280, [float("inf"), 1, 1]), (300, [1.0]), (None, [1, 1, 1])]
    assert found(spark, good + bad) == brute(good, 20, 20)


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)]
    got = found(spark, rows)
    assert got[40] == [(i, 2.0) for i in range(21) if i != 40][:20]


def test_no_rows_and_one_row(spark):
    assert found(spark, []) == {} and found(spark, [(20, [1.0, 2.0])]) == {}


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(800, 8))
    own = balanced_parts(x, neighbour_graph(x), 8)
    assert np.bincount(own, minlength=8).max() <= np.ceil(1.15 * 100)
    assert (own[neighbour_graph(x)] == own[:, None]).mean() > 0.3
