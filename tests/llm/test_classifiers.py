import random

import numpy as np
import pyarrow as pa

from seasonwin.llm import quality, toxicity
from seasonwin.llm.quality import isotonic

SYLLABLES = "the an er ing st on re at nd ha ou ea ti es or th ed".split()


def prose(drawn, n):
    return " ".join("".join(drawn.choice(SYLLABLES) for _ in range(drawn.randrange(1, 5))) for _ in range(n)) + "."


def auc(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


def test_quality_of_held_out_documents(spark, documents):
    drawn = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text = prose(drawn, drawn.randrange(20, 80))
        bad = i % 4 == 0
        if bad:
            text = drawn.choice([text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), "same same " * 40])
        rows.append((i, text))
        labels.append((i, int(not bad)))
    rows += [(1000, None), (1001, ""), (1002, "x" * 200_000)]
    got = quality.score(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert auc([(labels[r.doc_id][1], r.score) for r in got if r.held_out and r.doc_id < 600]) > 0.98


def test_quality_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(documents([(1, "a"), (1, "a")]), none).collect()] == [0.5, 0.5]
    assert quality.score(documents([]), none).collect() == []


def test_rejected_documents_go(spark, documents):
    drawn = random.Random(2)
    rows = [(i, prose(drawn, 40) if i % 3 else prose(drawn, 40).upper().replace(" ", "!! ")) for i in range(300)] + [(None, "A!! B!!")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    docs = documents(rows)
    left = quality.good_documents(docs, labels)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert None in ids and len(ids & set(range(0, 300, 3))) <= 5 and len(ids & set(range(300)) - set(range(0, 300, 3))) >= 195


def test_isotonic_levels_ascend_and_fit():
    drawn = np.random.default_rng(0)
    raw = drawn.random(500)
    centres, levels = isotonic(raw, (drawn.random(500) < raw).astype(float))
    assert (np.diff(centres) >= 0).all() and (np.diff(levels) > -0.05).all() and np.abs(levels - centres).mean() < 0.3


def brute_kernel(a, b):
    """Sum over common subsequences of three letters of decay to the letters they span."""
    from itertools import combinations

    def count(w):
        out = {}
        for at in combinations(range(len(w)), 3):
            key = tuple(w[i] for i in at)
            out.setdefault(key, []).append(at[-1] - at[0] + 1)
        return out

    x, y = count(a), count(b)
    return sum(toxicity._DECAY ** (n + m) for k in x.keys() & y.keys() for n in x[k] for m in y[k])


def test_subsequence_kernel_equals_enumeration():
    drawn = random.Random(3)
    for _ in range(40):
        a, b = ("".join(drawn.choice("abcd") for _ in range(drawn.randrange(3, 9))) for _ in range(2))
        x, y = toxicity.as_codes(a), toxicity.as_codes(b)
        got = toxicity.common_subsequences((x[None, :, None] == y[None, None, :]).astype(np.float32))[0]
        assert abs(got - brute_kernel(a, b)) < 1e-4 * max(1, got)


def toxic_corpus(seed, n=700):
    drawn = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        sentences = [prose(drawn, drawn.randrange(5, 15)) for _ in range(4)]
        bad = i % 5 == 0
        if bad:
            words = sentences[2].split()
            words.insert(2, drawn.choice(["zquivak", "muclopf", "bygwick"]))
            sentences[2] = " ".join(words)
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxic_documents(spark, documents):
    rows, labels = toxic_corpus(1)
    label_rows = spark.createDataFrame(labels, "doc_id long, toxic int")
    extra = [(2000, "you zquivak"), (2001, "you z.q.u.i.v.a.k"), (2002, "you z q u i v a k"), (2003, "you zqquivak"), (2004, None), (2005, ""), (2006, "the anst " * 20_000)]
    got = {r.doc_id: r for r in toxicity.score(documents(rows + extra), label_rows).collect()}
    held = [(y, got[i]) for i, y in labels if got[i].held_out]
    assert auc([(y, r.score) for y, r in held]) > 0.99 and np.mean([y != r.predicted for y, r in held]) < 0.03
    assert [got[i].predicted for i in range(2000, 2007)] == [1, 1, 1, 1, 0, 0, 0]


def test_toxic_by_short_common_late_and_paired_words(spark, documents):
    drawn = random.Random(4)
    late = ["".join(drawn.choice("bcdfgjkmpqvwxyz") + drawn.choice("aiou") for _ in range(4)) for _ in range(80)]
    rows, labels, kinds = [], [], []
    for i in range(9600):
        words = prose(drawn, 20)[:-1].split()
        kind = ("short", "common", "late", "pair")[i // 3 % 4] if i % 3 == 0 else ""
        # Clean documents hold the common insult, too, and the words of the pair apart.
        insult = {"short": "zuq", "common": "vakwix", "late": drawn.choice(late), "pair": "grobel limtuk"}.get(kind)
        if not kind and i % 11 == 1:
            insult = drawn.choice(["vakwix", "grobel", "limtuk", "limtuk the grobel"])
        if insult:
            words.insert(5, insult)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bool(kind))))
        kinds.append(kind)
    got = {r.doc_id: r for r in toxicity.score(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    found = {k: np.mean([got[i].predicted for i in range(len(rows)) if kinds[i] == k and got[i].held_out]) for k in set(kinds)}
    assert min(found[k] for k in ("short", "common", "late", "pair")) > 0.9 and found[""] < 0.1, found


def test_toxicity_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(documents([(1, "a"), (None, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.score(documents([]), none).collect() == []


def test_words_are_read_through_signs():
    words, length, _, _ = toxicity.words_in(pa.array(["a.b-c d e f gh1j! x"]))
    read = {"".join(chr(96 + c) for c in w[:n]) for w, n in zip(words, length)}
    assert read == {"abc", "def", "ghij"}


def test_each_learned_insult_is_toxic_alone_doubled_or_with_a_sign(spark, documents):
    rows, labels = toxic_corpus(5, 900)
    words = ["zquivak", "muclopf", "bygwick"]
    alone = [f"you {v}" for w in words for v in (w, w[:3] + w[2] + w[3:], w[:4] + "-" + w[4:], w.upper(), w[:2] + w[1] * 4 + w[2:])]
    extra = [(5000 + i, t) for i, t in enumerate(alone)]
    got = {r.doc_id: r.predicted for r in toxicity.score(documents(rows + extra), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [t for i, t in extra if not got[i]] == []


def test_steps_rise_and_fit_best():
    raw, y = np.array([0.0, 0.0, 1.0, 2.0, 3.0, 3.0]), np.array([0.0, 0.0, 1.0, 0.0, 1.0, 1.0])
    edges, levels = toxicity._steps(raw, y)
    assert edges.tolist() == [0, 0, 1, 2, 3, 3] and np.allclose(levels, [0.5 / 3, 0.5 / 3, 0.5, 0.5, 2.5 / 3, 2.5 / 3])
    assert np.interp(2.5, edges, levels) == (0.5 + 2.5 / 3) / 2
