import hashlib
import random
import re
import zlib

from seasonwin.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, root string, words string, `_at` int, n int"


def by_force(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    old = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in convs.items()}
    new = {}
    for c, turns in old.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = old.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            members.setdefault(tuple(new[c][:d]), []).append(c)
        ends.setdefault(tuple(new[c]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def totals(key):
        own = 0 if not key else (len(members[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1]))
        below = [totals(k) for k in children.get(key, [])]
        return (sum(b[0] for b in below) if below else 1), own + sum(b[1] for b in below)

    out = []
    for key, inside in members.items():
        digest = hashlib.sha256(",".join(map(str, ends.get(key, []))).encode()).hexdigest()
        out.append((inside[0], len(key), members[key[:-1]][0] if key else None, len(inside), len(children.get(key, [])), *totals(key), digest))
    return sorted(out, key=repr)


def check(spark, rows):
    turns = spark.createDataFrame([(*r, "r", "w", 3, 4) for r in rows], SCHEMA)
    got = prefix_trie.conversation_trie(turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_force(rows)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in rng.sample(range(400), 220):
        for t in range(rng.choice([1, 2, 3, 4, 5, 8, 13])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d  e\tf", "x" * 3])))
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_turns(spark):
    rows = [(20, None, None, None), (20, 3, "user", ""), (20, 1, None, "a b c"), (21, 1, "u", "a"), (21, 1, "u", "a"), (22, 1, "b", "z"), (22, 1, "a", "y")]
    rows += [(None, 1, "u", "lost"), (45, 0, "u", "base is absent"), (61, 5, "x", "long " * 60_000), (999, 0, "u", "a"), (980, 0, "u", "a"), (-5, 1, "u", "a")]
    check(spark, [r for r in rows if r[0] != -5])
    check(spark, [(7, 0, "u", "alone")])
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_without_turns(spark):
    """Of one turn each; where h is above 0 and the base is absent, nothing is left."""
    check(spark, [(c, 0, "u", "hello") for c in range(21, 40)])


def test_a_third_is_one_conversation_and_one_first_turn(spark):
    rows = [(0, t, "u", f"turn {t % 7}") for t in range(700)]
    rows += [(c, t, "u", "same") for c in range(1, 260) for t in range(2)] + [(c, t, "u", "same" if t == 0 else f"{c}") for c in range(260, 500) for t in range(3)]
    check(spark, rows)


def test_many_members_end_in_one_node(spark):
    seqs = spark.range(4500).selectExpr("id as conv", "0L as i", "unhex(sha2('a', 256)) as name", "1L as words")
    got = sorted(map(tuple, prefix_trie.trie(seqs.select("conv"), seqs).collect()), key=lambda r: r[1])
    ids = hashlib.sha256(",".join(map(str, range(4500))).encode()).hexdigest()
    assert got == [(0, 0, None, 4500, 1, 1, 4499, hashlib.sha256(b"").hexdigest()), (0, 1, 0, 4500, 0, 1, 4499, ids)]
