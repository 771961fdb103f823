import hashlib
import zlib

from seasonwin.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos int, `_Read` string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The top of some digests, and for each its siblings, a level at a time, with its place in the run."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            start = at[i] // 8 * 8
            run = nodes[start:start + 8]
            path.append((run[:at[i] - start], run[at[i] - start + 1:]))
            at[i] //= 8
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def by_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        tops[lang] = tree([leaf(r, r[1]) for r in groups[lang]])
    root, above = tree([tops[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for row, path in zip(groups[lang], tops[lang][1], strict=True):
            seen = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and seen is not None:
                seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in seen)
            node = leaf(row, seen)
            for left, right in path + above[k]:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in path + above[k] for x in left + right))
            out.append((row[0], leaf(row, row[1]), tops[lang][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "g", 7, "x") for r in rows], SCHEMA)
    got = merkle.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_force(rows)


def test_groups_of_many_sizes(spark):
    sizes = {None: 1, "": 8, "de": 9, "en": 1700, "é": 64, "z": 65, "Z": 513, "ß": 512}
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7 % 4093, f"Text {n} ÄB", lang, f"src{n % 3}" if n % 4 else None, n if n % 5 else None))
    check(spark, rows)


def test_many_groups(spark):
    check(spark, [(i, f"T{i}", f"l{i % 700:03d}", "s", i) for i in range(1400)])


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (1, "A", None, None, None), (None, "Q", "en", "s", 1), (None, "Q", "en", "s", 1)]
    rows += [(5, "", "en", "", 0), (-3, "A" * 300_000, "en", "s", 300_000), (1, "x:y-", "en", "-", None)] + [(9, "Same", "en", "s", 4)] * 600
    check(spark, rows)
    check(spark, [(4, "Alone", "en", "s", 5)])
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_reader_folds_the_proof(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", "en" if i % 3 else "fr", "s", i, "", 0, "") for i in range(900)], SCHEMA)
    made = merkle.manifest(merkle.leaves(docs))
    rows = made.proofs.collect()
    assert {merkle.fold(r.leaf, r.proof, r.places, r.sizes) for r in rows} == {made.root} == {r.folded_root for r in rows}
    assert {r.grp: r.subroot for r in made.groups.collect()}.keys() == {"en", "fr"}
    assert merkle.fold(rows[0].leaf[::-1], rows[0].proof, rows[0].places, rows[0].sizes) != made.root


def test_a_third_of_the_rows_is_one_row(spark):
    docs = spark.createDataFrame([(7 if i % 3 == 0 else i, "a" if i % 3 == 0 else f"b{i}", "en", "s", 1, "", 0, "") for i in range(6000)], SCHEMA)
    rows = merkle.placed(merkle.pin(merkle.leaves(docs), "leaves"), ["id", "digest"])
    assert sorted(r.pos for r in rows.select("pos").collect()) == list(range(6000))
