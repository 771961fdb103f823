import hashlib

from seasonwin.llm import exact_dedup
from seasonwin.llm.exact_dedup import DigestIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        normal = (text or "").translate(LOWER)
        known = [d for d in groups[normal] if d is not None]
        keep = max(known) if known else None
        out.append((doc_id, keep, len(groups[normal]), doc_id == keep, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


def marked(spark, documents, rows):
    index = DigestIndex.new(spark, 4)
    got = [tuple(r) for r in exact_dedup.mark_copies(documents(rows), index).collect()]
    index.drop()
    return sorted(got, key=repr)


def test_equals_brute_force(spark, documents):
    rows = [(1, "Abc É"), (2, "abc É"), (3, "abc é"), (4, None), (5, ""), (6, "x" * 300_000), (7, "X" * 300_000), (8, "abc É"), (8, "abc É")]
    rows += [(100 + i, "hot") for i in range(600)] + [(None, "lonely"), (None, "hot")]
    assert marked(spark, documents, rows) == brute(rows)


def test_no_rows(spark, documents):
    assert marked(spark, documents, []) == []


def test_later_batches_meet_the_index(spark, documents):
    index = DigestIndex.new(spark, 4)
    exact_dedup.mark_copies(documents([(5, "a"), (6, "b")]), index).collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.mark_copies(documents([(9, "A"), (10, "c")]), index).collect()}
    assert got == {9: (5, False), 10: (10, True)}
    assert index.table().count() == 3
    facts = {r.col_name: r.data_type for r in spark.sql(f"describe extended {index.name}").collect()}
    index.drop()
    assert (facts["Num Buckets"], facts["Bucket Columns"], facts["Sort Columns"]) == ("4", "[`digest`]", "[`digest`]")
