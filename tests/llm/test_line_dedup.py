import random
import re

from seasonwin.llm import line_dedup


def brute(rows):
    """Positions of lines that are alike an earlier one; ids are unique."""
    earlier, gone = [], set()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for number, line in enumerate((text or "").split("\n")):
            words = set(re.findall(r"[^\x20\x09\x0B-\x0D]+", line))
            if not words:
                continue
            if any(5 * len(words & e) >= 4 * len(words | e) for e in earlier):
                gone.add((doc_id, number, len(words)))
            earlier.append(words)
    return gone


def check(documents, rows):
    got = [(r.doc, r.line, r.n_words) for r in line_dedup.repeated_lines(documents(rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def varied(seed):
    drawn = random.Random(seed)
    pool = [[f"w{drawn.randrange(300)}" for _ in range(drawn.randrange(1, 40))] for _ in range(25)]
    rows = []
    for doc_id in range(40):
        lines = []
        for _ in range(drawn.randrange(0, 8)):
            base = drawn.choice(pool)
            lines.append(drawn.choice([" ", "  ", "\t"]).join(w if drawn.random() > drawn.choice([0, 0.05, 0.1, 0.2]) else f"v{drawn.randrange(9999)}" for w in base))
        rows.append((doc_id, "\n".join(lines)))
    return rows


def test_equals_brute_force(documents):
    check(documents, varied(1))


def test_edges(documents):
    check(documents, [
        (1, None), (2, ""), (3, "\n\n \t\n"), (4, "a\na\nb\n  a "), (5, "a b c d\na b c d e\nA b c d"), (6, "x\r\ny z\ry z"),
        (7, "long " + " ".join(f"t{i}" for i in range(9000))), (8, " ".join(f"t{i}" for i in range(9000))),
    ])
    assert line_dedup.repeated_lines(documents([])).collect() == []


def test_one_line_in_most_documents(documents):
    rows = [(i, f"own words of {i} {i * 7}\nthe line that all of them share") for i in range(700)]
    check(documents, rows)


def test_many_small_changes_of_one_line(documents):
    base = [f"b{i}" for i in range(30)]
    check(documents, [(i, " ".join([*base[: i % 30], f"x{i}", *base[i % 30 + 1 :]])) for i in range(150)])


def long_lines(n):
    """Lines of about n words that share some rare ones, and copies that change a few words or make them short."""
    drawn = random.Random(n)
    rows = []
    for i in range(40):
        words = [f"rare{j}" for j in range(n // 6)] + [f"c{drawn.randrange(9999)}" for _ in range(n - n // 6)]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            rows.append((100 + i, " ".join(words[: n - n // 12] + [f"new{i}"])))
    return rows


def test_long_lines_and_those_about_as_long_as_bits_double(documents):
    for n in (60, 66, 72, 150):
        check(documents, long_lines(n))


def test_unlike_long_lines_are_not_fetched(documents, monkeypatch):
    pairs, pin = [], line_dedup.pin

    def counted(df, name):
        found = pin(df, name)
        if name == "line_pairs":
            pairs.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "pin", counted)
    line_dedup.repeated_lines(documents([r for r in long_lines(150) if r[0] < 100])).collect()
    assert pairs == [0, 0]


def test_first_round_is_of_words_in_many_lines(documents, monkeypatch):
    base = [f"b{i}" for i in range(30)]
    near = [(i, " ".join([*base[: i % 30], f"x{i}", *base[i % 30 + 1 :]])) for i in range(60)]
    pairs, pin = [], line_dedup.pin

    def counted(df, name):
        found = pin(df, name)
        if name == "line_pairs":
            pairs.append(found.count())
        return found

    monkeypatch.setattr(line_dedup, "pin", counted)
    check(documents, near)
    assert pairs[0] == 0 and pairs[1] > 60
    del pairs[:]
    monkeypatch.setattr(line_dedup, "_MANY", 5)
    check(documents, near)
    assert 0 < pairs[0] and pairs[1] == 0


def test_both_rounds_equal_brute_force(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "_MANY", 3)
    check(documents, varied(2))
    for n in (60, 66):
        check(documents, long_lines(n))


def test_copies_in_one_document_and_under_large_and_missing_ids(documents):
    edge = (1 << 63) - 1
    check(documents, [(edge, "a b c\nc b a\nd e f g h"), (-edge - 1, "d e f g h\nx"), (0, "x\ny\nx\na b c"), (-5, "y")])
    nameless = line_dedup.repeated_lines(documents([(None, "p q\nr s\nq p"), (3, "r s\np q")])).collect()
    assert sorted((r.doc < 0, r.line, r.n_words) for r in nameless) == [(False, 0, 2), (False, 1, 2), (True, 2, 2)]


def test_documents_keep_what_is_new(documents):
    docs = documents([(1, "first line here\nsecond"), (2, "new\n\nfirst line here\nlast"), (3, "second"), (4, None), (None, "nameless"), (5, "")])
    left = line_dedup.without_repeated_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "first line here\nsecond", 2: "new\n\nlast", 4: None, None: "nameless", 5: ""}
