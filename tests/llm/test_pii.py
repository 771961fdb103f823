import hashlib
import random
import re

from seasonwin.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }
            if good[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def found(documents, texts):
    rows = pii.digest(pii.find_pii(documents(list(enumerate(texts))))).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    return {r.doc_id: r for r in rows}


def check(documents, texts):
    for i, r in found(documents, texts).items():
        spans = brute(texts[i])
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE) == want
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]


def test_base_spans_equal_plain_search(documents):
    drawn = random.Random(1)
    texts = ["".join(drawn.choice("ab1.2@+- ()%9é𝄞4") for _ in range(60)) for _ in range(400)]
    check(documents, texts)


def test_edges_and_very_long_texts(documents):
    check(documents, [
        None, "", "a@b.com_x@y.z é q@w..e", "ü 4111 1111 1111 1111, 1.2.3.4.5.6.7.8 300.1.1.1 007.1.1.1 +1 (555) 555-1234 + +12",
        "1" * 60_000, "a" * 60_000 + "@", "1 " * 30_000, "+" * 5000 + "1", "a@b.c@d.e f%g@h-i.j.k.", "text " * 20_000 + "x@y.zz",
    ])


def test_checksums_and_context_of_further_kinds(documents):
    got = found(documents, [
        "IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE89370400440532013001", "my ssn is 123-45-6789", "number 123-45-6789", "ssn 000-45-6789",
    ])
    assert [got[i].spans for i in range(5)] == ["iban:5:32", "", "ssn:10:21", "", ""]


def test_account_numbers_before_capitals_and_digits(documents):
    texts = [
        "iban DE89370400440532013000 Please pay", "iban DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "GB82 WEST 1234 5698 7654 32 2024 x",
        "DE89370400440532013000 I sent", "é REF AB12 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 NO93 8601 1117 947 1 A",
        "DE89 3704 0044 0532 0130 00x", "DE89 3704 0044 0532 0130", "AB12 " * 20_000 + "DE89370400440532013000 X", "A1 " * 20_000,
        "ZZ68 3704 0044 0532 0130 00 AND", "NL91ABNA0417164300, BE68539007547034.",
    ]
    # ZZ is no country of the table: its check digits are worked out here.
    body = "370400440532013000"
    number = int("".join(str(int(c, 36)) for c in body + "ZZ00")) % 97
    texts[9] = f"ZZ{98 - number:02d} 3704 0044 0532 0130 00 AND"
    got = found(documents, texts)
    ibans = [",".join(s for s in got[i].spans.split(",") if s.startswith("iban")) for i in range(len(texts))]
    assert ibans == [
        "iban:5:27", "iban:5:32", "iban:0:27", "iban:0:22", "iban:11:38,iban:39:66,iban:67:85", "", "", "iban:100000:100022", "",
        "iban:0:27", "iban:0:18,iban:20:36",
    ]
    rows = pii.redacted(documents([(1, texts[1]), (2, texts[3])]))
    assert {r.doc_id: r.text for r in rows.collect()} == {1: "iban <iban> BIC COBADEFFXXX", 2: "<iban> I sent"}


def test_redacted_text_and_other_columns(documents):
    rows = pii.redacted(documents([(1, "a@b.cc, 1.2.3.4"), (2, "nothing"), (3, None)]))
    assert {r.doc_id: r.text for r in rows.collect()} == {1: "<email>, <ip>", 2: "nothing", 3: None}
    assert "component_id" in rows.columns and "_hash" in rows.columns
    assert pii.find_pii(documents([])).collect() == []
