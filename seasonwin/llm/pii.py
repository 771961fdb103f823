"""Personal data: patterns propose, checksums confirm, context words weigh (operator 4), in DataFrame functions only.

The patterns are written so that a search is linear in the length of a text:
runs are taken whole (possessively) and begin only where a run begins.
Positions come from the lengths of the stretches between matches, so they count
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonwin.llm.common import fresh

# What the kinds look like.
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
PATTERNS = {
    # An address begins where its run of signs begins, or behind the address before it.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Takes the first four signs only, so that every group that may begin an account is looked at; the groups are seen ahead.
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}[A-Z0-9]{0,30}+(?![A-Za-z0-9])(?:\x20[A-Z0-9]{1,30}+(?![A-Za-z0-9])){0,30}+))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
# The lengths of account numbers by country. Those of other codes have 15 to 34 signs.
_ACCOUNTS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_ACCOUNT = "^(?:{}|(?!{}).{{15,34}})$".format(
    "|".join(f"(?:{codes.replace(' ', '|')}).{{{n - 2}}}" for n, codes in _ACCOUNTS.items()),
    "|".join(codes.replace(" ", "|") for codes in _ACCOUNTS.values()),
)
# Words near a match that make it likelier.
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write to)\b",
    "ip": r"\b(?:ip|address|host|server)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"\b(?:phone|tel|telephone|call|mobile|fax)\b",
    "iban": r"\b(?:iban|account|bank|transfer|konto|compte|cuenta)\b",
    "ssn": r"\b(?:ssn|social security)\b",
}
#: Score of a match whose check holds, before context; context adds 0.3. A base kind whose check fails is dropped.
SCORES = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "ssn": 0.3}
_NEAR = 0.3
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# A text without one of these has no match of the kind; the search is then left out.
_NEEDS = {"email": "@", "phone": "+"}


def _remainder_97(account: Column) -> Column:
    """Remainder of an account number: first four signs last, letters as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    signs = F.filter(F.split(moved, ""), lambda s: s != "")
    value = lambda s: F.conv(s, 36, 10).cast("int")
    return F.aggregate(signs, F.lit(0), lambda r, s: (r * F.when(value(s) > 9, 100).otherwise(10) + value(s)) % 97)


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        account = F.regexp_replace(match, " ", "")
        return account.rlike(_ACCOUNT) & (_remainder_97(account) == 1)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-") & ~match.rlike("-0000$")
    return F.lit(True)


def _accounts(placed: Column) -> Column:
    """Of each run of groups the longest valid account number that ends with a group; runs without one go."""
    groups = lambda s: F.split(s["text"], " ", -1)
    ends = lambda s: F.transform(F.sequence(F.lit(1), F.size(groups(s))), lambda n: F.array_join(F.slice(groups(s), 1, n), " "))
    last = lambda s: F.slice(F.filter(ends(s), lambda a: _valid("iban", a)), -1, 1)
    return F.flatten(F.transform(placed, lambda s: F.transform(
        last(s), lambda a: F.struct(s["start"].alias("start"), (s["start"] + F.length(a)).alias("end"), a.alias("text"))
    )))


def _spans(text: Column, found: Column, gaps: Column, kind: str, reach: int) -> Column:
    """Valid matches as structs of kind, start, end, text and score, in the order of the text."""
    span = "struct<start:int,end:int,text:string>"
    # What the pattern takes of a match.
    taken = (lambda m: F.when(m.isNotNull(), 4)) if kind == "iban" else F.length
    placed = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("match")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(taken(x["match"]), F.lit(0))).alias("at"),
            F.when(x["match"].isNull(), acc["spans"]).otherwise(
                F.array_append(acc["spans"], F.struct(
                    (acc["at"] + x["gap"]).alias("start"),
                    (acc["at"] + x["gap"] + F.length(x["match"])).alias("end"), x["match"].alias("text"),
                ))
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    if kind == "iban":
        placed = _accounts(placed)
    first = lambda s: F.greatest(s["start"] - reach, F.lit(0))
    around = lambda s: F.lower(F.substring(text, first(s) + 1, s["end"] + reach - first(s)))
    scored = lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
        (F.lit(SCORES[kind]) + F.when(around(s).rlike(CONTEXT[kind]), _NEAR).otherwise(0.0)).alias("score"),
    )
    return F.transform(F.filter(placed, lambda s: _valid(kind, s["text"])), scored)


def find_pii(docs: DataFrame, text: str = "text", least: float = 0.5, reach: int = 40, spans: str = "spans") -> DataFrame:
    """Adds ``spans``, an array of (kind, start, end, text, score), to every document.

    Kinds come in the order of ``PATTERNS``, a kind's spans in that of the text;
    starts count code points from 0. ``least`` is the lowest score of the kinds
    beyond the base. Null and empty texts have no spans; rows and other columns stay as they are.
    """
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = fresh(docs, *(f"_{k}_{x}" for k in PATTERNS for x in ("found", "gaps")))
    columns = dict(zip(((k, x) for k in PATTERNS for x in ("found", "gaps")), names, strict=True))
    digit = F.regexp_instr(own, F.lit("[0-9]")) > 0
    searched = {}
    for kind, pattern in PATTERNS.items():
        may = digit if kind not in _NEEDS else F.contains(own, F.lit(_NEEDS[kind]))
        searched[columns[kind, "found"]] = F.when(may, F.regexp_extract_all(own, F.lit(pattern), F.lit(int(kind == "iban"))))
    rows = docs.withColumns(searched)
    cut = {}
    for kind, pattern in PATTERNS.items():
        some = F.size(columns[kind, "found"]) > 0
        cut[columns[kind, "gaps"]] = F.when(some, F.transform(F.split(own, pattern, -1), F.length))
    rows = rows.withColumns(cut)
    each = []
    for kind in PATTERNS:
        found = _spans(own, F.col(columns[kind, "found"]), F.col(columns[kind, "gaps"]), kind, reach)
        if kind not in BASE:
            found = F.filter(found, lambda s: s["score"] >= least)
        each.append(F.coalesce(found, F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c != spans), F.concat(*each).alias(spans))


def digest(found: DataFrame, doc_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans as text, and all spans as text."""
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    of = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        F.col(doc_id).alias("doc_id"), *counts,
        F.sha2(F.array_join(F.transform(base, written), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, written), ",").alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; of spans that overlap, the first counts."""
    spans, = fresh(docs, "_spans")
    found = find_pii(docs, text, spans=spans, **options)
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    new = F.aggregate(
        in_order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(own, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"),
        )),
        lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))),
    )
    changed = F.when(F.size(spans) > 0, new).otherwise(F.col(f"`{text}`"))
    return found.select(*((changed.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns))
