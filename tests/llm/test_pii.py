"""Personal data against a plain scan with Python's expressions."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from surveyloom.llm import arrays, pii as pi
from surveyloom.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if passes(kind, m.group())]
    return [(k, s, e) for s, _, k, e in sorted(out)]


HARD = [
    None, "", "a@b.c", "a@b.c_d@e.f%g@h.i", "a@b", "x@@y.z", "a@b@c.d", "@b.c", "é👩‍👩 mail: jo.e+x@mail-1.example.com.", "..@a.b..",
    "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.256 001.002.003.255 0000.0.0.0", "1.2.3", "v1.22.333.4444",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "4111111111111112", "x4111111111111111y" * 3,
    "+1 (212) 555-0100", "+1", "+1-", "+12", "+1 ((((", "++1 212 555 0100 200 300 400", "+49 30 1234567, +49 30 123", "+1 212+1 212 555 0100",
    "1" * 3000, "a" * 2000, "a." * 1000 + "@", "1." * 2000, "+1" + " " * 3000, "1-" * 2000, "Call +1 212 555 0100 a@b.co 10.0.0.1 " * 400,
    "IBAN DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013000", "DE88370400440532013000", "ssn 123-45-6789", "123-45-6789", "000-12-3456 ssn",
]


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_base_spans_equal_a_plain_scan(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, kind string").repartition(4)
    for r in pi.find_pii(df).collect():
        got = [(s.kind, s.start, s.end) for s in r.pii if s.kind in pi.BASE]
        assert got == base(HARD[r.doc_id]), (r.doc_id, (HARD[r.doc_id] or "")[:60])
        assert all(0 < s.score <= 1 for s in r.pii)
    assert pi.find_pii(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pi.find_pii(df.withColumnRenamed("kind", "pii"))


def test_endless_words_take_linear_time(spark):
    """A plain scan takes the square of their length, so only what it must find is compared."""
    texts = ["1" * 50_000, "a" * 200_000, "a." * 50_000 + "@", "1." * 40_000, "+1" + " " * 50_000, "1-" * 50_000]
    found = pi.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    spans = {r.doc_id: r.pii for r in found}
    assert [len(spans[i]) for i in (0, 1, 2, 4, 5)] == [0] * 5
    assert len(spans[3]) == 10_000 and all(s.kind == "ip" for s in spans[3])


def test_added_kinds_need_checks_or_context(spark):
    rows = [(i, t) for i, t in enumerate(HARD[-6:])]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii if s.kind not in pi.BASE] for r in
           pi.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [("iban", 5, 32)], 1: [("iban", 0, 22)], 2: [], 3: [("ssn", 4, 15)], 4: [], 5: []}


def test_context_raises_the_score(spark):
    rows = [(0, "call me: +1 212 555 0100"), (1, "xyz +1 212 555 0100")]
    got = {r.doc_id: r.pii[0].score for r in pi.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] > got[1]


def test_redaction_leaves_nothing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pi.redact_pii(df).collect()}
    assert clean[0] is None and clean[1] == "" and clean[2] == "[EMAIL]" and clean[4] == "a@b" and clean[17] == "4111111111111112"
    again = spark.createDataFrame(sorted(clean.items()), "doc_id long, text string")
    assert [r.doc_id for r in pi.find_pii(again).collect() if any(s.kind in pi.BASE for s in r.pii)] == []
    # what is not personal data stays in its order
    for i, text in clean.items():
        gone = {j for _, s, e in base(HARD[i]) for j in range(s, e)}
        rest = "".join(c for j, c in enumerate(HARD[i] or "") if j not in gone)
        if not re.search(r"\[(IBAN|SSN)\]", text or ""):
            assert re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", text or "") == rest


def test_query_equals_a_plain_scan(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op10_pii"](spark, FOLDER).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        spans = base(texts[r.doc_id])
        n = {k: sum(x[0] == k for x in spans) for k in pi.BASE}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n.values())
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        found += len(spans)
    assert found > 30


IBAN = "DE89370400440532013000"


@pytest.mark.parametrize(
    "text, start, end",
    [
        (f"IBAN {IBAN} BIC COBADEFF", 5, 27), ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", 0, 27), (f"{IBAN} 2024-01-01", 0, 22),
        ("GB82WEST12345698765432 I said", 0, 22), ("é AT12 DE89 3704 0044 0532 0130 00", 7, 34), ("NO93 8601 1117 947 BE 1", 0, 18),
        (f"{IBAN} {IBAN}", 0, 22), (f"{IBAN}1 x", None, None), (f"x{IBAN}", None, None),
    ],
)
def test_words_after_an_iban_do_not_join_it(spark, text, start, end):
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = [(s.start, s.end) for s in pi.find_pii(df).first().pii if s.kind == "iban"]
    want = [] if start is None else [(start, end)]
    if text == f"{IBAN} {IBAN}":
        want.append((23, 45))
    assert got == want
    redacted = pi.redact_pii(df).first().text
    assert redacted.count("[IBAN]") == len(want) and all(text[s:e] not in redacted for s, e in want)


def test_many_matches_take_linear_time(spark):
    """A million addresses in one text, with places and redaction; pieces cross blocks of characters."""
    n = 1_000_000
    df = spark.createDataFrame([(0, "é1.2.3.4 " * n), (1, "a@b.co, " * 3000)], "doc_id long, text string")
    spans = F.col("pii")
    got = {r.doc_id: r for r in pi.find_pii(df).select(
        "doc_id", F.size(spans).alias("n"), F.aggregate(F.transform(spans, lambda s: s["start"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"),
        F.element_at(spans, -1).alias("last")).collect()}
    assert (got[0].n, got[0].sum, got[0].last.start, got[0].last.end) == (n, sum(range(1, 9 * n, 9)), 9 * n - 8, 9 * n - 1)
    assert (got[1].n, got[1].last.start) == (3000, 8 * 2999)
    clean = {r.doc_id: r.text for r in pi.redact_pii(df).collect()}
    assert clean[0] == "é[IP] " * n and clean[1] == "[EMAIL], " * 3000


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 513, 65_536, 70_000])
def test_running_sums_and_cuts(spark, n):
    values = [(i * 7919) % 11 for i in range(n)]
    text = "".join(chr(97 + v) if v else "é" for v in values)
    df = spark.createDataFrame([(values, text)], "v array<int>, text string")
    got = df.select(
        arrays.running_sum(F.col("v")).alias("s"), arrays.running_max(F.col("v")).alias("m"),
        arrays.let(arrays.blocks(F.col("text")), lambda b: F.transform(F.array(*map(F.lit, (0, 5, 1020, 1024, 2047))),
                   lambda a: F.concat(arrays.cut(b, a, a + 9), F.lit("|"), arrays.cut(b, a, a + 2500), arrays.cut(b, a, a)))).alias("c"),
    ).first()
    assert got.s == [0, *itertools.accumulate(values)][:n]
    assert got.m == [0, *itertools.accumulate(values, max)][:n]
    assert got.c == [f"{text[a : a + 9]}|{text[a : a + 2500]}" for a in (0, 5, 1020, 1024, 2047)]
