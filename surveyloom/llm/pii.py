"""Personal data: expressions propose spans, checksums confirm them, context adjusts the score.

All of it is built-in column functions. For each kind the proposed strings and the text between
them come from two passes of the same expression, and the places are running sums of their
lengths, added up in chunks, so that many matches take linear time. So does a text of one endless
word: expressions start only where a run of their characters starts (or where the last match ended).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surveyloom.llm.arrays import blocks, cut, let, running_max, running_sum

_LOCAL = "A-Za-z0-9._%+-"
# Codes of the countries that have IBANs, by the length of theirs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(" ".join(IBAN_LENGTHS.values()).split())
_IBANS = "|".join(
    [f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    # codes without a known length
    + [f"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}"]
)
# What proposes a span of each kind, in the order in which kinds are listed.
PROPOSE = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
    # what is proposed is only looked at, so that one that fails hides none that starts inside it
    "iban": f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBANS})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters that a match takes where that is not all of what it proposes as its first group.
TAKEN = {"iban": 4}
#: Kinds that stay whatever their score is.
BASE = ("email", "ip", "card", "phone")
# The score of a confirmed span, and words nearby that raise it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "\\bip\\b|address|server|host|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
RAISE, ENOUGH, NEARBY = 0.3, 0.5, 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    ordered = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(ordered, i, F.lit(1)).cast("int")).otherwise(
            # doubled digits, with 9 taken off where there are two
            F.translate(F.substring(ordered, i, F.lit(1)), "123456789", "246813579").cast("int")
        ),
    )
    return (F.char_length(digits) > 0) & (total % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.ascii(c) - 55  # noqa: E731  A is 10
    left = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97)
        .otherwise((acc * 100 + value(c)) % 97),
    )
    return left == 1


def confirmed(kind: str, found: Column) -> Column:
    """Whether a proposed string passes what its kind asks for."""
    n = F.char_length(_digits(found))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return found.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        bare = F.replace(found, F.lit(" "))
        return F.when(F.char_length(bare).between(15, 34), mod97(bare)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)") & ~found.rlike("-00-|-0000$")
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    """The kind's score, raised by a context word among the characters around a span."""
    near = F.lower(F.concat(F.right(before, F.lit(NEARBY)), F.lit(" "), F.left(after, F.lit(NEARBY))))
    return F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), RAISE).otherwise(0.0))


def _possible(kind: str, text: Column) -> Column:
    """A cheap test that every text with a span of the kind passes."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def _proposed(docs: DataFrame, kind: str, text: Column, name: str) -> DataFrame:
    """Adds the proposed strings and the pieces of text around them, both as arrays."""
    pattern = PROPOSE[kind]
    none = F.array().cast("array<string>")
    out = docs.withColumn(
        f"{name}_found",
        F.when(_possible(kind, text), F.regexp_extract_all(text, F.lit(pattern), F.lit(int(kind in TAKEN)))).otherwise(none),
    )
    return out.withColumn(
        f"{name}_around", F.when(F.size(f"{name}_found") > 0, F.split(text, pattern, -1)).otherwise(none)
    )


def _kept(kind: str, found: Column, before: Column, after: Column) -> Column:
    passed = confirmed(kind, found)
    return passed if kind in BASE else passed & (score(kind, before, after) >= ENOUGH)


def _spans(kind: str, rank: int, found: Column, around: Column) -> Column:
    """The kept spans of one kind, from the proposed strings and the pieces of text around them."""
    n = F.size(found)
    before, after = F.slice(around, F.lit(1), n), F.slice(around, F.lit(2), n)
    skipped = F.transform(before, lambda y: F.char_length(y))
    taken = F.transform(found, lambda x: F.lit(TAKEN[kind]) if kind in TAKEN else F.char_length(x))
    moved = F.zip_with(skipped, taken, lambda a, b: a + b)
    starts = F.zip_with(running_sum(moved), skipped, lambda a, b: a + b)
    placed = F.zip_with(found, starts, lambda x, at: F.struct(x.alias("text"), at.alias("start")))
    near = F.zip_with(before, after, lambda x, y: F.struct(x.alias("before"), y.alias("after")))

    def span(x: Column, y: Column) -> Column:
        following = y["after"]
        if kind in TAKEN:
            following = F.substring(following, F.char_length(x["text"]) - TAKEN[kind] + 1, F.lit(NEARBY))
        return F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (x["start"] + F.char_length(x["text"])).alias("end"),
            F.lit(kind).alias("kind"),
            score(kind, y["before"], following).alias("score"),
            _kept(kind, x["text"], y["before"], following).alias("kept"),
        )

    return F.filter(F.zip_with(placed, near, span), lambda s: s["kept"])


def find_pii(docs: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """Add the array of spans found in each whole text: kind, start, end (exclusive), score.

    Places are code points from 0; spans are sorted by start, then by kind as listed. Proposals
    of a kind are leftmost and do not overlap; one that fails its check is dropped and nothing
    is tried in its place. An IBAN is proposed wherever one can start, and is as long as its
    country's are, whatever words follow. Kinds beyond the base ones need a score of at least ``ENOUGH``. A null
    or empty text has an empty array. Rows are kept one by one with their other columns, and no
    row moves between tasks.
    """
    if output in docs.columns:
        raise ValueError(f"Column {output} exists")
    out = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    spans = []
    for rank, kind in enumerate(PROPOSE):
        name = f"__{kind}"
        out = _proposed(out, kind, F.col("__text"), name)
        spans.append(_spans(kind, rank, F.col(f"{name}_found"), F.col(f"{name}_around")))
    every = F.array_sort(F.concat(*spans))
    return out.select(
        *docs.columns,
        F.transform(
            every,
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")),
        ).alias(output),
    )


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace confirmed spans by their kind in brackets.

    Of spans that overlap the one that starts first is named, and all their characters go.
    Null stays null; rows and other columns stay as they are, and no row moves between tasks.
    """
    found = find_pii(docs, text, "__pii")
    content = F.coalesce(F.col(text), F.lit(""))
    # with each span the place up to which the spans before it reach
    reached = running_max(F.transform("__pii", lambda s: s["end"]))
    placed = F.zip_with("__pii", reached, lambda s, at: F.struct(s.alias("span"), at.alias("at")))

    def named(pieces: Column) -> Column:
        said = F.transform(
            F.filter(placed, lambda p: p["span"]["start"] >= p["at"]),
            lambda p: F.concat(cut(pieces, p["at"], p["span"]["start"]), F.lit("["), F.upper(p["span"]["kind"]), F.lit("]")),
        )
        last = F.array_max(F.transform("__pii", lambda s: s["end"]))
        return F.concat(F.array_join(said, ""), F.substring(content, last + 1, F.char_length(content)))

    said = let(blocks(content), named)
    changed = found.withColumn(text, F.when(F.size("__pii") > 0, said).otherwise(F.col(text)))
    return changed.select(*docs.columns)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
