"""Personal data: patterns propose spans, checksums confirm them, context moves the score.

DataFrame expressions only. For each kind the text is both searched for its
pattern and split at it, so the lengths of the pieces and matches give every
match's place in code points. A match that fails its test (octets at most 255,
digit counts, the Luhn digit, the IBAN remainder modulo 97) is dropped without a
second try. The score of a confirmed span starts at its kind's prior, rises where
a word of that kind stands within 40 code points before it and after the match
before, and falls where a word stands there that speaks against it, as "version"
does before four numbers. Spans of ``LIKELY`` or more are personal data; masking
takes no others.

The patterns use possessive quantifiers and a look-behind for the start of a run.
They match what the plain patterns in ``BASE`` match, but in linear time and
without recursion on very long runs. Matches are placed in stretches of
``STRETCH``, so a text with very many costs little more than their number.

Defined cases: a null text counts as empty and has no spans; a text of any length
is searched whole; spans that start together are ordered by kind; repeated rows and
null ids keep one row each; extra columns are ignored or carried whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns that the base spans are defined by.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, found in linear time.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: A text without this cannot match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = list(LINEAR)
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|e-mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
AGAINST = {"ip": "version|release|build|firmware|ver|v", "card": "isbn|serial|tracking", "phone": "isbn|serial|tracking"}
BONUS, MALUS = 0.1, 0.3
#: Spans of this score or more count as personal data.
LIKELY = 0.5
REACH = 40
#: Matches that are placed and masked at a time.
STRETCH = 256
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,text:string,score:double>"


def digits_of(match: Column) -> Column:
    """The digits of a match."""
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """The Luhn test of a digit string."""
    return F.call_function("luhn_check", digits)


def passes_mod97(match: Column) -> Column:
    """The IBAN test: first four characters moved to the end, letters as 10..35, remainder 1."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), "")
    value = F.transform(turned, lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    remainder = F.aggregate(
        value, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97
    )
    return F.length(plain).between(15, 34) & (remainder == 1)


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match of ``kind`` passes its test."""
    digits = digits_of(match)
    if kind == "ip":
        # an octet of many digits is at most 255 if all but the last three are zero
        small = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(small(p)) <= 3) & (small(p).try_cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & passes_luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return passes_mod97(match)
    return F.lit(True)


def scored(kind: str, gap: Column) -> Column:
    """The score of a span of ``kind`` after the text ``gap``."""
    before = F.lower(F.right(gap, F.lit(REACH)))
    near = lambda words: before.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")
    score = F.lit(PRIOR[kind]) + F.when(near(CONTEXT[kind]), BONUS).otherwise(0.0)
    if kind in AGAINST:
        score = score - F.when(near(AGAINST[kind]), MALUS).otherwise(0.0)
    return F.round(score, 3)


def _spans_of(kind: str, text: Column) -> Column:
    matches = F.regexp_extract_all(text, F.lit(LINEAR[kind]), F.lit(0))
    pairs = F.zip_with(
        matches, F.split(text, LINEAR[kind], -1), lambda m, g: F.struct(m.alias("match"), g.alias("gap"))
    )  # one gap more than matches: its match is null
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        match, start = pair["match"], state["at"] + F.length(pair["gap"])
        end = start + F.length(match)
        span = F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            end.alias("end"),
            F.lit(kind).alias("kind"),
            match.alias("text"),
            scored(kind, pair["gap"]).alias("score"),
        )
        good = F.coalesce(confirmed(kind, match), F.lit(False))
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(match.isNotNull() & good, F.concat(state["out"], F.array(span)))
            .otherwise(state["out"])
            .cast(f"array<{SPAN}>")
            .alias("out"),
        )

    def stretch(state: Column, some: Column) -> Column:
        placed = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("out")), step)
        # bound to a name by the array, so that it is worked out once
        return F.transform(
            F.array(placed), lambda p: F.struct(p["at"].alias("at"), F.concat(state["out"], F.array(p["out"])).alias("out"))
        )[0]

    def all_of(pairs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(STRETCH)), lambda k: F.slice(pairs, k, F.lit(STRETCH)))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        return F.aggregate(parts, start, stretch, lambda s: F.flatten(s["out"]))

    found = F.transform(F.array(pairs), all_of)[0]
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(possible & (F.length(text) > 0), found).otherwise(none)


def pii_spans(text: Column) -> Column:
    """All confirmed spans of a text, by start and then kind: kind, start, end, text, score."""
    text = F.coalesce(text, F.lit(""))
    return F.transform(
        F.array_sort(F.concat(*[_spans_of(k, text) for k in KINDS])),
        lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "text", "score")]),
    )


def likely(spans: Column) -> Column:
    """The spans that count as personal data."""
    return F.filter(spans, lambda s: s["score"] >= LIKELY)


def find_pii(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (the ``carry`` columns) and ``spans``."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), pii_spans(F.col(f"`{text_col}`")).alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets.

    A place is found by walking there, so spans are taken in stretches, each over
    its own part of the text.
    """
    # bound to a name by the array, so that they are worked out once
    return F.transform(F.array(spans), lambda own: _masked(text, own))[0]


def _masked(text: Column, spans: Column) -> Column:
    strings = "array<string>"
    cut = lambda t, start, end: F.substr(t, (start + 1).cast("int"), (end - start).cast("int"))

    def stretch(state: Column, some: Column) -> Column:
        end = F.greatest(state["at"], F.array_max(F.transform(some, lambda s: s["end"])))

        def inner(part: Column) -> Column:
            base = state["at"]

            def step(own: Column, span: Column) -> Column:
                piece = F.concat(cut(part, own["at"] - base, span["start"] - base), F.lit("["), F.upper(span["kind"]), F.lit("]"))
                return F.struct(
                    F.greatest(own["at"], span["end"]).alias("at"),
                    F.when(span["start"] >= own["at"], F.concat(own["out"], F.array(piece))).otherwise(own["out"]).alias("out"),
                )

            done = F.aggregate(some, F.struct(base.alias("at"), F.array().cast(strings).alias("out")), step)
            return F.transform(
                F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(d["out"], ""))).alias("out"))
            )[0]

        return F.transform(F.array(cut(text, state["at"], end)), inner)[0]

    parts = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(STRETCH)), lambda k: F.slice(spans, k, F.lit(STRETCH)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(strings).alias("out"))
    done = F.aggregate(
        parts, start, stretch, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, (s["at"] + 1).cast("int")))
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
