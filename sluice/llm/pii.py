"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust scores.

Everything is a built-in SQL function over one row, so the operator is one narrow pass without shuffle.
Positions come from splitting a text by the pattern that its matches were taken with: a match starts
after all pieces and matches before it.

Patterns are written so that the Java matcher neither recurses nor rescans a long run: quantifiers are
possessive where nothing could be given back, and a look-behind lets a match begin at the start of a run
only (``\\G`` keeps the place right behind the match before, as leftmost matching does).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import bound

#: Characters on either side of a span in which context words count, and the score that a span needs.
CONTEXT_CHARS, NEEDED = 48, 0.6


Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Kind:
    """What is looked for.  A proposed string must pass ``valid`` to count at all.

    Base kinds have no ``score``: what passes counts.  For the others ``score`` grows by ``CHECKED`` if
    the checksum ``checked`` holds and by ``NEAR`` if one of ``words`` stands near, and must reach
    ``NEEDED``.  ``needs`` is a substring without which no match can exist.  With ``whole`` the pattern
    matches only how a string begins; ``whole`` gives, from the text at that place, the string to be checked
    (null for none), so that a start that comes to nothing hides no later one.
    """

    name: str
    pattern: str
    valid: Check | None = None
    checked: Check | None = None
    needs: str | None = None
    score: float | None = None
    words: tuple[str, ...] = ()
    whole: Check | None = None


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """The Luhn sum of the digits ends in 0: from the right every second digit counts double, less 9 above 9."""

    def holds(d: Column) -> Column:
        def worth(i: Column) -> Column:
            digit = F.ascii(F.substr(d, i, F.lit(1))) - 48
            double = digit * 2
            return F.when((F.length(d) - i) % 2 == 0, digit).when(double > 9, double - 9).otherwise(double)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0

    return bound(digits(s), holds)


def mod97(s: Column) -> Column:
    """An account number with its first four characters moved to the end leaves 1 by 97; letters are 10 to 35."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substr(moved, i, F.lit(1)))
    step = lambda rest, i: F.when(code(i) >= 65, rest * 100 + code(i) - 55).otherwise(rest * 10 + code(i) - 48) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


#: Characters of an account number by country, as in the IBAN registry (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def account_number(rest: Column) -> Column:
    """The account number that a text begins with: as long as its country's are, or for a prefix in no registry the longest run."""
    size = F.create_map(*(F.lit(x) for n, countries in IBAN_LENGTHS.items() for c in countries.split() for x in (c, n)))[F.substr(rest, F.lit(1), F.lit(2))]
    counted = F.concat(F.lit("^(?:[A-Z0-9] ?){"), (size - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Za-z0-9])"))
    return F.regexp_substr(rest, F.coalesce(counted, F.lit("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")))


BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", valid=lambda s: s.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
    # A run of digits with single separators is one match; only runs of 16 to 19 digits are proposed.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", valid=luhn),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", valid=lambda s: F.length(digits(s)).between(8, 15), needs="+"),
)
ADDED = (
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})", whole=account_number,
        checked=mod97, score=0.2, words=("iban", "account", "konto", "compte", "cuenta", "bank"),
    ),
    Kind(
        "shortcard", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])",
        valid=luhn, checked=luhn, score=0.0, words=("card", "visa", "amex", "credit", "karte", "carte", "tarjeta"),
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        valid=lambda s: ~s.rlike("^(?:000|666|9)|-00-|-0000$"), score=0.3, words=("ssn", "social security", "taxpayer"),
    ),
)
#: Characters of the longest account number with a space after each, and the one behind it.
WHOLE_CHARS = 68
#: What a passed checksum and a context word add to a score.
CHECKED, NEAR = 0.4, 0.3


def proposed(text: Column, kind: Kind) -> Column:
    """The strings that the pattern matches, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(text.contains(kind.needs), found).otherwise(F.array().cast("array<string>")) if kind.needs else found


def placed(text: Column, kind: Kind, found: Column) -> Column:
    """The strings of ``found`` that count, as ``array<struct<kind, start, end, score>>`` by start."""
    gaps = F.transform(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found)), F.length)
    steps = F.zip_with(gaps, found, lambda gap, s: F.struct(gap.alias("gap"), F.length(s).alias("size")))
    starts = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(a["starts"], a["at"] + x["gap"]).alias("starts")),
        lambda a: a["starts"],
    )

    def score(s: Column, start: Column) -> Column:
        if kind.score is None:
            return F.lit(1.0)
        left = F.substr(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
        right = F.substr(text, start + F.length(s) + 1, F.lit(CONTEXT_CHARS))
        around = F.lower(F.concat_ws(" ", left, right))
        near = reduce(or_, [around.contains(w) for w in kind.words])
        return F.lit(kind.score) + F.when(kind.checked(s) if kind.checked else F.lit(False), CHECKED).otherwise(0.0) + F.when(near, NEAR).otherwise(0.0)

    strings = F.transform(starts, lambda b: kind.whole(F.substr(text, b + 1, F.lit(WHOLE_CHARS)))) if kind.whole else found
    spans = F.zip_with(
        strings,
        starts,
        lambda s, b: F.struct(
            F.lit(kind.name).alias("kind"),
            b.alias("start"),
            (b + F.length(s)).alias("end"),
            F.when(kind.valid(s), score(s, b)).otherwise(0.0).alias("score") if kind.valid else score(s, b).alias("score"),
        ),
    )
    kept = F.filter(spans, lambda x: x["score"] >= NEEDED)
    if kind.whole:
        kept = bound(kept, apart)
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def apart(spans: Column) -> Column:
    """Spans by start less those that begin before the one kept last has ended."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.aggregate(spans, none, lambda kept, x: F.when((F.size(kept) == 0) | (F.get(kept, F.size(kept) - 1)["end"] <= x["start"]), F.array_append(kept, x)).otherwise(kept))


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and one column of spans for each kind, ``array<struct<kind, start, end, score>>``.

    Null and empty texts have no spans; null keys and repeated rows are returned row by row; other
    columns, whatever their names, are not read.  An empty table gives an empty result.
    """
    out = df.select(df[key].alias("k"), F.coalesce(df[text].cast("string"), F.lit("")).alias("t"))
    for kind in BASE + ADDED:
        out = out.withColumn(f"_{kind.name}", proposed(F.col("t"), kind))
    return out.select(F.col("k").alias(key), *(placed(F.col("t"), k, F.col(f"_{k.name}")).alias(k.name) for k in BASE + ADDED))


def written(spans: list[str]) -> Column:
    """The named span columns as ``kind:start:end``, comma-joined in the order given."""
    every = F.concat(*map(F.col, spans))
    return F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
