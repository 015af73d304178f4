"""Fields read from posting texts: hours, rates, contract forms, provinces, dates, skills, contacts - as Columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(\d+(?:[.,]\d+)?)"
HOURS_UNIT = r"\s*(?:u(?:ur)?|hours?|hrs?)\b"


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _group(text: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, i), F.lit("")))


# Hours a week


def hours_range(text: Column) -> Column:
    """``struct<min, max>`` of a written number of hours: ``36``, ``32-40``, ``>= 32``, ``<= 40``; anything else is unknown."""
    return _once(F.trim(text), _hours_range)


def _hours_range(t: Column) -> Column:
    one, band = rf"^{NUMBER}$", rf"^{NUMBER}\s*[-–—]\s*{NUMBER}$"
    low, high = rf"^[≥>=]\s*{NUMBER}$", rf"^[≤<=]\s*{NUMBER}$"
    a, b = _number(_group(t, band, 1)), _number(_group(t, band, 2))
    least = F.when(t.rlike(one), _number(t)).when(t.rlike(band), F.when(a <= b, a)).when(t.rlike(low), _number(_group(t, low)))
    most = F.when(t.rlike(one), _number(t)).when(t.rlike(band), F.when(a <= b, b)).when(t.rlike(low), None).when(t.rlike(high), _number(_group(t, high)))
    return F.struct(least.alias("min"), most.alias("max"))


def hours_text(text: Column) -> Column:
    """``36`` or ``32–40`` from free text; a band joined by a word is tried before one joined by a dash, a bare number last."""
    return _once(text, _hours_text)


def _hours_text(text: Column) -> Column:
    word = rf"(?i){NUMBER}\s*(?:en|tot|t/m)\s*{NUMBER}{HOURS_UNIT}"
    dash = rf"(?i){NUMBER}\s*(?:[-–]\s*{NUMBER})?{HOURS_UNIT}"
    bare = rf"^{NUMBER}(?:\s*[-–]\s*{NUMBER})?$"
    t = F.trim(text)
    pick = lambda i: F.when(text.rlike(word), _group(text, word, i)).when(text.rlike(dash), _group(text, dash, i)).otherwise(_group(t, bare, i))
    a, b = pick(1), F.coalesce(pick(2), pick(1))
    return F.when(_number(a) == _number(b), a).when(_number(a) < _number(b), F.concat(a, F.lit("–"), b))


# Rates

#: A run of digits with dots and commas inside, and what stands right before an amount of money.
AMOUNT = r"[0-9]+(?:[.,][0-9]+)*"
MARK = r"(?:€|\b(?:eur|euro)\b)\s*$"
#: Periods and people behind a range that is no rate (fixed values).
COUNTED = r"^(?:[-–]$|\s*(?:jaar|maanden?|weken?|personen?|fte|mensen|medewerkers|collega(?:'s|s)?|kandidaten|procesbeschrijvers|stuks|items)\b)"
#: What joins the two amounts of a range, and the two that join only behind "tussen" or between marked amounts (fixed values).
JOINED, BOTH = r"^(?:,-)?(?:\s*[-–]|\s+(?:en|and|tot|to|t/m|tm)\s)\s*(?:€|eur)?\s*$", r"\s(?:en|and)\s"
#: Words that say what an amount is paid for, in the order they are looked for (fixed values).
UNITS = (
    ("dag", (" per dag", "/dag", "dagtarief", " per day", "/day")),
    ("maand", (" per maand", "/maand", "maandtarief", " per month", "/month")),
    ("uur", (" per uur", " p/u", "/uur", "uurtarief", " per hour", "/hour", "all-in", "all in", "ex btw", "excl. btw", "inclusief msp")),
    ("maand", ("salaris", "bruto per maand", "maandsalaris")),
    (None, (" jaarsalaris", " per jaar", "/jaar", " per year", "/year", " per annum")),
    ("uur", ("€", "euro")),
)


def rate_unit(text: Column) -> Column:
    low, out = F.lower(text), None
    for unit, marks in UNITS:
        test = reduce(or_, [low.contains(m) for m in marks])
        out = F.when(test, unit) if out is None else out.when(test, unit)
    return out


def amount(text: Column) -> Column:
    """A Dutch amount: dots group thousands, a comma is decimal; ``1,234`` could be either and is unknown."""
    whole, cents = F.split_part(text, F.lit(","), F.lit(1)), F.split_part(text, F.lit(","), F.lit(2))
    grouped = whole.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$")
    plain = F.when(grouped, F.replace(whole, F.lit("."), F.lit(""))).when(whole.rlike(r"^[0-9]+(?:\.[0-9]+)?$") & ((cents == "") | ~whole.contains(".")), whole)
    ambiguous = ~whole.contains(".") & (F.length(whole) <= 3) & (F.length(cents) == 3)
    return F.when(~ambiguous & ~cents.contains(".") & (F.size(F.split(text, ",", -1)) <= 2), F.concat(plain, F.lit("."), F.concat(cents, F.lit("0"))).try_cast("double"))


def amounts(text: Column) -> Column:
    """``array<struct<value, before, after>>``: every amount of a lower-cased text with what is written on either side of it."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)).alias("found"), F.split(text, AMOUNT, -1).alias("gaps"))
    described = lambda p: F.transform(p["found"], lambda s, i: F.struct(amount(s).alias("value"), F.get(p["gaps"], i).alias("before"), F.get(p["gaps"], i + 1).alias("after")))
    return _once(parts, described)


def rate(text: Column) -> Column:
    """``struct<min, max, unit>`` of the first rate in a text, chosen from its amounts by rank.

    Rank 1: two amounts that a dash or a word joins, the first of them marked as money or behind ``tussen``, the lower one
    first; ``en`` joins only behind ``tussen`` or when both are marked.  Rank 2: a marked amount behind a word for a
    maximum.  Rank 3, in a text that speaks of money: two amounts with a dash between, unless a third follows (a date) or a
    word for people or periods.  Rank 4: one marked amount, as maximum.  Within a rank the first in the text.
    """
    return _once(text, _rate)


def _rate(text: Column) -> Column:
    shape = F.struct
    none = F.lit(None).cast("double")
    ends = lambda low, high: shape(low.alias("min"), high.alias("max"))
    marked = lambda gap_: gap_.rlike(MARK)

    def joined(p: Column) -> Column:
        conjunction = p["gap"].rlike(BOTH)
        spanned = p["before"].rlike(r"\btussen(?:\s+de)?\s*(?:€|eur)?\s*$")
        return p["gap"].rlike(JOINED) & (marked(p["before"]) | spanned) & (~conjunction | spanned | (marked(p["before"]) & marked(p["gap"]))) & F.coalesce(p["low"] <= p["high"], F.lit(True))

    def dashed(p: Column) -> Column:
        counted = p["after"].rlike(COUNTED)
        return p["gap"].rlike(r"^\s*[-–]\s*$") & ~counted & ~p["before"].rlike(r"^[-–]$")

    most = lambda a: a["before"].rlike(r"(?:\bmax\.?|\bmax\s+tarief|\btot|\bt/?m)\s*(?:van\s+)?(?:€|euro)\s*$")
    first = lambda xs, test: F.get(F.filter(xs, test), F.lit(0))

    def chosen(x: Column) -> Column:
        one, money = x["one"], x["money"]
        rest = F.greatest(F.size(one) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(one, F.lit(1), rest), F.slice(one, F.lit(2), rest), lambda a, b: shape(a["value"].alias("low"), b["value"].alias("high"), a["before"].alias("before"), a["after"].alias("gap"), b["after"].alias("after")))

        def ranked(ps: Column) -> Column:
            two, top, bare, last = first(ps, joined), first(one, most), first(ps, dashed), first(one, lambda a: marked(a["before"]))
            return (
                F.when(two.isNotNull(), ends(two["low"], two["high"]))
                .when(top.isNotNull(), ends(none, top["value"]))
                .when(money & bare.isNotNull(), ends(bare["low"], bare["high"]))
                .when(money & last.isNotNull(), ends(none, last["value"]))
            )

        return _once(pairs, ranked)

    low = F.lower(text)
    seen = shape(amounts(low).alias("one"), low.rlike(r"€|\b(?:tarief|uurtarief|dagtarief|euro|eur)\b").alias("money"))
    found = _once(seen, chosen)
    return _once(found, lambda f: shape(f["min"].alias("min"), f["max"].alias("max"), F.when(f.isNotNull(), rate_unit(text)).alias("unit")))


# Contract form and place

#: Tokens of sources for contract forms (fixed values).
CONTRACTS = {
    "contractor": "freelance", "detachering": "detachering", "freelance": "freelance", "interim": "interim", "permanent": "vast",
    "temporary": "interim", "tijdelijk": "interim", "vast": "vast", "vast dienstverband": "vast", "zzp": "freelance",
}


def contract_form(token: Column) -> Column:
    return _lookup(F.lower(F.trim(token)), CONTRACTS)


def agreed_contract(tokens: Column) -> Column:
    """The one contract form that all mappable tokens of a list agree on, else null."""
    forms = F.array_distinct(F.array_compact(F.transform(tokens, contract_form)))
    return F.when(F.size(forms) == 1, F.get(forms, F.lit(0)))


def work_form(text: Column) -> Column:
    """Hybrid before remote before on-site."""
    low = F.lower(text)
    return F.when(low.rlike("hybride|hybrid"), "hybride").when(low.rlike(r"\bremote\b|thuiswerk|op afstand"), "remote").when(low.rlike(r"op locatie|on[- ]?site|op kantoor"), "op locatie")


#: Spellings of provinces (fixed values).
PROVINCES = {
    "drenthe": "Drenthe", "flevoland": "Flevoland", "friesland": "Friesland", "fryslan": "Friesland", "fryslân": "Friesland", "gelderland": "Gelderland",
    "groningen": "Groningen", "limburg": "Limburg", "n-brabant": "Noord-Brabant", "n-holland": "Noord-Holland", "nb": "Noord-Brabant", "nh": "Noord-Holland",
    "noord brabant": "Noord-Brabant", "noord holland": "Noord-Holland", "noord-brabant": "Noord-Brabant", "noord-holland": "Noord-Holland",
    "noordbrabant": "Noord-Brabant", "noordholland": "Noord-Holland", "overijssel": "Overijssel", "utrecht": "Utrecht", "z-holland": "Zuid-Holland",
    "zeeland": "Zeeland", "zh": "Zuid-Holland", "zuid holland": "Zuid-Holland", "zuid-holland": "Zuid-Holland", "zuidholland": "Zuid-Holland",
}


def province(text: Column) -> Column:
    return _lookup(F.lower(F.regexp_replace(F.trim(text), r"(?i)^provincie(?:\s*:\s*|\s+)", "")), PROVINCES)


def last_province(text: Column) -> Column:
    """The last province named in running text; two-letter forms don't count there."""
    names = "|".join(sorted((p for p in PROVINCES if len(p) > 2), key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}-])(?:{names})(?![\p{{L}}-])"), F.lit(0))
    return _lookup(F.try_element_at(found, F.lit(-1)), PROVINCES)


# Dates

#: Months (fixed values).
MONTHS = {
    "januari": "01", "februari": "02", "maart": "03", "april": "04", "mei": "05", "juni": "06", "juli": "07", "augustus": "08",
    "september": "09", "oktober": "10", "november": "11", "december": "12",
}


def dutch_date(text: Column) -> Column:
    """A date from ``21 september 2026``; null if it isn't one of the calendar."""
    pattern = r"(?i)(\d{1,2})\s+([a-zé]+)\s+(\d{4})"
    day, month, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return F.try_to_date(F.concat_ws("-", year, _lookup(F.lower(month), MONTHS), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def closing_moment(text: Column, zone: str = "Europe/Amsterdam") -> Column:
    """A deadline as a UTC moment: a bare date ends with its local day, a time without offset is local, an offset is honoured."""
    t = F.trim(text)
    bare = t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    offset = t.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & ~bare
    end = F.to_utc_timestamp(F.try_to_timestamp(F.concat(t, F.lit(" 23:59:59.999"))), zone)
    return F.when(bare, end).when(offset, t.try_cast("timestamp")).otherwise(F.to_utc_timestamp(t.try_cast("timestamp_ntz").cast("timestamp"), zone))


# Lists


def skills(raw: Column, most: int = 40, length: int = 80) -> Column:
    """Trimmed names of at most ``length`` characters, the first of each whatever its case, ``most`` of them."""
    clean = F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: (s != "") & (F.length(s) <= length))
    first = lambda s, i: ~F.exists(F.slice(clean, F.lit(1), i), lambda e: F.lower(e) == F.lower(s))
    return F.slice(F.filter(clean, first), 1, most)


def contacts(raw: Column) -> Column:
    """People with an email or a phone, or a name and a role; the first of each name, email and phone."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    kept = F.filter(raw, lambda p: ~blank(p["email"]) | ~blank(p["phone"]) | (~blank(p["name"]) & ~blank(p["role"])))
    key = lambda p: F.struct(p["name"], F.lower(p["email"]), p["phone"])
    return F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda q: key(q).eqNullSafe(key(p))))


def carried(people: Column, stored: Column, fields: tuple[str, ...]) -> Column:
    """Contacts with those ``fields`` that only the pipeline knows, taken from the stored contact of the same name, email and phone."""
    key = lambda p: F.struct(p["name"], F.lower(p["email"]), p["phone"])

    def kept(p: Column) -> Column:
        same = F.get(F.filter(stored, lambda q: key(q).eqNullSafe(key(p))), F.lit(0))
        out = p
        for f in fields:
            out = out.withField(f, F.coalesce(p[f], same[f]))
        return out

    return F.transform(people, kept)


# Gaps and overlays


def gap(value: Column) -> Column:
    """Null or blank."""
    return F.coalesce(F.trim(value.cast("string")), F.lit("")) == ""


def fill(value: Column, proposal: Column, confidence: Column, least: float = 0.85) -> Column:
    """A gap takes a proposal of enough confidence; anything else stays."""
    return F.when(gap(value) & (confidence >= least), proposal).otherwise(value)


# Regions, moments, previews

#: Labels of regions by code, old and new codes alike (fixed values).
REGIONS = {
    "NL": "Nederland", "NL1": "Noord-Nederland", "NL11": "Groningen", "NL111": "Oost-Groningen", "NL112": "Delfzijl en omgeving", "NL113": "Overig Groningen",
    "NL114": "Oost-Groningen", "NL115": "Overig Groningen", "NL12": "Friesland", "NL121": "Noord-Friesland", "NL122": "Zuidwest-Friesland",
    "NL123": "Zuidoost-Friesland", "NL124": "Noord-Friesland", "NL125": "Zuidwest-Friesland", "NL126": "Zuidoost-Friesland", "NL127": "Noord-Friesland",
    "NL128": "Zuidwest-Friesland", "NL13": "Drenthe", "NL131": "Noord-Drenthe", "NL132": "Zuidoost-Drenthe", "NL133": "Zuidwest-Drenthe",
    "NL2": "Oost-Nederland", "NL21": "Overijssel", "NL211": "Noord-Overijssel", "NL212": "Zuidwest-Overijssel", "NL213": "Twente", "NL22": "Gelderland",
    "NL221": "Veluwe", "NL224": "Zuidwest-Gelderland", "NL225": "Achterhoek", "NL226": "Arnhem/Nijmegen", "NL23": "Flevoland", "NL230": "Flevoland",
    "NL3": "West-Nederland", "NL31": "Utrecht", "NL310": "Utrecht", "NL32": "Noord-Holland", "NL321": "Kop van Noord-Holland", "NL322": "Alkmaar en omgeving",
    "NL323": "IJmond", "NL324": "Agglomeratie Haarlem", "NL325": "Zaanstreek", "NL326": "Groot-Amsterdam", "NL327": "Het Gooi en Vechtstreek",
    "NL328": "Alkmaar en omgeving", "NL329": "Groot-Amsterdam", "NL32A": "Agglomeratie Haarlem", "NL32B": "Groot-Amsterdam", "NL33": "Zuid-Holland",
    "NL331": "Agglomeratie Leiden en Bollenstreek", "NL332": "Agglomeratie 's-Gravenhage", "NL333": "Delft en Westland", "NL337": "Agglomeratie Leiden en Bollenstreek",
    "NL338": "Oost-Zuid-Holland", "NL339": "Groot-Rijnmond", "NL33A": "Zuidoost-Zuid-Holland", "NL33B": "Oost-Zuid-Holland", "NL33C": "Groot-Rijnmond",
    "NL34": "Zeeland", "NL341": "Zeeuwsch-Vlaanderen", "NL342": "Overig Zeeland", "NL35": "Utrecht", "NL350": "Utrecht", "NL36": "Zuid-Holland",
    "NL361": "Agglomeratie 's-Gravenhage", "NL362": "Delft en Westland", "NL363": "Agglomeratie Leiden en Bollenstreek", "NL364": "Zuidoost-Zuid-Holland",
    "NL365": "Oost-Zuid-Holland", "NL366": "Groot-Rijnmond", "NL4": "Zuid-Nederland", "NL41": "Noord-Brabant", "NL411": "West-Noord-Brabant",
    "NL412": "Midden-Noord-Brabant", "NL413": "Noordoost-Noord-Brabant", "NL414": "Zuidoost-Noord-Brabant", "NL415": "Midden-Noord-Brabant",
    "NL416": "Noordoost-Noord-Brabant", "NL42": "Limburg", "NL421": "Noord-Limburg", "NL422": "Midden-Limburg", "NL423": "Zuid-Limburg",
}


def region_name(raw: Column) -> Column:
    """A written region with single spaces; capitals in words, behind spaces, dashes and slashes, unless it is in mixed case already."""
    t = F.regexp_replace(F.trim(raw), r"\s+", " ")
    mixed = (t != F.upper(t)) & (t != F.lower(t))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[^\s/-]+|[\s/-]"), F.lit(0))
    return F.when(mixed, t).otherwise(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""))


def region(codes: Column) -> Column:
    """The name of the most specific of ``array<struct<code, name>>``: the longest code, a written name before the table's, then the first."""
    known = F.transform(codes, lambda c, i: F.struct(F.length(F.trim(c["code"])).alias("size"), (~gap(c["name"])).alias("written"), (-i).alias("first"), F.when(~gap(c["name"]), region_name(c["name"])).otherwise(_lookup(F.upper(F.trim(c["code"])), REGIONS)).alias("label")))
    return F.array_max(F.filter(known, lambda c: (c["size"] > 0) & c["label"].isNotNull()))["label"]


def publication(text: Column) -> Column:
    """The moment of an ISO date or date-time, to the millisecond; without offset it is UTC; null if it isn't one of the calendar."""
    form = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:\d{2})?)?$")
    zoned = text.rlike(r"T.*(?:Z|[+-]\d{2}:\d{2})$")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d{1,3})\d*", "$1"), r"(T\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    moment = F.when(zoned, short).otherwise(F.concat(F.when(text.contains("T"), short).otherwise(F.concat(short, F.lit("T00:00:00"))), F.lit("Z")))
    return F.when(form, moment.try_cast("timestamp"))


def title_fallback(title: Column, platform: Column, reference: Column) -> Column:
    """The description that stands in for a missing one."""
    return F.concat(title, F.lit(" ("), platform, F.lit("/"), reference, F.lit(")"))


def preview(text: Column, most: int = 500) -> Column:
    """The text, cut with an ellipsis if it is longer than ``most`` characters."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def visible_contacts(people: Column, last_seen: Column, days: Column, now: Column) -> Column:
    """Contacts are shown for ``days`` after the posting was last seen; what is stored stays."""
    return F.when(F.unix_millis(now) - F.unix_millis(last_seen) <= days * 86_400_000, people).otherwise(F.slice(people, 1, 0))


def digest(*columns: Column) -> Column:
    """SHA-256 of values as one JSON text: equal values, equal digests."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def projection_hash(partition: Column, *columns: Column) -> Column:
    """The partition and a digest of what is indexed: another one, and the document is written anew."""
    return F.concat(partition, F.lit(":"), digest(*columns))


def keyword_score(haystack: Column, words: str) -> Column:
    """How many of the words (two letters or more) occur in the text as substrings."""
    terms = [w for w in re.split(r"[^a-z0-9_]+", words.lower()) if len(w) >= 2]
    return reduce(add, [F.lower(haystack).contains(w).cast("int") for w in terms], F.lit(0))


#: The 53-bit hash cyrb53 (public domain): first states of its two halves, their multipliers, and those that mix them at the end (fixed values).
HASH_STATES, HASH_TIMES, HASH_MIXES = (0xDEADBEEF, 0x41C6CE57), (2654435761, 1597334677), (2246822507, 3266489909)
WORD32 = 0xFFFFFFFF


def _times32(a: Column, b: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers; the halves of one factor keep it inside a long."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD32))


def id_hash(text: Column, seed: int = 0) -> Column:
    """The 53-bit number that stands for an id in an index and breaks ties of a sort.

    Ids are read as JavaScript's ``codePointAt`` reads them, by UTF-16 unit: a character beyond the basic plane counts
    as its code point and once more as its low surrogate.
    """
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    low = lambda p: ((p - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00).cast("long")
    signs = F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, F.array(p, low(p))).otherwise(F.array(p))))

    def half(i: int) -> Column:
        start = F.lit((HASH_STATES[i] ^ seed) & WORD32).cast("long")
        return F.aggregate(signs, start, lambda h, c: _times32(h.bitwiseXOR(c), HASH_TIMES[i]))

    one, two = HASH_MIXES
    mixed = lambda own, other: _times32(own.bitwiseXOR(F.shiftright(own, 16)), one).bitwiseXOR(_times32(other.bitwiseXOR(F.shiftright(other, 13)), two))
    whole = lambda h: _once(F.struct(h["b"].alias("b"), mixed(h["a"], h["b"]).alias("a")), lambda m: mixed(m["b"], m["a"]).bitwiseAND(F.lit(0x1FFFFF)) * F.lit(1 << 32) + m["a"])
    return _once(F.struct(half(0).alias("a"), half(1).alias("b")), whole)
