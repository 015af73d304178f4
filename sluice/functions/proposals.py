"""Values that postings name by label or linked data, as proposals for the fields a draft lacks - as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import html, values

#: How postings label a field (fixed values).
LABELS = {
    "place": r"Locatie|Standplaats|Werklocatie",
    "contract": r"Contract(?:vorm|type)?|Type opdracht",
    "work_form": r"Werkvorm|Remote|Thuiswerken|Hybride werken",
    "hours": r"Uren per week|Uren\/week|Uren p\/w|Aantal uur(?: per week)?|Hours per week|Weekly hours",
    "education": r"Opleidingsniveau|Opleidingsvereisten?|Gewenste opleiding|Opleiding|Education(?:al)? level|Qualifications?",
    "starts": r"Startdatum|Ingangsdatum|Start date|Start|Aanvang(?:\s+opdracht)?",
    "ends": r"Einddatum|End date|Ends|Einde(?:\s+opdracht)?|Loop tot|Loopt tot",
    "closes": r"Sluitingsdatum|Sluiting|Reageren voor|Reageren tot|Uiterste reactiedatum|Reactiedatum|Deadline|Closing date|Apply by|Sollicitatiedatum",
    "client": r"Organisatie|Opdrachtgever|Eindklant|Organisation|Organization|Klant|Client",
}
#: Labels that end the value before them (fixed values).
STOPS = (
    r"Tarief|Contract(?:vorm|type)?|Type opdracht|Werkvorm|Remote|Thuiswerken|Hybride werken|Locatie|Standplaats|Werklocatie|Gepubliceerd|Publicatiedatum"
    r"|Uren per week|Uren\/week|Uren p\/w|Aantal uur|Hours per week|Weekly hours|Opleidingsniveau|Opleidingsvereisten?|Opleiding|Education(?:al)? level|Qualifications?"
    r"|Startdatum|Ingangsdatum|Start date|Start|Aanvang|Einddatum|End date|Ends|Einde|Loop tot|Loopt tot|Sluitingsdatum|Sluiting|Reageren voor|Reageren tot"
    r"|Uiterste reactiedatum|Reactiedatum|Deadline|Closing date|Apply by|Sollicitatiedatum|Organisatie|Opdrachtgever|Eindklant|Organisation|Organization|Klant|Client"
)
#: What is no value, though a label stands before it (fixed values).
NOTHING = r"(?i)^(?:n\.?\s?v\.?\s?t\.?|n\.?\s?a\.?|na|nnb|onbekend|unknown|geen|none|t\.?\s?b\.?\s?d\.?|in overleg)\.?$"
#: How sure a proposal of each field is (fixed values).
SURE = {
    "place": 0.9, "rate": 0.86, "contract": 0.88, "work_form": 0.88, "posted": 0.95, "description": 0.95,
    "hours": 0.9, "education": 0.86, "starts": 0.88, "ends": 0.88, "closes": 0.88, "client": 0.85,
}
#: Characters of the text around a value that a proposal shows.
BEFORE, BEHIND = 20, 40
PROPOSAL = "array<struct<field:string,value:map<string,string>,confidence:double,path:string,excerpt:string>>"


def labelled_text(description: Column, markup: Column | None = None) -> Column:
    """One line: the description, then the page with its definition lists and header cells as ``Label: value``; both come stripped."""
    line = html.strip(F.coalesce(description, F.lit("")))
    if markup is not None:
        pairs = markup
        for name, of in (("dt", "dd"), ("th", "td")):
            pairs = F.regexp_replace(pairs, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>\s*<{of}\b[^>]*>(.*?)</{of}>", "$1: $2 ")
        line = F.trim(F.concat_ws(" ", line, html.strip(F.coalesce(pairs, F.lit("")))))
    return line


def day(text: Column) -> Column:
    """``yyyy-MM-dd`` of a date written so, as ``d-m-yyyy`` or ``d/m/yyyy``, or with a Dutch month; null if the calendar has none."""
    parts = lambda i: F.regexp_extract(text, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$", i)
    numeric = F.concat_ws("-", parts(3), F.lpad(parts(2), 2, "0"), F.lpad(parts(1), 2, "0"))
    found = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"), F.try_to_date(numeric, "yyyy-MM-dd")).otherwise(values.dutch_date(text))
    return found.cast("string")


def closing(text: Column) -> Column:
    """A day, or the moment of an ISO date-time in UTC; a time without offset is local."""
    timed = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ][\d:.]+(?:Z|[+-]\d{2}:?\d{2})?$")
    moment = F.date_format(values.closing_moment(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(day(text), F.when(timed, moment))


def _informative(text: Column) -> Column:
    return F.when((F.length(text) >= 2) & ~text.rlike(NOTHING), text)


#: What a labelled value becomes; null where it says nothing.
READ: dict[str, Callable[[Column], Column]] = {
    "place": lambda v: v, "contract": F.lower, "work_form": lambda v: v, "hours": values.hours_text, "education": _informative,
    "starts": day, "ends": day, "closes": closing, "client": _informative,
}


def _proposal(field: str, cells: dict[str, Column], path: Column | str, excerpt: Column) -> Column:
    value = F.map_filter(F.create_map(*(x for k, c in cells.items() for x in (F.lit(k), c.cast("string")))), lambda k, v: v.isNotNull())
    return F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(SURE[field]).alias("confidence"), (F.lit(path) if isinstance(path, str) else path).alias("path"), F.trim(excerpt).alias("excerpt"))


def _any_of(labels: str) -> str:
    """One of ``labels``, behind a look at its first three letters: most places of a text fail there, before any label is tried."""
    starts = re.split(r"\|(?![^(]*\))", labels)
    return "(?=" + "".join(f"[{''.join(sorted({s[i] for s in starts}))}]" for i in range(3)) + f")(?:{labels})"


def labelled(line: Column, field: str) -> Column:
    """The proposal of one label in a text of one line, null if it isn't there or says nothing.

    The first label counts.  Its value ends at the next label of any field or with the text and loses closing punctuation.
    The text is searched once, for label and value; all else is read from these.
    """
    label = rf"{_any_of(LABELS[field])}\s*:\s*"
    found = F.regexp_extract(line, rf"(?i)({label}(?=.).*?)(?:\s+{_any_of(STOPS)}\s*:|(?!.))", 1)
    return values._once(found, lambda found: F.when(found != "", _labelled(line, field, label, found)))


def _labelled(line: Column, field: str, label: str, found: Column) -> Column:
    value = F.trim(F.regexp_replace(F.trim(F.regexp_extract(found, rf"(?i)^{label}(.+)", 1)), r"[.,;:]+$", ""))
    # From the label's first character, counted from 0.
    shown = lambda at: F.substr(line, F.greatest(at - BEFORE, F.lit(0)) + 1, F.least(at, F.lit(BEFORE)) + F.length(found) + BEHIND)
    told = lambda read: _proposal(field, {field: read}, "description", values._once(F.instr(line, found) - 1, shown))
    return values._once(values._once(value, READ[field]), lambda read: F.when(read != "", told(read)))


def rated(line: Column) -> Column:
    """The proposal of a rate anywhere in the text, null without an amount."""
    at = F.regexp_instr(line, F.lit("(?i)tarief|ratio|rate|€")) - 1
    size = F.length(F.regexp_extract(line, "(?i)(tarief|ratio|rate|€)", 1))
    start = F.greatest(at - BEFORE, F.lit(0))
    shown = F.when(at >= 0, F.substr(line, start + 1, at - start + size + BEHIND)).otherwise(F.substr(line, F.lit(1), F.lit(120)))
    cells = lambda r: {"rate_min": r["min"], "rate_max": r["max"], "rate_unit": r["unit"], "rate_currency": F.lit("EUR")}
    return values._once(values.rate(line), lambda r: F.when(r["min"].isNotNull() | r["max"].isNotNull(), _proposal("rate", cells(r), "description", shown)))


def dated(posted: Column) -> Column:
    """The proposal of linked data's date of publication: an ISO date or date-time of the calendar, nothing relative."""
    t = F.trim(posted)
    honest = t.rlike(r"^\d{4}-\d{2}-\d{2}") & t.try_cast("timestamp").isNotNull()
    return F.when(honest, _proposal("posted", {"posted": t}, "linked.datePosted", F.concat(F.lit("datePosted: "), t)))


def described(description: Column, stand_in: Column, linked: Column, markup: Column) -> Column:
    """The proposal of a description for a posting that has a stand-in only: linked data's, else the page's main part."""
    of_linked, of_page = html.usable(linked), html.usable(F.regexp_extract(markup, r"(?is)<main\b[^>]*>(.*?)</main>", 1))
    found = F.coalesce(of_linked, of_page)
    path = F.when(of_linked.isNotNull(), "linked.description").otherwise("page.main")
    return F.when((description == stand_in) & (found != stand_in), _proposal("description", {"description": found}, path, F.substr(found, F.lit(1), F.lit(160))))


def proposals(
    description: Column, markup: Column | None = None, posted: Column | None = None, linked: Column | None = None, stand_in: Column | None = None, fields: tuple[str, ...] = tuple(SURE)
) -> Column:
    """What a posting's text and page say for each of ``fields``, as an array of :data:`PROPOSAL`'s structs.

    ``markup`` is the page, ``posted`` and ``linked`` are linked data's date and description (``html.posting_facts``),
    ``stand_in`` is the description that stands for a missing one (``values.title_fallback``).  An excerpt shows 20 characters
    before the label and 40 behind the value.  Nulls and empty texts give an empty array; a text of any length is read
    whole, once for the row.
    """
    none = F.lit(None).cast("string")

    def found(line: Column) -> Column:
        cells = [labelled(line, f) for f in LABELS if f in fields]
        cells += [rated(line)] if "rate" in fields else []
        cells += [dated(posted)] if "posted" in fields and posted is not None else []
        if "description" in fields and stand_in is not None and markup is not None:
            cells.append(described(description, stand_in, none if linked is None else linked, markup))
        return F.array_compact(F.array(*(c.cast(PROPOSAL[6:-1]) for c in cells))) if cells else F.array().cast(PROPOSAL)

    return values._once(labelled_text(description, markup), found)
