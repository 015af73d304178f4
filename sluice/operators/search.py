"""Boolean search over documents: predicates, filters, facets, totals, sorts and pages, all as Columns.

A search document has ``id, title, text, client, source, status, lang, contract, skills, rate_min, rate_max,
hours_min, hours_max, posted, closing, last_seen``; what a table lacks is simply not filtered on.  A text
condition is composed from ``term`` with ``&``, ``|`` and ``~``; Catalyst sees one predicate and the scan
reads only its columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import stems

#: Rows that a result may be paged through.
WINDOW = 1000
#: Seconds to which the clock is floored when deadlines are compared.
FENCE_SECONDS = 300
#: Buckets kept of each facet.
FACET_SIZES = {"source": 100, "status": 50, "lang": 50, "contract": 50, "location": 50, "province": 100, "skills": 20}


def haystack(*columns: str) -> Column:
    """The lower-cased text that terms are looked for in; null parts are left out."""
    return F.lower(F.concat_ws(" ", *columns))


def term(words: str, scope: Column) -> Column:
    """A term or phrase occurs in the scope, as a substring, whatever its case."""
    return scope.contains(words.lower())


def matches(scope: Column, condition: Callable[[Column], Column]) -> Column:
    """A condition of several terms over one scope, whose text is put together and lower-cased once for a row."""
    return F.exists(F.array(scope), condition)


def relevance(terms: list[str], title: Column, skills: Column, rest: Column) -> Column:
    """3 for each term in the title, 2 in the skills, 1 elsewhere."""
    points = [F.when(F.lower(c).contains(t.lower()), w).otherwise(0) for t in terms for c, w in ((title, 3), (skills, 2), (rest, 1))]
    total = F.lit(0)
    for p in points:
        total = total + p
    return total


@dataclass(frozen=True)
class Filters:
    """Filters of a search; an empty list filters nothing, a null value passes no filter that is set."""

    sources: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    provinces: list[str] = field(default_factory=list)
    work_forms: list[str] = field(default_factory=list)
    rate_units: list[str] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)
    contracts: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    rate: tuple[float | None, float | None] = (None, None)
    hours: tuple[float | None, float | None] = (None, None)
    posted: tuple[str | None, str | None] = (None, None)
    fresh_days: int | None = None


def overlaps(low: Column, high: Column, wanted: tuple[float | None, float | None]) -> Column:
    """The document's range meets the wanted one; an unknown end fails."""
    at_least, at_most = wanted
    test = F.lit(True)
    if at_least is not None:
        test &= high >= at_least
    if at_most is not None:
        test &= low <= at_most
    return F.coalesce(test, F.lit(False))


def shown_location() -> Column:
    """What a document is filtered and counted by: its location, else its country, but nothing if ``location_unknown`` says so."""
    return F.when(~F.coalesce("location_unknown", F.lit(False)), F.coalesce("location", "country"))


def predicate(f: Filters, now: datetime) -> Column:
    """All filters that are set, as one condition."""
    test = F.lit(True)
    for column, values in (("source", f.sources), ("status", f.statuses), ("lang", f.langs)):
        if values:
            test &= F.coalesce(F.col(column).isin(values), F.lit(False))
    for column, values in (("province", f.provinces), ("work_form", f.work_forms), ("rate_unit", f.rate_units)):
        if values:
            test &= F.coalesce(F.col(column).isin(values), F.lit(False))
    if f.locations:
        test &= F.coalesce(shown_location().isin(f.locations), F.lit(False))
    if f.countries:
        test &= F.coalesce(F.col("country").isin(f.countries) & ~F.coalesce("location_unknown", F.lit(False)), F.lit(False))
    if f.contracts:
        test &= F.coalesce("contract", F.lit("")).isin(f.contracts)
    if f.skills:
        test &= F.coalesce(F.size(F.array_except(F.array(*map(F.lit, f.skills)), "skills")) == 0, F.lit(False))
    if f.rate != (None, None):
        test &= overlaps(F.col("rate_min"), F.col("rate_max"), f.rate)
    if f.hours != (None, None):
        test &= overlaps(F.col("hours_min"), F.col("hours_max"), f.hours)
    if f.posted[0]:
        test &= F.coalesce(F.col("posted") >= F.lit(f.posted[0]).cast("timestamp"), F.lit(False))
    if f.posted[1]:  # the last day counts whole
        test &= F.coalesce(F.col("posted") < F.date_add(F.lit(f.posted[1]).cast("date"), 1).cast("timestamp"), F.lit(False))
    if f.fresh_days is not None:
        test &= F.coalesce(F.unix_timestamp("last_seen") >= F.lit(int(now.timestamp()) - f.fresh_days * 86_400), F.lit(False))
    return test


def partition(now: datetime, recent_days: int | None = None) -> Column:
    """``archive`` for closed or stale documents, those whose deadline has passed and, if asked, those not seen for long; else ``active``."""
    passed = F.coalesce(F.unix_timestamp("closing") < F.lit(int(now.timestamp())), F.lit(False))
    if recent_days is not None:
        passed |= F.coalesce(F.unix_timestamp("last_seen") < F.lit(int(now.timestamp()) - recent_days * 86_400), F.lit(False))
    return F.when(F.col("status").isin("closed", "stale") | passed, "archive").otherwise("active")


def forms(words: str, stored: Column) -> Column:
    """The words, one after the other and in whatever form, occur in a ``stems`` column that :func:`store` has written."""
    return stored.contains(F.concat(F.lit(" "), stems.stemmed(F.lit(words)), F.lit(" ")))


def store(documents: DataFrame, path: str, now: datetime, recent_days: int | None = None, searched: tuple[str, ...] = ()) -> None:
    """Search documents written by partition, so that a search of the active ones reads no other files.

    With ``searched`` columns their lower-cased ``haystack`` and the ``stems`` of its words, a space around each, are
    written once, so that no query makes them again.
    """
    placed = documents.withColumn("partition", partition(now, recent_days))
    if searched:
        stemmed = F.concat(F.lit(" "), stems.stemmed(F.concat_ws(" ", *searched)), F.lit(" "))
        placed = placed.withColumns({"haystack": haystack(*searched), "stems": stemmed})
    placed.repartition("partition", F.pmod(F.xxhash64("id"), F.lit(64))).write.mode("overwrite").partitionBy("partition").parquet(path)


def scope(stored: DataFrame, name: str) -> DataFrame:
    """The stored documents of a scope: ``active`` prunes the archive's files, ``all`` reads both."""
    return stored.where(F.col("partition") == "active") if name == "active" else stored


#: Facts under which a column is found where it is empty itself (fixed values).
FALLBACKS = {"rate_unit": ("tarief_eenheid", "tariefEenheid"), "contract": ("contracttype", "contract_type"), "work_form": ("werkvorm",)}


def projected(rows: DataFrame, facts: str = "facts", fallbacks: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows as search documents: a column that is blank takes the first fact that isn't."""
    fallbacks = FALLBACKS if fallbacks is None else fallbacks
    said = lambda c: F.when(F.trim(c) != "", c)
    return rows.withColumns({c: F.coalesce(said(F.col(c)), *(said(F.col(facts)[k]) for k in keys)) for c, keys in fallbacks.items()})


def before_deadline(now: datetime) -> Column:
    """The deadline is later than now, floored to five minutes; documents without one pass."""
    fence = int(now.timestamp()) // FENCE_SECONDS * FENCE_SECONDS
    return F.coalesce(F.unix_timestamp("closing") > F.lit(fence), F.lit(True))


def totals(matched: DataFrame, now: datetime) -> DataFrame:
    """``total, archive_total`` in one pass; the deadline is compared on the active side only."""
    here = F.col("partition") == "active"
    return matched.agg(F.count_if(here & before_deadline(now)).alias("total"), F.count_if(~here).alias("archive_total"))


def facets(matched: DataFrame, scalar: list[str], many: str | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """``field, value, n`` for all facets in one pass: each document is one row for each field and value.

    Empty and null values are left out; a null contract counts as ``unknown``.  ``sizes`` keeps the first
    values of a field by count, then code point.
    """
    value = lambda c: F.coalesce(F.col(c), F.lit("unknown")) if c == "contract" else F.col(c)
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), value(c).cast("string").alias("value")) for c in scalar))
    if many:
        pairs = F.concat(pairs, F.transform(F.array_distinct(F.coalesce(many, F.array().cast("array<string>"))), lambda x: F.struct(F.lit(many).alias("field"), x.alias("value"))))
    out = matched.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    if sizes:
        rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
        limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("field")), F.lit(2**31 - 1))
        out = out.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    return out


SORTS = {
    "newest": [F.desc_nulls_last, "posted"],
    "oldest": [F.asc_nulls_last, "posted"],
    "rate-high": [F.desc_nulls_last, "rate_max"],
    "rate-low": [F.asc_nulls_last, "rate_min"],
    "closing-soon": [F.asc_nulls_last, "closing"],
    "title-asc": [F.asc_nulls_last, "title"],
    "company-asc": [F.asc_nulls_last, "client"],
}


def ordered(matched: DataFrame, mode: str) -> list[Column]:
    """Sort keys of a mode: unknown values last, ids break ties; ``relevance`` leaves the ids only.

    Rates are compared where their unit is known, if the documents have ``rate_unit`` at all.
    """
    if mode == "relevance":
        return [F.col("id").asc()]
    by, column = SORTS[mode]
    value = F.col(column)
    if column.startswith("rate") and "rate_unit" in matched.columns:
        value = F.when(F.col("rate_unit").isNotNull(), value)
    return [by(value), F.col("id").asc()]


def page(matched: DataFrame, mode: str, offset: int, limit: int) -> DataFrame:
    """One page inside the first ``WINDOW`` rows of the order: a top-k, never a whole sort."""
    return matched.orderBy(*ordered(matched, mode)).limit(min(offset + limit, WINDOW)).offset(offset)


def after(rows: DataFrame, keys: list[str], cursor: list, limit: int) -> DataFrame:
    """The next ``limit`` rows behind a cursor, newest first: ``(k1, k2) < (c1, c2)`` written out."""
    (k1, k2), (c1, c2) = keys, cursor
    behind = (F.col(k1) < c1) | ((F.col(k1) == c1) & (F.col(k2) < c2))
    return rows.where(behind).orderBy(F.desc(k1), F.desc(k2)).limit(limit)
