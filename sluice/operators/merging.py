"""Merging what a source says into what is stored: facts with cleared markers, column precedence, guarded filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.values import gap

#: What a source sends for a fact that it has withdrawn (fixed value).
CLEARED = "CLEARED"
#: Keys that name the same fact; a marker for one of them stands for all (fixed values).
SAME_FACT = (
    ("locatie", "locatie_tekst", "locatieTekst"),
    ("tarief", "tarief_min", "tarief_max", "tarief_eenheid", "tariefMin", "tariefMax", "tariefEenheid"),
    ("opdrachtgever_naam", "opdrachtgeverNaam"),
    ("start_datum", "startDatum"),
    ("contracttype", "contract_type"),
    ("werkvorm",),
)
#: Keys that a column is read from, the first that says something (fixed values).
COLUMN_KEYS = {
    "contract": ("contracttype", "contract_type", "employment_type"),
    "ends": ("eind_datum", "eindDatum"),
    "posted": ("publicatiedatum", "gepubliceerd_op", "publicatie_datum", "json_ld_date_posted"),
    "hours": ("uren_per_week", "uren_per_week_raw"),
    "work_form": ("werkvorm",),
}


def same_fact(keys: Column, groups: tuple[tuple[str, ...], ...] = SAME_FACT) -> Column:
    """``keys`` and all keys that name the same facts, sorted."""
    table = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    return F.array_sort(F.array_union(keys, F.flatten(F.filter(table, lambda g: F.arrays_overlap(g, keys)))))


def merged(stored: Column, marked: Column, arrived: Column) -> Column:
    """``struct<facts, marked>``: stored facts (a map of strings) under those that arrived, and the markers afterwards.

    Null and blank values say nothing.  ``CLEARED`` removes the fact and marks it, under all its names; any other value
    replaces the fact and lifts its markers.
    """
    said = F.map_filter(arrived, lambda k, v: ~gap(v))
    withdrawn = F.map_keys(F.map_filter(said, lambda k, v: v == CLEARED))
    new = F.map_filter(said, lambda k, v: v != CLEARED)
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(said), k))
    left = F.array_except(marked, same_fact(F.map_keys(new)))
    return F.struct(F.map_concat(kept, new).alias("facts"), F.array_sort(F.array_union(left, same_fact(withdrawn))).alias("marked"))


def first_said(facts: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key that isn't blank."""
    return F.coalesce(*(F.when(~gap(facts[k]), facts[k]) for k in keys))


def written(facts: Column) -> Column:
    """A map as ``key=value`` lines in the order of keys: equal maps give equal texts."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(facts)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def guarded_fill(current: DataFrame, proposals: DataFrame, key: str, token: str, value: str, least: float = 0.85) -> DataFrame:
    """``key, outcome, value`` of proposals (``key``, ``expected``, ``proposal``, ``confidence``): filled only where nobody wrote since.

    ``stale`` where the row is gone or its token isn't the expected one, ``applied`` where a gap takes a proposal of enough
    confidence, else ``nothing_to_fill``.
    """
    now = current.select(key, F.col(token).alias("token"), F.col(value).alias("now"))
    seen = proposals.select(key, "expected", "proposal", "confidence").join(now, key, "left")
    fits = F.coalesce(F.col("token") == F.col("expected"), F.lit(False))
    takes = gap(F.col("now")) & ~gap(F.col("proposal")) & (F.col("confidence") >= least)
    outcome = F.when(~fits, "stale").when(takes, "applied").otherwise("nothing_to_fill")
    return seen.select(key, outcome.alias("outcome"), F.when(fits & takes, F.col("proposal")).otherwise(F.col("now")).alias("value"))


#: Confidence from which a proposal is applied, and from which it is shown as one (fixed values).
APPLY, BADGE = 0.85, 0.80


def candidates(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, gaps`` of rows that lack something: the names of their empty fields."""
    empty = F.array_compact(F.array(*(F.when(gap(F.col(f)), f) for f in fields)))
    return rows.select(key, empty.alias("gaps")).where(F.size("gaps") > 0)


def best_proposals(proposals: DataFrame, key: str) -> DataFrame:
    """``key, field, value, confidence, use``: the surest proposal for each field, the least value on a tie, applied or shown by its confidence."""
    order = F.struct("confidence", F.col("value"))
    best = proposals.where(~gap(F.col("value"))).groupBy(key, "field").agg(F.max(order).alias("b"))
    use = F.when(F.col("b.confidence") >= APPLY, "apply").when(F.col("b.confidence") >= BADGE, "badge").otherwise("none")
    return best.select(key, "field", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), use.alias("use"))


def overlay(rows: DataFrame, proposals: DataFrame, key: str, fields: list[str], stand_in: dict[str, Column] | None = None) -> DataFrame:
    """Rows whose gaps in ``fields`` are filled by proposals that may be applied; other columns pass through.

    ``stand_in`` gives for a field the text that stands for a missing one, such as a description made of the title: it is a
    gap like an empty field.  Proposals become one row for each key, so rows are joined once whatever the number of fields.
    """
    usable = best_proposals(proposals, key).where((F.col("use") == "apply") & F.col("field").isin(fields))
    wide = usable.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_given"))
    stand_in = stand_in or {}
    lacks = lambda f: gap(F.col(f)) | (F.coalesce(F.col(f) == stand_in[f], F.lit(False)) if f in stand_in else F.lit(False))
    filled = {f: F.when(lacks(f), F.coalesce(F.col("_given")[f], F.col(f))).otherwise(F.col(f)) for f in fields}
    return rows.join(wide, key, "left").withColumns(filled).drop("_given").select(*rows.columns)


def coverage(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """``by, field, n, filled, coverage`` of every field, in one pass."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), (~gap(F.col(f).cast("string"))).cast("int").alias("filled")) for f in fields))
    long = rows.select(by, F.explode(cells).alias("c")).groupBy(by, F.col("c.field").alias("field"))
    return long.agg(F.count("*").alias("n"), F.sum("c.filled").alias("filled"), F.round(F.avg("c.filled"), 6).alias("coverage"))


def without_repeats(arrived: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """What is to be appended so that a replay changes nothing: rows of new keys, one of each (the least row)."""
    rest = [c for c in arrived.columns if c not in key]
    one = arrived.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*")
    return one.join(existing.select(*key), key, "left_anti").select(*arrived.columns)


def renamed_members(rows: DataFrame, pairs: DataFrame, source: str, key: list[str]) -> DataFrame:
    """Rows of merged sources under the source that stays; of rows that then meet, the one that was there is kept.

    ``pairs`` (``old, new``) is a small table of sources, so it is broadcast behind Spark's own size check.
    """
    known = pairs.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    moved = rows.join(known, F.col(source) == F.col("_old"), "left").withColumn("_moved", F.col("_new").isNotNull()).withColumn(source, F.coalesce("_new", source))
    rest = [c for c in rows.columns if c not in (source, *key)]
    best = moved.groupBy(source, *key).agg(F.min(F.struct("_moved", "_old", *rest)).alias("_row"))
    return best.select(source, *key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)
