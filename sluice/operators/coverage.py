"""Audit of what lands of each source's drafts: the fields a reader sees, and the keys a source fills."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import values

#: Keys of a source's own values that fill a field (fixed values).
ALIASES = {
    "contract": ("contracttype", "contract_type", "employment_type"),
    "duration": ("duration", "duur", "looptijd_tekst", "periode", "verwachte_duur"),
    "ends": ("eind_datum", "eindDatum"),
    "posted": ("publicatiedatum", "gepubliceerd_op", "publicatie_datum", "json_ld_date_posted"),
    "education": ("opleidingsniveau", "education_level"),
    "client": ("opdrachtgever_naam", "opdrachtgeverNaam"),
    "province": ("provincie",),
    "skills": ("skills",),
    "starts": ("start_datum", "startDatum"),
    "hours": ("uren_per_week", "uren_per_week_raw"),
    "work_form": ("werkvorm",),
}
#: What stands for no value in stored drafts, and keys that are no values (fixed values).
SENTINELS, NO_KEYS = ("unknown", "cleared"), ("_cleared", "label_block")
#: The audited fields, in the order in which they are reported.
FIELDS = ("client", "place", "rate", "contract", "work_form", "posted", "closes", "hours", "education", "starts", "ends", "duration", "province", "skills")


def live(text: Column) -> Column:
    """Whether a text says something: it isn't null, blank or a sentinel."""
    return F.coalesce((F.trim(text) != "") & ~text.isin(*SENTINELS), F.lit(False))


def _json(extra: Column, key: str) -> Column:
    """A key's value as JSON text, so that numbers and texts can be told apart."""
    return F.to_json(F.try_variant_get(extra, f'$["{key}"]', "variant"))


def _text(extra: Column, key: str) -> Column:
    """A key's value if it is a text that isn't blank."""
    raw = _json(extra, key)
    return F.when(raw.startswith('"') & (F.trim(F.try_variant_get(extra, f'$["{key}"]', "string")) != ""), F.try_variant_get(extra, f'$["{key}"]', "string"))


def filled(extra: Column, keys: tuple[str, ...]) -> Column:
    """Whether one of the keys holds a number other than 0 or a text that says something."""
    number = lambda raw: F.coalesce(raw.rlike(r"^-?\d") & (raw.try_cast("double") != 0), F.lit(False))
    return reduce(or_, [number(_json(extra, k)) | live(_text(extra, k)) for k in keys])


def contract(extra: Column) -> Column:
    """The contract form that a reader sees: of the first direct token, else the one that all employment types agree on."""
    one, two, kinds = (_text(extra, k) for k in ALIASES["contract"])
    direct = F.coalesce(one, two)
    return F.when(direct.isNotNull(), values.contract_form(direct)).otherwise(values.agreed_contract(F.split(kinds, ",")))


def landed(extra: Column) -> dict[str, Column]:
    """For each of :data:`FIELDS` whether a reader of the draft sees it.

    The draft has ``client, place, starts`` (text), ``closes`` (moment) and ``rate`` (``min, max, unit``); ``extra`` is a VARIANT
    of what else the source says.  A contract, date of publication or province counts only if it is one.
    """
    of = lambda field: filled(extra, ALIASES[field])
    moment = F.coalesce(*(_text(extra, k) for k in ALIASES["posted"]))
    names = F.coalesce(F.try_variant_get(extra, '$["skills"]', "array<string>"), F.array().cast("array<string>"))
    cells = {
        "client": live(F.col("client")) | of("client"),
        "place": live(F.col("place")),
        "rate": F.col("rate.min").isNotNull() | F.col("rate.max").isNotNull() | F.col("rate.unit").isNotNull(),
        "contract": contract(extra).isNotNull(),
        "posted": values.publication(F.trim(moment)).isNotNull(),
        "closes": F.col("closes").isNotNull(),
        "starts": live(F.col("starts")) | of("starts"),
        "province": values.province(_text(extra, "provincie")).isNotNull(),
        "skills": F.size(values.skills(names)) > 0,
    }
    return {f: F.coalesce(cells[f] if f in cells else of(f), F.lit(False)) for f in FIELDS}


def audit(drafts: DataFrame, by: str, extra: str) -> DataFrame:
    """``by, field, records, landed, share`` of every source and field, in :data:`FIELDS`' order within a source.

    ``extra`` is JSON text; one that is null or no JSON says nothing.  Rejected rows (``rejected`` true, where that column
    exists) count as such in ``rejected`` only.  One pass: fourteen counters for each source are summed before the shuffle.
    """
    kept = ~F.coalesce("rejected", F.lit(False)) if "rejected" in drafts.columns else F.lit(True)
    read = drafts.withColumn("_kept", kept).withColumn("_extra", F.try_parse_json(F.coalesce(extra, F.lit("{}"))))
    read = read.withColumn("_extra", F.coalesce("_extra", F.parse_json(F.lit("{}"))))
    cells = {f: c & F.col("_kept") for f, c in landed(F.col("_extra")).items()}
    counted = read.select(F.col(by).alias("_by"), "_kept", *(c.alias(f"_{f}") for f, c in cells.items()))
    sums = counted.groupBy("_by").agg(F.count_if("_kept").alias("records"), F.count_if(~F.col("_kept")).alias("rejected"), *(F.count_if(f"_{f}").alias(f"_{f}") for f in FIELDS))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("landed")) for f in FIELDS)))
    share = F.when(F.col("records") > 0, F.round(F.col("c.landed") / F.col("records"), 6))
    return sums.select("*", each.alias("c")).select(F.col("_by").alias(by), "c.field", "records", "rejected", "c.landed", share.alias("share"))


def keys(drafts: DataFrame, by: str, extra: str) -> DataFrame:
    """``by, key, records``: how many drafts of a source fill each key of ``extra``; blanks, sentinels and empty lists don't."""
    pairs = F.explode(F.coalesce(F.from_json(extra, "map<string,string>"), F.create_map().cast("map<string,string>")))
    long = drafts.select(F.col(by).alias("_by"), pairs.alias("key", "value"))
    says = ~F.col("key").isin(*NO_KEYS) & live(F.col("value")) & ~F.col("value").rlike(r"^\[\s*\]$")
    return long.where(says).groupBy("_by", "key").agg(F.count("*").alias("records")).withColumnRenamed("_by", by)
