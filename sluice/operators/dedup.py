"""Duplicate records by normalised keys: groups, survivors, key collisions and plans by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
#: Bytes above which a key is kept as its digest.
KEY_BYTES = 2000


def normal(text: Column) -> Column:
    """Separator removed, trimmed, lower-cased, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(F.translate(text, SEPARATOR, ""))), r"\s+", " ")


def bounded(key: Column, most: int = KEY_BYTES) -> Column:
    return F.when(F.octet_length(key) <= most, key).otherwise(F.concat(F.lit("sha256:"), F.sha2(key, 256)))


def whole_key(*parts: Column) -> Column:
    """The normalised parts, absent ones as ``UNKNOWN``, joined by the unit separator, however long."""
    return F.concat_ws(SEPARATOR, *(F.coalesce(normal(p), F.lit("UNKNOWN")) for p in parts))


def dedup_key(*parts: Column) -> Column:
    """The key of the parts, or its digest if it is long."""
    return bounded(whole_key(*parts))


def normal_url(url: Column) -> Column:
    """Without fragment and query, lower-cased, trimmed, trailing slashes dropped."""
    plain = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return F.regexp_replace(F.lower(F.trim(plain)), "/+$", "")


def tiers(key: Column) -> dict[str, Column]:
    """Ever looser forms of a key: trimmed, lower-cased, letters and digits only."""
    trimmed = F.trim(key)
    return {"T1": trimmed, "T2": F.lower(trimmed), "T3": F.regexp_replace(F.lower(trimmed), "[^a-z0-9]+", "-")}


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """``tier, groups, variants``: by tier how many forms stand for several keys, and for how many."""
    forms = F.array(*(F.struct(F.lit(t).alias("tier"), c.alias("form")) for t, c in tiers(F.col(key)).items()))
    per = rows.select(key, F.explode(forms).alias("f")).groupBy("f.tier", "f.form").agg(F.countDistinct(key).alias("variants")).where("variants > 1")
    return per.groupBy("tier").agg(F.count("*").alias("groups"), F.sum("variants").alias("variants"))


def survivors(rows: DataFrame, group: list[str], order: list[Column], key: str) -> DataFrame:
    """Every row of a group of several with its ``rank`` and the key of the ``survivor``, the first in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = rows.withColumns({"rank": F.row_number().over(w), "survivor": F.first(key).over(w), "group_size": F.count("*").over(Window.partitionBy(*group))})
    return marked.where("group_size > 1")


def group_kinds(rows: DataFrame, group: str, legacy: str) -> DataFrame:
    """``kind, groups, rows``: how many groups of two or more rows are legacy only, live only or mixed."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.bool_and(legacy).alias("old"), F.bool_or(legacy).alias("some")).where("n > 1")
    kind = F.when(F.col("old"), "only legacy").when(~F.col("some"), "only live").otherwise("mixed")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def guarded_pairs(rows: DataFrame, source: str, group: str, key: str, left_out: list, share: float) -> DataFrame:
    """``source, group, survivor`` of groups that may be merged without a look: two rows of two keys, a source that isn't
    ``left_out``, and no more than ``share`` of the source's rows."""
    live = rows.groupBy(source).agg(F.count("*").alias("_live"))
    pairs = rows.where(~F.col(source).isin(left_out)).groupBy(source, group).agg(F.count("*").alias("_n"), F.countDistinct(key).alias("_keys"), F.min(key).alias("survivor"))
    return pairs.where("_n = 2 AND _keys = 2").join(live, source).where(F.lit(2.0) / F.col("_live") <= share).select(source, group, "survivor")
