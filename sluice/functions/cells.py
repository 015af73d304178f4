"""Cells of a result as JSON: what a client reads without losing digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest whole number that every JSON reader keeps exactly.
EXACT = 2**53 - 1
MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _listed(parts: Column, left: str, right: str) -> Column:
    return F.concat(F.lit(left), F.array_join(parts, ","), F.lit(right))


def cell(value: Column, of: T.DataType) -> Column:
    """A value of a type as JSON text, never null.

    Longs and decimals without fraction beyond 2^53 - 1, and all other decimals, are strings, so that no digit is lost.  Moments are ISO-8601 in UTC
    with milliseconds, dates the midnight that begins them; a moment without zone is taken as UTC.  Bytes are arrays of
    numbers from 0 to 255.  Arrays, maps and structures are converted at every depth, a map's entries in order of their keys as
    text.  Null, NaN and infinities are ``null``.
    """
    if isinstance(of, T.StringType):
        out = _quoted(value)
    elif isinstance(of, T.LongType):
        out = F.when(value.between(-EXACT, EXACT), value.cast("string")).otherwise(F.concat(F.lit('"'), value.cast("string"), F.lit('"')))
    elif isinstance(of, T.DecimalType):
        whole = F.lit(of.scale == 0) & value.between(-EXACT, EXACT)
        out = F.when(whole, value.cast("string")).otherwise(F.concat(F.lit('"'), value.cast("string"), F.lit('"')))
    elif isinstance(of, (T.DoubleType, T.FloatType)):
        out = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value.cast("string"))
    elif isinstance(of, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        moment = F.to_utc_timestamp(value, F.current_timezone()) if isinstance(of, T.TimestampType) else value.cast("timestamp_ntz")
        out = F.concat(F.lit('"'), F.date_format(moment, MOMENT), F.lit('"'))
    elif isinstance(of, T.BinaryType):
        at = F.when(F.octet_length(value) > 0, F.sequence(F.lit(1), F.octet_length(value))).otherwise(F.array().cast("array<int>"))
        out = F.when(value.isNotNull(), _listed(F.transform(at, lambda i: F.conv(F.hex(F.substr(value, i, F.lit(1))), 16, 10)), "[", "]"))
    elif isinstance(of, T.ArrayType):
        out = _listed(F.transform(value, lambda x: cell(x, of.elementType)), "[", "]")
    elif isinstance(of, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), cell(e["value"], of.valueType).alias("v"))))
        out = _listed(F.transform(entries, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), e["v"])), "{", "}")
    elif isinstance(of, T.StructType):
        out = _listed(F.array(*(F.concat(_quoted(F.lit(f.name)), F.lit(":"), cell(value[f.name], f.dataType)) for f in of.fields)), "{", "}")
        out = F.when(value.isNotNull(), out)
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("null"))


def as_json(rows: DataFrame, into: str = "json") -> DataFrame:
    """Each row as one JSON object of its cells, in the order of the columns."""
    row = T.StructType(rows.schema.fields)
    return rows.select(cell(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), row).alias(into))
