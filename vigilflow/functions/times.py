"""Time as microseconds since the epoch: parsing, buckets and calendar parts, free of time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import US

UNITS_US = {"second": US, "minute": 60 * US, "hour": 3600 * US, "day": 86400 * US}

_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(Z|[+-]\d{2}:\d{2})?$"


def parse_iso_us(text: Column, fallback: Column) -> Column:
    """ISO-8601 text with an optional offset; a missing offset means UTC, bad text the fallback."""
    zone = F.regexp_extract(text, _ISO, 3)
    local = F.concat(F.regexp_extract(text, _ISO, 1), F.lit(" "), F.regexp_extract(text, _ISO, 2))
    wall = F.try_to_timestamp(F.concat(local, F.when(zone.isin("", "Z"), F.lit("+00:00")).otherwise(zone)))
    return F.coalesce(F.when(text.rlike(_ISO), F.unix_micros(wall)), fallback.cast("long"))


def bucket_us(ts_us: Column, unit: str) -> Column:
    """Start of the bucket a time falls in; buckets are aligned to UTC."""
    if unit not in UNITS_US:
        raise ValueError(f"unit must be one of {sorted(UNITS_US)}")
    return ts_us - F.pmod(ts_us, F.lit(UNITS_US[unit]))


def date_of(ts_us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_us / UNITS_US["day"]).cast("int"))


def month(ts_us: Column) -> Column:
    """Calendar month as yyyy-MM."""
    return F.substring(date_of(ts_us).cast("string"), 1, 7)
