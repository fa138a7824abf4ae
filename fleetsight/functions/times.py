"""Event clocks: RFC 3339 text to timestamps and to exact nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_rfc3339(text: Column) -> Column:
    """TIMESTAMP (microseconds) of an RFC 3339 text, NULL if it is not one."""
    well_formed = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(well_formed, F.translate(text, "tz", "TZ").try_cast("timestamp"))


def rfc3339_ns(text: Column) -> Column:
    """Nanoseconds since the epoch, keeping digits a TIMESTAMP would cut."""
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0")
    return F.unix_seconds(parse_rfc3339(text)) * F.lit(1_000_000_000) + F.coalesce(
        fraction.try_cast("bigint"), F.lit(0)
    )


def timestamp_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * F.lit(1000)


def ns_timestamp(ns: Column) -> Column:
    """TIMESTAMP of nanoseconds, rounded down; integer arithmetic, as a double has too few digits."""
    thousand = F.lit(1000).cast("bigint")
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, thousand), thousand))
