"""Dates and times of result files as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_date(x: Column) -> Column:
    """dd/mm/yy, dd/mm/yyyy, ISO, or a date with a time; null for anything else.

    The year's digits decide the format, so that two digits never become the year 23.
    """
    t = F.trim(x)
    two = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_timestamp(F.regexp_replace(t, r"/(\d{2})$", "/20$1"), F.lit("d/M/yyyy")))
    four = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}( .*)?$"), F.try_to_timestamp(F.substring_index(t, " ", 1), F.lit("d/M/yyyy")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(two, four, iso).cast("date")


def clock(x: Column, default: str = "20:00") -> Column:
    """HH:MM of a time such as 9:05 or 21:00:00; the default where there is none."""
    hour, minute = F.regexp_extract(x, r"^\s*(\d{1,2}):(\d{2})", 1), F.regexp_extract(x, r"^\s*(\d{1,2}):(\d{2})", 2)
    ok = x.isNotNull() & (hour != "") & (hour.try_cast("int") < 24) & (minute.try_cast("int") < 60)
    return F.when(ok, F.concat_ws(":", F.lpad(hour, 2, "0"), minute)).otherwise(default)


def kickoff(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.date_format(any_date(date), "yyyy-MM-dd"), clock(time)), F.lit("yyyy-MM-dd HH:mm"))


ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:\d{2})$"


def zoned(x: Column) -> Column:
    """An ISO time that names its zone, in UTC; fails at run time for one that does not."""
    return F.when(x.rlike(ZONED), F.to_timestamp(x)).when(x.isNotNull(), F.raise_error(F.concat(F.lit("a time needs a zone: "), x)).cast("timestamp"))


def epoch_or_iso(x: Column, otherwise: Column) -> Column:
    """Seconds since 1970 or ISO text as a time."""
    return F.coalesce(F.timestamp_seconds(x.try_cast("long")), x.try_cast("timestamp"), otherwise)


def age_days(reference: Column, at: Column) -> Column:
    return (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(8.64e10)


def decay(xi: float, days: Column) -> Column:
    """exp(-xi * days); 1 without decay."""
    return F.exp(F.lit(-xi) * days) if xi > 0 else F.lit(1.0)
