"""Times, clocks and time codes as Column expressions; everything is UTC unless a zone is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def date_cell(ts: Column | str) -> Column:
    """A date cell's text: rounded to the second, the date alone at midnight."""
    t = F.date_trunc("second", _c(ts).cast("timestamp") + F.expr("INTERVAL 500 MILLISECONDS"))
    text = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return F.when(text.endswith(" 00:00:00"), F.substring(text, 1, 10)).otherwise(text)


def parse_timestamp(value: Column | str) -> Column:
    """Seconds below 1e11, else milliseconds; numbers as text too; else a date text; what is not a time after 1970 is null."""
    t = F.trim(_c(value).cast("string"))
    n = t.try_cast("double")
    micros = F.when(n < 1e11, n * 1e6).otherwise(n * 1e3)
    by_number = F.when((n > 0) & (micros < 2.5e17), F.timestamp_micros(F.round(micros).cast("long")))
    return F.when(n.isNotNull(), by_number).otherwise(t.try_cast("timestamp"))


def format_time(ts: Column | str, zone: str = "UTC") -> Column:
    t = _c(ts).cast("timestamp")
    return F.date_format(t if zone == "UTC" else F.from_utc_timestamp(t, zone), "yyyy-MM-dd HH:mm")


TIMECODE = r"^(?:(\d{1,4}):)?(?:(\d{1,3}):)?(\d{1,3})(?:[.,](\d{1,4}))?$"


def parse_timecode(value: Column | str) -> Column:
    """Milliseconds of [h:]m:s[.,]fraction or of seconds; null for anything else."""
    t = F.trim(_c(value))
    g = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, TIMECODE, i), F.lit("")).cast("long"), F.lit(0))
    three = F.regexp_extract(t, TIMECODE, 2) != ""
    seconds = F.when(three, (g(1) * 60 + g(2)) * 60 + g(3)).otherwise(g(1) * 60 + g(3))
    ms = F.rpad(F.substring(F.regexp_extract(t, TIMECODE, 4), 1, 3), 3, "0").cast("long")
    return F.when(t.rlike(TIMECODE), seconds * 1000 + ms)


def clock(ms: Column | str, separator: str = ",") -> Column:
    """HH:MM:SS,mmm; what is below zero is zero."""
    t = F.greatest(F.lit(0), _c(ms).cast("long"))
    part = lambda unit, size: F.lpad((F.floor(t / unit) % size).cast("long").cast("string"), 2, "0")
    hours = F.floor(t / 3600000).cast("long").cast("string")
    hours = F.lpad(hours, F.greatest(F.lit(2), F.length(hours)), "0")
    return F.concat(hours, F.lit(":"), part(60000, 60), F.lit(":"), part(1000, 60), F.lit(separator), F.lpad((t % 1000).cast("string"), 3, "0"))


def ass_clock(ms: Column | str) -> Column:
    """H:MM:SS.cc"""
    t = F.greatest(F.lit(0), _c(ms).cast("long"))
    part = lambda unit, size: F.lpad((F.floor(t / unit) % size).cast("long").cast("string"), 2, "0")
    return F.concat(F.floor(t / 3600000).cast("long").cast("string"), F.lit(":"), part(60000, 60), F.lit(":"), part(1000, 60), F.lit("."), part(10, 100))


def read_seconds(value: Column | str) -> Column:
    """Seconds as double of a number or a clock; null if negative or neither."""
    t = F.trim(_c(value).cast("string"))
    n = t.try_cast("double")
    return F.when(n >= 0, n).when(n.isNull(), parse_timecode(t) / 1000.0)
