"""Timestamps to epoch milliseconds: ISO-8601, log4j, epoch numbers; zones and times of day."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EPOCH_MS_FROM, MAX_OFFSET_MS, MAX_ZONE_MS

STAMP = r"^\s*(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d{1,9}))?\s?(Z|[+-]\d{2}:?\d{2})?"
EPOCH = r"^\s*(\d{9,13}(?:\.\d+)?)(?![\d\-:/.])"
FORMATS = ("log4j", "iso", "epoch")


def zone_ms(text: str) -> int | None:
    """Hours (+8, -5.5) or ±hh:mm as milliseconds, east positive; None where it is no zone."""
    s = text.strip()
    sign = -1 if s[:1] == "-" else 1
    s = s[1:] if s[:1] in ("+", "-") else s
    if m := re.fullmatch(r"(\d+):(\d+)", s):
        h, mm = int(m[1]), int(m[2])
        return sign * (h * 60 + mm) * 60_000 if h <= 23 and mm <= 59 else None
    if not re.fullmatch(r"\d+\.?\d*|\.\d+", s) or float(s) > 23:
        return None
    return sign * int(float(s) * 3_600_000 + 0.5)


def clamp_offset(ms: int) -> int:
    return max(-MAX_OFFSET_MS, min(MAX_OFFSET_MS, ms))


def clamp_zone(ms: int) -> int:
    return max(-MAX_ZONE_MS, min(MAX_ZONE_MS, ms))


def civil_ms(text: Column, zone: int = 0) -> Column:
    """A date and time in front of a text; ``zone`` holds for stamps that name none. Null where there is none."""
    part = lambda i: F.regexp_extract(text, STAMP, i)
    at = F.try_to_timestamp(F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "), part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    fraction = F.rpad(F.substring(part(7), 1, 3), 3, "0").cast("long")
    named = part(8)
    digits = F.regexp_replace(named, "[:Z]", "")
    minutes = F.substring(digits, 2, 2).cast("long") * 60 + F.substring(digits, 4, 2).cast("long")
    shift = F.when(named == "", F.lit(zone)).when(named == "Z", F.lit(0)).otherwise(F.when(F.startswith(digits, F.lit("-")), -1).otherwise(1) * minutes * 60_000)
    return F.when(F.rlike(text, F.lit(STAMP)), F.unix_millis(at) + fraction - shift)


def epoch_ms(number: Column) -> Column:
    """Seconds or, from ``EPOCH_MS_FROM`` on, milliseconds as text."""
    x = F.when(F.rlike(number, F.lit(r"^\s*-?\d+(\.\d+)?\s*$")), F.trim(number)).try_cast("double")
    return F.when(F.abs(x) >= EPOCH_MS_FROM, F.floor(x)).otherwise(F.floor(x * 1000)).cast("long")


def prefix_ms(line: Column, form: str, zone: int = 0) -> Column:
    """The timestamp at the beginning of a log line of a format."""
    if form == "epoch":
        return epoch_ms(F.nullif(F.regexp_extract(line, EPOCH, 1), F.lit("")))
    comma = F.rlike(line, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[,.]\d{3}"))
    return F.when(comma, civil_ms(line, zone)) if form == "log4j" else civil_ms(line, zone)


def value_ms(text: Column, zone: int = 0) -> Column:
    """A field's timestamp: a date and time, else an epoch number."""
    return F.coalesce(civil_ms(text, zone), epoch_ms(text))


def time_of_day(ms: Column) -> Column:
    """HH:MM:SS.mmm in the zone of the milliseconds."""
    rest = F.pmod(ms, F.lit(86_400_000))
    part = lambda unit, mod, width: F.lpad((F.floor(rest / unit) % mod).cast("long").cast("string"), width, "0")
    return F.concat(part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))


def civil(ms: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss.SSS of epoch milliseconds in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
    return F.concat(day.cast("string"), F.lit(" "), time_of_day(ms))
