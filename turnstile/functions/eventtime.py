"""Event time of a line, as seconds since 1970 in UTC; null where the line has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, and the shapes of the four formats.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SYSLOG = r"([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})"
ISO = r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[T ]([01]\d|2[0-3]):([0-5]\d):([0-5]\d)"
EPOCH = r"(\d{10,})"
COMMON = r"(\d{2})/([A-Z][a-z]{2})/(\d{4}):(\d{2}):(\d{2}):(\d{2})"


def _once(line: Column, shape: str, read: Callable[[Column], Column]) -> Column:
    """read of the first text of a shape (empty if there is none), which is looked for once."""
    return F.get(F.transform(F.array(F.regexp_extract(line, shape, 0)), read), F.lit(0))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")


def _clock(parts: list[Column]) -> Column:
    h, m, s = (p.try_cast("int") for p in parts)
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970; null for a day that the month has not."""
    day_one = F.when(month > 0, F.make_date(year, month, F.lit(1)))
    return F.when((day >= 1) & (day <= F.day(F.last_day(day_one))), F.unix_date(day_one) + day - 1).cast("long")


def syslog(line: Column, year: Column) -> Column:
    """``Mon d hh:mm:ss`` of a given year."""

    def read(m: Column) -> Column:
        parts = [F.get(F.split(m, r"[\s:]+"), F.lit(i)) for i in range(5)]
        return _date(year, _month(parts[0]), parts[1].try_cast("int")) * 86400 + _clock(parts[2:])

    return _once(line, SYSLOG, read)


def iso(line: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss``; a day up to 31 runs over into the next month; offsets and fractions are left out."""

    def read(t: Column) -> Column:
        year, month, day, h, m, s = (F.substring(t, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
        first = F.when(month.isNotNull(), F.unix_date(F.make_date(year, month, F.lit(1))))
        return (first + day - 1).cast("long") * 86400 + h * 3600 + m * 60 + s

    return _once(line, ISO, read)


def epoch(line: Column) -> Column:
    """The first run of ten or more digits, whole."""
    return F.regexp_extract(line, EPOCH, 1).try_cast("long")


def common(line: Column) -> Column:
    """``dd/Mon/yyyy:hh:mm:ss``; the offset is left out."""

    def read(m: Column) -> Column:
        part = lambda a, n: F.substring(m, a, n)
        return _date(part(8, 4).try_cast("int"), _month(part(4, 3)), part(1, 2).try_cast("int")) * 86400 + _clock([part(13, 2), part(16, 2), part(19, 2)])

    return _once(line, COMMON, read)


def event_time(line: Column, form: Column, year: Column) -> Column:
    return F.when(form == "syslog", syslog(line, year)).when(form == "iso8601", iso(line)).when(form == "epoch", epoch(line)).when(form == "common", common(line))
