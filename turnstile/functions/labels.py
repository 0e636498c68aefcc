"""Scalar columns: durations, ban lengths, labels, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of each duration suffix.
UNITS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
LONG_MAX = (1 << 63) - 1


def duration(text: Column) -> Column:
    """Seconds of ``90``, ``10m``, ``1h``, ``2d``, ``1w``; null if the text is none or too large."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, r"^([+-]?[0-9]+)\s*[smhdw]?$", 1).try_cast("long")
    unit = F.regexp_extract(trimmed, r"^[+-]?[0-9]+\s*([smhdw]?)$", 1)
    factor = F.lit(None).cast("long")
    for name, seconds in UNITS.items():
        factor = F.when(unit == name, F.lit(seconds).cast("long")).otherwise(factor)
    return F.try_multiply(number, factor)


def ban_length(base: Column, count: Column, increment: Column, multipliers: Column, factor: Column, maxtime: Column) -> Column:
    """The length of an address's next ban, after count earlier ones; a negative base is for ever."""
    n = F.size(multipliers)
    times = F.when(n > 0, F.element_at(multipliers, F.least(count + 1, n).cast("int")).cast("double")).otherwise(F.pow(F.lit(2.0), F.least(count, F.lit(20)).cast("double")))
    # A product beyond the range of a long stays at its end.
    grown = F.least(base * times * factor, F.lit(9.2233720368547e18)).cast("long")
    grown = F.when(maxtime > 0, F.least(grown, maxtime)).otherwise(grown)
    return F.when(~increment | (base < 0), base).otherwise(grown)


def asn_label(asn: Column, org: Column) -> Column:
    return F.when(asn.isNotNull() & org.isNotNull(), F.concat(F.lit("AS"), asn.cast("string"), F.lit(" ("), org, F.lit(")"))).when(asn.isNotNull(), F.concat(F.lit("AS"), asn.cast("string"))).otherwise(org)


def remaining(expires_at: Column, now: Column) -> Column:
    left = expires_at - now
    hours, minutes = F.floor(left / 3600).cast("string"), F.floor(F.pmod(left, F.lit(3600)) / 60).cast("string")
    return F.when(expires_at.isNull(), "permanent").when(left <= 0, "expired").when(left >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m remaining"))).otherwise(F.concat(minutes, F.lit("m remaining")))


def logfmt_value(value: Column) -> Column:
    """A value of a ``key=value`` line: quoted where it is empty or has a space, quote, line end or equals sign."""
    slashed = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when((value == "") | value.rlike('[ "\n=]'), F.concat(F.lit('"'), slashed, F.lit('"'))).otherwise(value)
