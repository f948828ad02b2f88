"""Times: offsets are told, days are those of a fixed offset, differences are exact to the microsecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Hours that the ledger's calendar is ahead of UTC.
LEDGER_HOURS = 9


def aware(text: Column) -> Column:
    """A timestamp from ISO text that tells its offset; null for text that doesn't."""
    told = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})\z")
    return F.when(told, text.try_cast("timestamp"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (then UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch(ts: Column) -> Column:
    return micros(ts) / F.lit(1_000_000.0)


def days_between(later: Column, earlier: Column) -> Column:
    """Days with their fraction."""
    return (micros(later) - micros(earlier)) / F.lit(float(DAY_US))


def whole_days_between(later: Column, earlier: Column) -> Column:
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY_US))


def local_day(ts: Column, hours: int = LEDGER_HOURS) -> Column:
    """The calendar date ``hours`` ahead of UTC."""
    return F.date_from_unix_date(F.floor((micros(ts) + F.lit(hours * 3_600_000_000)) / F.lit(DAY_US)).cast("int"))


def local_hour(ts: Column, hours: int = LEDGER_HOURS) -> Column:
    return F.floor(F.pmod(micros(ts) + F.lit(hours * 3_600_000_000), F.lit(DAY_US)) / F.lit(3_600_000_000)).cast("int")


def within_hours(ts: Column, opens: int, closes: int, hours: int = LEDGER_HOURS) -> Column:
    """Whether ``opens`` <= local hour < ``closes``."""
    h = local_hour(ts, hours)
    return (h >= opens) & (h < closes)


def next_opening(ts: Column, opens: int, hours: int = LEDGER_HOURS) -> Column:
    """Microseconds of the next time at which the local hour becomes ``opens``."""
    shift = (hours - opens) * 3_600_000_000
    return (F.floor((micros(ts) + F.lit(shift)) / F.lit(DAY_US)) + 1) * F.lit(DAY_US) - F.lit(shift)
