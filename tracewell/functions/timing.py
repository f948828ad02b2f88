"""Lap times: where laps end, whether they fit the distance and the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of the closing part that an early anchor leaves out.
CLOSING = 600
#: Seconds that the laps' sum may differ from the clock.
TOLERANCE = 0.3


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def early_anchor(distance: Column, finish: Column, closing: Column) -> Column:
    """(distance, seconds) before the closing part; null where the times can't be."""
    ok = finite(finish) & finite(closing) & (distance > CLOSING) & (closing > 0) & (closing < finish)
    return F.when(ok, F.struct((distance - CLOSING).alias("distance"), (finish - closing).alias("seconds")))


def lap_ends(distance: Column) -> Column:
    """Ends of laps of 200, the first of 100 for odd hundreds; null where the distance isn't whole hundreds."""
    ok = F.coalesce((distance > 0) & (distance % 100 == 0), F.lit(False))
    first = F.when(distance % 200 == 0, 200).otherwise(100)
    return F.when(ok, F.sequence(first.cast("int"), F.when(ok, distance).otherwise(first).cast("int"), F.lit(200)))


def increasing(xs: Column) -> Column:
    """Whether each element is above the one before; null elements are not."""
    return F.forall(F.arrays_zip(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))).alias("a"), F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))).alias("b")), lambda p: F.coalesce(p["a"] < p["b"], F.lit(False)))


def laps_ok(ends: Column, laps: Column, distance: Column) -> Column:
    """Whether ends rise from above 0 to the distance and each has a time above 0."""
    ok = (F.size(ends) > 0) & (F.size(ends) == F.size(laps)) & (F.try_element_at(ends, F.lit(-1)) == distance) & (F.get(ends, F.lit(0)) > 0)
    ok = ok & increasing(ends) & F.forall(laps, lambda x: finite(x) & F.coalesce(x > 0, F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def clock_gap(laps: Column, clock: Column) -> Column:
    """Sum of laps less the clock."""
    return F.aggregate(laps, F.lit(0.0), lambda a, x: a + x) - clock


def clock_ok(laps: Column, clock: Column, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce(F.abs(clock_gap(laps, clock)) <= tolerance, F.lit(False))
