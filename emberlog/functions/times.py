"""Time expressions (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import fixed_values as fixed


def parse(c: Column) -> Column:
    """Text to timestamp; null for anything that is not one, blanks included."""
    return F.try_to_timestamp(c)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 in UTC; microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(micros != ".000000", micros).otherwise(""), F.lit("+00:00"))


def hour(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(0))


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(ts), F.lit(0))


def day_name(dow: Column) -> Column:
    names = F.array(*[F.lit(n) for n in fixed.DAY_NAMES])
    return F.when(dow.between(0, 6), F.element_at(names, (dow + 1).cast("int"))).otherwise("Unknown")
