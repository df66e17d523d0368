"""Local-time predicates and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SATURDAY, SUNDAY, FRIDAY = 5, 6, 4


def local(moment: Column, zone: str | Column) -> Column:
    """Wall-clock time in ``zone`` of a timestamp kept in UTC."""
    return F.from_utc_timestamp(moment, zone)


def is_evening(moment: Column, zone: str = "Europe/Stockholm", from_hour: int = 18) -> Column:
    return F.hour(local(moment, zone)) >= from_hour


def is_weekend(moment: Column, zone: str = "Europe/Stockholm",
               friday_from: int | None = 18) -> Column:
    """Saturday, Sunday and, unless ``friday_from`` is None, Friday evening."""
    clock = local(moment, zone)
    weekend = F.weekday(clock).isin(SATURDAY, SUNDAY)
    if friday_from is None:
        return weekend
    return weekend | ((F.weekday(clock) == FRIDAY) & (F.hour(clock) >= friday_from))


def is_saturday_night(moment: Column, zone: str = "Europe/Stockholm",
                      from_hour: int = 18) -> Column:
    clock = local(moment, zone)
    return (F.weekday(clock) == SATURDAY) & (F.hour(clock) >= from_hour)


def week_of_month(day: Column) -> Column:
    """Calendar row of a date, weeks start on Monday, 1 to 6."""
    first_weekday = F.weekday(F.trunc(day, "month"))
    return F.floor((F.dayofmonth(day) + first_weekday - 1) / 7) + 1


def shift_hour(hour: Column, country: Column, offsets: dict[str, int]) -> Column:
    """Hour moved by the offset of its country, modulo 24."""
    offset = F.lit(None).cast("int")
    for name, hours in offsets.items():
        offset = F.when(country == name, F.lit(hours)).otherwise(offset)
    return F.pmod(hour + F.coalesce(offset, F.lit(0)), F.lit(24))


def time_steps(start: Column, end: Column, minutes: int) -> Column:
    """Array of the instants from ``start`` (included) to ``end`` (excluded)."""
    step = F.expr(f"interval {int(minutes)} minutes")
    steps = F.filter(F.sequence(start, end, step), lambda moment: moment < end)
    return F.when(start < end, steps).otherwise(F.array().cast("array<timestamp>"))


def covered_days(start: Column, end: Column, zone: str | Column = "UTC",
                 between: tuple[str, str] | None = None) -> Column:
    """Array of the local dates an update overlaps, of those ``between`` two days (both included).

    An update that ends at midnight sharp does not touch the new day; one
    without duration belongs to the day it starts in. With ``between`` a far
    end time makes no more dates than lie there.
    """
    first = F.to_date(local(start, zone))
    before_end = F.timestamp_micros(F.unix_micros(end) - 1)
    last = F.greatest(first, F.to_date(local(before_end, zone)))
    if between is not None:
        first = F.greatest(first, F.to_date(F.lit(between[0])))
        last = F.least(last, F.to_date(F.lit(between[1])))
    return F.when((end >= start) & (first <= last), F.sequence(first, last)).otherwise(
        F.array().cast("array<date>"))


def age(birthdate: Column, as_of: Column) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(as_of, birthdate) / 365)
