"""Heat-map tables: calendar, user by day, user by time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiescope.functions.calendar import covered_days, local, week_of_month
from tiescope.operators.profiles import day_frame


def updates_per_day(df: DataFrame, zone: str | Column = "UTC",
                    between: tuple[str, str] | None = None) -> DataFrame:
    """Rows per user and local day; a row counts on every day it overlaps (of those ``between`` two days)."""
    days = covered_days(F.col("start_time"), F.col("end_time"), zone, between)
    return (df.select("useruuid", F.explode(days).alias("day"))
            .groupBy("useruuid", "day").agg(F.count("*").alias("rows")))


def calendar(df: DataFrame, first_day: str, last_day: str, zone: str = "UTC") -> DataFrame:
    """Mean updates per user as month x weekday x week of month, -1 where no day is."""
    per_day = updates_per_day(df, zone, (first_day, last_day))
    users = df.select("useruuid").distinct().agg(F.count("*")).scalar()
    totals = per_day.groupBy("day").agg(F.sum("rows").alias("rows"))
    placed = (day_frame(df, first_day, last_day).join(totals, "day", "left")
              .select(F.date_format("day", "yyyy-MM").alias("month"), F.weekday("day").alias("weekday"),
                      week_of_month(F.col("day")).alias("week"),
                      (F.coalesce("rows", F.lit(0)) / users).alias("mean")))
    wide = placed.groupBy("month", "weekday").pivot("week", [1, 2, 3, 4, 5, 6]).agg(F.first("mean"))
    return wide.select("month", "weekday",
                       *[F.coalesce(F.col(str(week)), F.lit(-1.0)).alias(f"week{week}") for week in range(1, 7)])


def user_days(df: DataFrame, first_day: str, last_day: str, counts: bool = False,
              zone: str = "UTC") -> DataFrame:
    """Long user x day matrix with 0 for days without an update."""
    days = F.sequence(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))
    frame = df.select("useruuid").distinct().select("useruuid", F.explode(days).alias("day"))
    value = F.coalesce("rows", F.lit(0))
    if not counts:
        value = (value > 0).cast("bigint")
    return (frame.join(updates_per_day(df, zone, (first_day, last_day)), ["useruuid", "day"], "left")
            .select("useruuid", "day", value.alias("value")))


def wide_user_days(long: DataFrame, days: list[str]) -> DataFrame:
    """One row per user, a column per day."""
    text = long.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return text.groupBy("useruuid").pivot("day", days).agg(F.first("value"))


def user_clock(df: DataFrame, first_day: str, last_day: str, minutes: int = 60,
               counts: bool = False, zone: str = "UTC") -> DataFrame:
    """User x time of day, summed over the days of a period.

    A row counts in every slot it overlaps; without ``counts`` each day adds 1
    to a slot at most.
    """
    width = minutes * 60_000_000
    begin = F.unix_micros(local(F.col("start_time"), zone))
    finish = F.unix_micros(local(F.col("end_time"), zone))
    first = F.floor(begin / F.lit(width))
    last = F.greatest(first, F.floor((finish - 1) / F.lit(width)))
    per_day = 24 * 60 // minutes
    # only slots of the period are made, whatever the end time says
    first = F.greatest(first, F.unix_date(F.to_date(F.lit(first_day))).cast("bigint") * per_day)
    last = F.least(last, F.unix_date(F.to_date(F.lit(last_day))).cast("bigint") * per_day + per_day - 1)
    slots = F.when((finish >= begin) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    spread = (df.select("useruuid", F.explode(slots).alias("slot"))
              .groupBy("useruuid", "slot").agg(F.count("*").alias("rows")))
    value = F.sum("rows") if counts else F.count("*")
    return spread.groupBy("useruuid", F.pmod("slot", F.lit(per_day)).alias("slot")).agg(value.alias("value"))


def activity(df: DataFrame, first_day: str, last_day: str, zone: str = "UTC") -> DataFrame:
    """Per user: updates on the days of a range (``total``) and days without one (``empty_days``).

    Days without an update are those left over, so none of them is made.
    """
    days = covered_days(F.col("start_time"), F.col("end_time"), zone, (first_day, last_day))
    seen = (df.select("useruuid", F.explode_outer(days).alias("day"))
            .groupBy("useruuid", "day").agg(F.count("*").alias("rows")))
    length = F.datediff(F.to_date(F.lit(last_day)), F.to_date(F.lit(first_day))) + 1
    return seen.groupBy("useruuid").agg(
        F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("rows"))), F.lit(0)).alias("total"),
        (length - F.count("day")).alias("empty_days"))


def by_activity(active: DataFrame, order: str = "sum") -> DataFrame:
    """Users by their updates, or by the number of empty days (descending)."""
    first = F.asc("total") if order == "sum" else F.desc("empty_days")
    return active.orderBy(first, F.asc("useruuid"))
