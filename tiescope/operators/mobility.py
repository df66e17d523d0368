"""Movement of single users: speed, gaps between updates, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiescope.functions.geography import distance_m, speed_kmh
from tiescope.operators.ordering import numbered, with_previous

ORDER = ["start_time", "end_time", "id"]


def _hour_chunk() -> F.Column:
    return F.floor(F.unix_micros("start_time") / F.lit(3_600_000_000))


def mean_speed(df: DataFrame, *by: str) -> DataFrame:
    """Mean km/h between consecutive updates of a user, ascending.

    The time runs from the start of one update to the end of the next; steps
    without positive time are skipped, users without any step get 0. ``by``
    names further keys, e.g. the country.
    """
    keys = [*by, "useruuid"]
    steps = with_previous(df, keys, ORDER, _hour_chunk(), ["start_time", "longitude", "latitude"])
    seconds = (F.unix_micros("end_time") - F.unix_micros("previous_start_time")) / 1e6
    metres = distance_m(F.col("previous_longitude"), F.col("previous_latitude"),
                        F.col("longitude"), F.col("latitude"))
    speed = F.when(seconds > 0, speed_kmh(metres, seconds))
    return (steps.groupBy(*keys).agg(F.coalesce(F.avg(speed), F.lit(0.0)).alias("kmh"))
            .orderBy("kmh", *keys))


def update_gaps(df: DataFrame, ref_compat: bool = False) -> DataFrame:
    """Mean minutes from the start of an update to the end of the next, per user.

    The sum over consecutive rows telescopes to totals and the two outer rows,
    so no ordering of a user's rows is needed. ``ref_compat`` divides by the
    number of rows in place of the number of gaps.
    """
    begin, finish = F.unix_micros("start_time"), F.unix_micros("end_time")
    per_user = df.groupBy("useruuid").agg(
        F.count("*").alias("rows"),
        (F.sum(finish) - F.sum(begin)).alias("stays"),
        F.min(F.struct(begin.alias("begin"), finish.alias("finish"))).getField("finish").alias("first_end"),
        F.max(begin).alias("last_start"))
    gaps = F.col("rows") if ref_compat else F.col("rows") - 1
    total = (F.col("stays") - F.col("first_end") + F.col("last_start")) / 60e6
    return per_user.filter(F.col("rows") > 1).select("useruuid", (total / gaps).alias("minutes"))


def mean_gap(df: DataFrame, ref_compat: bool = False) -> DataFrame:
    return update_gaps(df, ref_compat).agg(F.avg("minutes").alias("minutes"))


def trajectories(df: DataFrame, part_rows: int = 1000) -> DataFrame:
    """Ordered points of every user, one row per ``part_rows`` updates.

    A part starts with the last point of the part before it (``joins``), so
    the lines of a user connect and no row grows without bound. ``shares`` is
    each stay as a part of the user's total stay, 1 for stays without length.
    """
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    timed = df.select("useruuid", *ORDER, F.array("longitude", "latitude").alias("point"),
                      seconds.alias("seconds"))
    totals = timed.groupBy("useruuid").agg(F.sum("seconds").alias("total"))
    share = F.when(F.col("seconds") > 0, F.col("seconds") / F.col("total")).otherwise(1.0)
    placed = numbered(timed, [F.col(name) for name in ORDER], [_hour_chunk()], by=["useruuid"])
    parts = (placed.withColumn("part", F.floor((F.col("number") - 1) / part_rows))
             .join(totals, "useruuid").withColumn("share", share)
             .groupBy("useruuid", "part")
             .agg(F.array_sort(F.collect_list(F.struct("number", "start_time", "point", "share"))).alias("stops")))
    linked = with_previous(
        parts.withColumn("leave", F.element_at("stops", -1).getField("point")),
        ["useruuid"], ["part"], F.floor(F.col("part") / 1000), ["leave"])
    return linked.select(
        "useruuid", "part", F.col("previous_leave").alias("joins"),
        F.transform("stops", lambda stop: stop["point"]).alias("points"),
        F.transform("stops", lambda stop: stop["start_time"]).alias("times"),
        F.transform("stops", lambda stop: stop["share"]).alias("shares"))
