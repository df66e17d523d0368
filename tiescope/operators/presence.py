"""Presence: distinct (user, cell, time bin), and statistics of cells and users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiescope.config import BinConfig, Period
from tiescope.functions.binning import bin_start, spatial_bin, time_bins
from tiescope.session import bucketed

CELL = ["spatial_bin", "time_bin"]


def presence(locations: DataFrame, cfg: BinConfig, period: Period | None = None,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (user, spatial_bin, time_bin) rows of the location updates.

    With a period, updates that do not touch it are filtered before their
    bins are exploded, a comparison on the stored timestamps that reaches the
    scan. ``keep`` names further columns that become part of the key.
    """
    if period is not None:
        begin, end = (bin_start(F.lit(edge), cfg) for edge in (period.start, period.end))
        locations = locations.filter(
            (F.col("start_time") < end)
            & ((F.col("end_time") >= begin) | F.col("end_time").isNull()))
    bins = time_bins(F.col("start_time"), F.col("end_time"), cfg, period)
    cell = spatial_bin(F.col("longitude"), F.col("latitude"), cfg.decimals, cfg.stride)
    return (locations
            .select("useruuid", cell.alias("spatial_bin"), F.explode(bins).alias("time_bin"), *keep)
            .dropDuplicates())


def stored(locations: DataFrame, cfg: BinConfig, period: Period | None = None) -> DataFrame:
    """Presence, written once in buckets by cell and bin.

    Populations and pairs of the stored table need no exchange of its rows.
    """
    return bucketed(presence(locations, cfg, period), CELL, "presence")


def with_arrivals(people: DataFrame) -> DataFrame:
    """Flags for users who were not in the cell one bin before, or one bin after.

    The window is per user and cell, so it holds one row per time bin at most.
    """
    stay = Window.partitionBy("useruuid", "spatial_bin").orderBy("time_bin")
    before, after = F.lag("time_bin").over(stay), F.lead("time_bin").over(stay)
    return people.withColumns({
        "arrived": ~F.coalesce(before == F.col("time_bin") - 1, F.lit(False)),
        "leaves": ~F.coalesce(after == F.col("time_bin") + 1, F.lit(False)),
    })


def cell_population(people: DataFrame) -> DataFrame:
    """Distinct users per cell and bin."""
    return people.groupBy(*CELL).agg(F.count("*").alias("people"))


def location_entropy(people: DataFrame) -> DataFrame:
    """Shannon entropy (bits) of the users' shares of a spatial bin.

    Uses H = log2(n) - sum(c log2 c) / n, which needs no join for the shares.
    """
    per_user = people.groupBy("spatial_bin", "useruuid").agg(F.count("*").alias("visits"))
    return (per_user.groupBy("spatial_bin")
            .agg(F.sum("visits").alias("total"),
                 F.sum(F.col("visits") * F.log2("visits")).alias("weighted"))
            .select("spatial_bin",
                    (F.log2("total") - F.col("weighted") / F.col("total")).alias("entropy")))


def user_activity(people: DataFrame) -> DataFrame:
    """Presence rows and distinct time bins per user."""
    return (people.groupBy("useruuid", "time_bin").agg(F.count("*").alias("cells"))
            .groupBy("useruuid")
            .agg(F.sum("cells").alias("presences"), F.count("*").alias("bins")))


def period_of(time_bin: F.Column, periods: list[Period]) -> F.Column:
    """1-based number of the period a bin lies in, null outside all of them."""
    number = F.lit(None).cast("int")
    for index, period in enumerate(periods, start=1):
        number = F.when((time_bin >= period.start) & (time_bin < period.end), index).otherwise(number)
    return number


def activity_by_period(people: DataFrame, periods: list[Period]) -> DataFrame:
    """Presence rows and distinct time bins per user and period."""
    numbered = people.withColumn("period", period_of(F.col("time_bin"), periods))
    return (numbered.filter(F.col("period").isNotNull())
            .groupBy("period", "useruuid", "time_bin").agg(F.count("*").alias("cells"))
            .groupBy("period", "useruuid")
            .agg(F.sum("cells").alias("presences"), F.count("*").alias("bins")))
