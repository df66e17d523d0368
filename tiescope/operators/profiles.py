"""Counts, distributions and summaries behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiescope.config import BinConfig
from tiescope.functions.binning import bin_start, slots_of_day, spatial_bin
from tiescope.functions.calendar import local
from tiescope.functions.geography import hexagon
from tiescope.operators.cleaning import country_is_missing, outside
from tiescope.operators.ordering import quantiles, running_total, with_bucket
from tiescope.operators.pairing import pair_count
from tiescope.operators.presence import CELL, presence
from tiescope.session import stage

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def histogram(df: DataFrame, column: str, bins: int = 20, max_value: int | None = None) -> DataFrame:
    """Counts per equal step from 0, the last bucket open; empty buckets kept.

    Values below 0 are in no bucket, values from the last edge on are in the
    last one.
    """
    if max_value is None:
        top = F.coalesce(df.agg(F.max(column).cast("bigint")).scalar(), F.lit(0))
    else:
        top = F.lit(max_value)
    step = F.greatest(F.floor(top / F.lit(bins)), F.lit(1)).cast("bigint")
    counted = (df.filter(F.col(column) >= 0)
               .groupBy(F.least(F.floor(F.col(column) / step), F.lit(bins - 1)).cast("bigint").alias("bucket"))
               .agg(F.count("*").alias("rows")))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bucket"))
    low = F.col("bucket") * step
    label = F.when(F.col("bucket") == bins - 1, F.concat(low.cast("string"), F.lit("<"))).otherwise(
        F.concat_ws("-", low.cast("string"), (low + step).cast("string")))
    return (frame.join(counted, "bucket", "left")
            .select("bucket", label.alias("label"), F.coalesce("rows", F.lit(0)).alias("rows")))


def bin_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Edges from min to max (excluded) in steps of ceil((max - min) / bins)."""
    bounds = df.agg(F.min(column).cast("bigint").alias("low"), F.max(column).cast("bigint").alias("high"))
    step = F.ceil((F.col("high") - F.col("low")) / F.lit(bins)).cast("bigint")
    return (bounds.withColumn("step", step).filter(F.col("step") > 0)
            .select(F.explode(F.sequence("low", F.col("high") - 1, "step")).alias("edge"), "step"))


def categories(df: DataFrame, column: str) -> DataFrame:
    return (df.groupBy(column).agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), F.asc(column)))


def mean_duration(df: DataFrame, *by: str, decimals: int = 2) -> DataFrame:
    """Mean stay in seconds per country or user, ascending; blank countries left out."""
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    if "country" in by:
        df = df.filter(~country_is_missing())
    return (df.groupBy(*by).agg(F.round(F.avg(seconds), decimals).alias("seconds"), F.count("*").alias("rows"))
            .orderBy("seconds", *by))


def rows_per_user(df: DataFrame) -> DataFrame:
    return df.groupBy("country", "useruuid").agg(F.count("*").alias("rows"))


def summary(df: DataFrame, value: str, by: Sequence[str] = (),
            probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """Exact quantiles, mean and sample standard deviation."""
    spread = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    cuts = quantiles(df, value, probabilities, by)
    if by:
        return cuts.join(spread, list(by))
    return cuts.withColumns({"mean": spread.select("mean").scalar(), "std": spread.select("std").scalar()})


def boxplot(df: DataFrame, value: str, by: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last values within k IQR) and number of outliers."""
    counted = df.groupBy(by, value).agg(F.count("*").alias("_rows"))
    fenced = counted.join(_fences(df, value, by, k), by)
    inside = F.col(value).between(F.col("low"), F.col("high"))
    return fenced.groupBy(by).agg(
        F.first("q25").alias("q25"), F.first("q50").alias("q50"), F.first("q75").alias("q75"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_rows"))).alias("outliers"))


def outliers(df: DataFrame, value: str, by: str, k: float = 1.5) -> DataFrame:
    """Rows outside the whiskers."""
    return (df.join(_fences(df, value, by, k), by)
            .filter(~F.col(value).between(F.col("low"), F.col("high")))
            .select(*df.columns))


def _fences(df: DataFrame, value: str, by: str, k: float) -> DataFrame:
    reach = (F.col("q75") - F.col("q25")) * k
    return quantiles(df, value, (0.25, 0.5, 0.75), [by]).drop("rows").withColumns(
        {"low": F.col("q25") - reach, "high": F.col("q75") + reach})


def updates_cdf(df: DataFrame) -> DataFrame:
    """Share of a country's users with at most so many updates."""
    counted = (rows_per_user(df).groupBy("country", "rows").agg(F.count("*").alias("users")))
    placed = running_total(counted, [F.col("rows")], [F.floor(F.log2("rows"))], {"users": "upto"}, ["country"])
    return placed.select("country", "rows", "users", (F.col("upto") / F.col("upto_all")).alias("cdf"))


def shares(counts: DataFrame, label: str, count: str = "rows") -> DataFrame:
    """Normalised counts in descending order and their running sum."""
    order = [F.desc(count), F.asc(label)]
    placed = running_total(with_bucket(counts, label), order, [-F.col(count), F.col("_part")],
                           {count: "upto"})
    return placed.select(label, count, (F.col(count) / F.col("upto_all")).alias("share"),
                         (F.col("upto") / F.col("upto_all")).alias("cdf"))


def coverage(counts: DataFrame, label: str, part: float, count: str = "rows") -> DataFrame:
    """Smallest prefix of the most frequent labels that reaches ``part``."""
    return shares(counts, label, count).filter(F.col("cdf") - F.col("share") < part)


def value_counts(df: DataFrame, value: Column, source: Column) -> DataFrame:
    """Counts of the non-blank values per source, with the share of its top value."""
    counted = (df.select(source.alias("source"), value.alias("value"))
               .filter(F.col("value").isNotNull() & (F.col("value").cast("string") != ""))
               .groupBy("source", "value").agg(F.count("*").alias("rows")))
    totals = counted.groupBy("source").agg((F.max("rows") / F.sum("rows")).alias("top_share"))
    return counted.join(totals, "source")


def sorted_counts(counts: DataFrame, order: str) -> DataFrame:
    """Value counts with their ``place`` in the source by ``value``, by ascending (``asc``) or descending count.

    The window holds the distinct values of one source.
    """
    keys = {"value": [F.asc("value")], "asc": [F.asc("rows"), F.asc("value")],
            "desc": [F.desc("rows"), F.desc("value")]}[order]
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(*keys)))


def mean_updates_per_month(df: DataFrame) -> DataFrame:
    """Updates per user of the country (all its users) in each month."""
    per_user = (df.groupBy("country", F.date_format("start_time", "yyyy-MM").alias("month"), "useruuid")
                .agg(F.count("*").alias("rows")))
    users = per_user.select("country", "useruuid").distinct().groupBy("country").agg(
        F.count("*").alias("users"))
    months = per_user.groupBy("country", "month").agg(F.sum("rows").alias("rows"))
    return months.join(users, "country").select(
        "country", "month", "rows", (F.col("rows") / F.col("users")).alias("mean_updates"))


def hourly_profile(df: DataFrame, hour: Column | None = None) -> DataFrame:
    """Updates per user of the country by hour of day."""
    hour = F.hour("start_time") if hour is None else hour
    per_user = df.groupBy("country", hour.alias("hour"), "useruuid").agg(F.count("*").alias("rows"))
    users = per_user.select("country", "useruuid").distinct().groupBy("country").agg(
        F.count("*").alias("users"))
    return (per_user.groupBy("country", "hour").agg(F.sum("rows").alias("rows")).join(users, "country")
            .select("country", "hour", "rows", (F.col("rows") / F.col("users")).alias("per_user")))


def rows_at_perimeters(df: DataFrame, perimeters: DataFrame) -> DataFrame:
    """Rows per country and how many of them lie outside the perimeters."""
    total = df.groupBy("country").agg(F.count("*").alias("total"))
    away = outside(df, perimeters).groupBy("country").agg(F.count("*").alias("away"))
    return total.join(away, "country", "left").fillna(0, ["away"])


def coocs_at_perimeters(df: DataFrame, perimeters: DataFrame, cfg: BinConfig) -> DataFrame:
    """Co-occurrences per country, all and outside the perimeters.

    Both users' rows lie in the country. Pairs are counted, not made.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return pair_count(presence(rows, cfg, keep=("country",)), ["country"]).withColumnRenamed("coocs", name)
    return (counted(df, "total").join(counted(outside(df, perimeters), "away"), "country", "left")
            .fillna(0, ["away"]))


def coocs_per_bin(df: DataFrame, perimeters: DataFrame, cfg: BinConfig) -> DataFrame:
    """Co-occurrences by month and time bin, all and outside the perimeters."""
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return pair_count(presence(rows, cfg), ["time_bin"]).withColumnRenamed("coocs", name)
    month = F.date_format(bin_start(F.col("time_bin"), cfg), "yyyy-MM")
    return (counted(df, "total").join(counted(outside(df, perimeters), "away"), "time_bin", "left")
            .fillna(0, ["away"]).select(month.alias("month"), "time_bin", "total", "away"))


def pair_per_day(people: DataFrame, user1: object, user2: object, cfg: BinConfig,
                 first_day: str, last_day: str) -> DataFrame:
    """Co-occurrences of two users per day, days without any included."""
    both = people.filter(F.col("useruuid").isin(user1, user2))
    met = both.groupBy(*CELL).agg(F.count("*").alias("users")).filter(F.col("users") == 2)
    counted = (met.groupBy(F.to_date(bin_start(F.col("time_bin"), cfg)).alias("day"))
               .agg(F.count("*").alias("coocs")))
    days = day_frame(people, first_day, last_day)
    return days.join(counted, "day", "left").fillna(0, ["coocs"])


def day_frame(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """One row per calendar day, both ends included."""
    days = F.sequence(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))
    return df.sparkSession.range(1).select(F.explode(days).alias("day"))


def app_clock(apps: DataFrame, minutes: int, by_weekday: bool = False) -> DataFrame:
    """Share of each time-of-day slot in the use of a package."""
    keys = ["package_name"]
    if by_weekday:
        apps = apps.withColumn("weekday", F.weekday("start_time"))
        keys.append("weekday")
    slots = apps.select(*keys, F.explode(slots_of_day(F.col("start_time"), F.col("end_time"), minutes))
                        .alias("slot"))
    counted = slots.groupBy(*keys, "slot").agg(F.count("*").alias("uses"))
    # At most one row per slot of the day in each window.
    total = F.sum("uses").over(Window.partitionBy(*keys))
    return counted.withColumn("share", F.col("uses") / total)


def most_common(df: DataFrame, column: str, k: int) -> DataFrame:
    return (df.groupBy(column).agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), F.asc(column)).limit(k))


def class_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("label").agg(F.count("*").alias("rows"))


def feature_summary(table: DataFrame, features: Sequence[str],
                    probabilities: Sequence[float] = QUARTILES) -> DataFrame:
    """Quantiles, mean and deviation of every feature by label.

    The columns are staged, as they are read for counts and for means.
    """
    wide = stage(table.select("label", *[F.col(name).cast("double").alias(name) for name in features]), "features")
    long = wide.unpivot(["label"], list(features), "feature", "value")
    return summary(long, "value", ["label", "feature"], probabilities)


def density(df: DataFrame, decimals: int = 1) -> DataFrame:
    """Updates per coarse grid cell and their order of magnitude."""
    cell = spatial_bin(F.col("longitude"), F.col("latitude"), decimals)
    return (df.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows"))
            .withColumn("log_rows", F.log10("rows")))


def hex_density(df: DataFrame, size: float) -> DataFrame:
    """Updates per hexagon of a grid with edges of ``size`` degrees, and their order of magnitude."""
    q, r = hexagon(F.col("longitude"), F.col("latitude"), size)
    return (df.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("rows"))
            .withColumn("log_rows", F.log10("rows")))


def start_range(df: DataFrame, country: str) -> DataFrame:
    return (df.filter(F.col("country") == country)
            .agg(F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start")))


def records_in_cell(binned: DataFrame, cell: int | Column, user: object | None = None) -> DataFrame:
    there = binned.filter(F.col("spatial_bin") == cell)
    if user is not None:
        there = there.filter(F.col("useruuid") == F.lit(user))
    return there.agg(F.count("*").alias("rows"))


def local_hour(zones: dict[str, str]) -> Column:
    """Hour of day in the zone of the row's country, UTC for others."""
    zone = F.lit("UTC")
    for country, name in zones.items():
        zone = F.when(F.col("country") == country, F.lit(name)).otherwise(zone)
    return F.hour(local(F.col("start_time"), zone))
