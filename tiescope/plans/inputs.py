"""Location, app-usage, demographic and parameter tables made from ``events``.

Every value follows from the event row by integer arithmetic, so that the same
tables can be written in any SQL dialect.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiescope.config import BinConfig, Period
from tiescope.operators.pairing import co_occurrences, co_occurrences_by_pair
from tiescope.operators.presence import presence, stored
from tiescope.session import stage
from tiescope.sources.readers import with_age
from tiescope.sources.writers import with_bins

ORIGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
ORIGIN_SECONDS = 1704067200
CONFIG = BinConfig(decimals=3, minutes=60, origin=ORIGIN)
PERIODS = [Period(0, 240), Period(240, 480), Period(480, 720)]
FIRST_DAY, LAST_DAY, DAYS = "2024-01-01", "2024-01-30", 30
AS_OF = "2024-02-01"


class Inputs:
    """The tables of one data folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        # Event times carry no zone; all arithmetic is in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    @cached_property
    def events(self) -> DataFrame:
        raw = self.spark.read.parquet(f"{self.folder}/events.parquet")
        return raw.select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
            F.get_json_object("props", "$.k").cast("int").alias("k"))

    @cached_property
    def locations(self) -> DataFrame:
        begin = F.unix_seconds("ts")
        place = (F.col("k") % 20).cast("bigint")
        event = F.col("event_id")
        return self.events.select(
            event.alias("id"), F.col("user_id").alias("useruuid"),
            F.timestamp_seconds(begin).alias("start_time"),
            F.timestamp_seconds(begin + (event % 180 + 5) * 60).alias("end_time"),
            (F.lit(13.0005) + (place % 5) * F.lit(0.001)).alias("longitude"),
            (F.lit(55.0005) + place * F.lit(0.001)).alias("latitude"),
            (event * 13 % 100000).cast("int").alias("altitude"),
            F.when(event % 97 == 0, -1).otherwise(event * 37 % 60000).cast("int").alias("accuracy"),
            F.when(event % 29 == 0, "").when(F.col("user_id") % 4 == 3, "Japan").otherwise("Sweden")
            .alias("country"),
            F.concat(F.lit("place "), place.cast("string")).alias("name"))

    @cached_property
    def binned(self) -> DataFrame:
        return with_bins(self.locations, CONFIG)

    @cached_property
    def stored_binned(self) -> DataFrame:
        """Locations with their bins, written once: lookups read plain columns."""
        return stage(self.binned, "binned")

    @cached_property
    def presence(self) -> DataFrame:
        return presence(self.locations, CONFIG)

    def presence_in(self, number: int) -> DataFrame:
        return presence(self.locations, CONFIG, PERIODS[number - 1])

    @cached_property
    def stored(self) -> DataFrame:
        """Presence, written in buckets by cell and bin."""
        return stored(self.locations, CONFIG)

    @cached_property
    def met(self) -> DataFrame:
        """All co-occurrences, from the stored presence."""
        return co_occurrences(self.stored, placed=True).drop("people")

    def stored_in(self, number: int) -> DataFrame:
        """Presence of a period, written in buckets by cell and bin."""
        return stored(self.locations, CONFIG, PERIODS[number - 1])

    @cached_property
    def met_by_pair(self) -> DataFrame:
        """All co-occurrences, for grouping by pair."""
        return co_occurrences_by_pair(self.stored, placed=True).drop("people")

    def met_in(self, number: int) -> DataFrame:
        """Co-occurrences of a period, for grouping by pair."""
        return co_occurrences_by_pair(self.stored_in(number), placed=True).drop("people")

    def met_over(self, first: int, last: int) -> DataFrame:
        """Co-occurrences from one period to another, for grouping by pair."""
        over = Period(PERIODS[first - 1].start, PERIODS[last - 1].end)
        return co_occurrences_by_pair(stored(self.locations, CONFIG, over), placed=True).drop("people")

    @cached_property
    def apps(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("useruuid"),
            F.concat_ws("_", "event_type", (F.col("k") % 7).cast("string")).alias("package_name"),
            F.timestamp_seconds(F.unix_seconds("ts")).alias("start_time"),
            F.timestamp_seconds(F.unix_seconds("ts") + (F.col("event_id") % 30 + 1) * 60).alias("end_time"))

    @cached_property
    def people(self) -> DataFrame:
        user = F.col("user_id")
        born = F.date_add(F.lit("1960-01-01").cast("date"), (user * 7919 % 18000).cast("int"))
        listed = (self.events.select("user_id").distinct().filter(user % 7 != 0)
                  .select(user.alias("useruuid"),
                          F.when(user % 13 == 5, F.lit(None)).when(user % 2 == 0, "MALE").otherwise("FEMALE")
                          .alias("gender"),
                          F.when(user % 11 == 0, F.lit("1980-12-01").cast("date")).otherwise(born)
                          .alias("birthdate")))
        return with_age(listed, AS_OF)

    @cached_property
    def perimeters(self) -> DataFrame:
        """One excluded circle per country that occurs, at a place of its rows."""
        at = F.when(F.col("country") == "Sweden", 0).when(F.col("country") == "Japan", 2)
        named = self.locations.filter(F.col("country") != "").select("country").distinct()
        return named.select("country", (F.lit(13.0005) + at * 0.001).alias("longitude"),
                            (F.lit(55.0005) + at * 0.001).alias("latitude"), F.lit(150.0).alias("radius_m"))

    @cached_property
    def blocklist(self) -> DataFrame:
        """Users to drop, by a rule on their id."""
        return (self.locations.select("useruuid").distinct()
                .filter(F.col("useruuid") % 50 < 2).select("useruuid"))

    @cached_property
    def geocodes(self) -> DataFrame:
        """Geocoder answers for the places: a spelling, nothing, or only a motel."""
        place = F.substring_index("name", " ", -1).cast("int")
        return self.locations.select("longitude", "latitude", "name").distinct().select(
            F.col("latitude").alias("lat"), F.col("longitude").alias("lng"),
            F.when(place % 3 == 0, "Territorial waters of Gotland").when(place % 3 == 1, "RSA").alias("country"),
            F.when(place % 6 == 2, "Motel").alias("motel"))
