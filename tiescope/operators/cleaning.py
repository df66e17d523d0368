"""Filters that turn raw location updates into usable ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiescope.config import BinConfig, Period
from tiescope.functions.binning import spatial_bin, start_bin
from tiescope.functions.geography import EARTH_RADIUS_M, distance_m

ACCURACY_MM = (0, 55_000)

# Spellings of a country and the name they are stored under.
COUNTRY_ALIASES = {
    "Republic of China": "China",
    "Islamic Republic of Iran": "Iran",
    "Republic of the Philippines": "Philippines",
    "RSA": "South Africa",
    "Russian Federation": "Russia",
    "Spain (territorial waters)": "Spain",
    "Territorial waters of Bornholm": "Denmark",
    "Territorial waters of Gotland": "Sweden",
    "The Netherlands": "Netherlands",
    "United States of America": "United States",
    "Luxemburg": "Luxembourg",
}

# Birthdates that registration forms fill in by default.
DEFAULT_BIRTHDATES = ("1980-12-01", "1981-01-01", "1990-01-01")


def accurate(df: DataFrame, bounds: tuple[int, int] = ACCURACY_MM) -> DataFrame:
    return df.filter(F.col("accuracy").between(*bounds))


def not_before(df: DataFrame, day: str) -> DataFrame:
    """Drop rows whose both ends lie before ``day``."""
    limit = F.to_timestamp(F.lit(day))
    return df.filter(~((F.col("start_time") < limit) & (F.col("end_time") < limit)))


def within(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows that start and end inside the period."""
    return df.filter((F.col("start_time") >= F.to_timestamp(F.lit(start)))
                     & (F.col("end_time") <= F.to_timestamp(F.lit(end))))


def without_users(df: DataFrame, blocklist: DataFrame) -> DataFrame:
    return df.join(blocklist.select("useruuid"), "useruuid", "left_anti")


def clean(df: DataFrame, accuracy: tuple[int, int] = ACCURACY_MM,
          day: str | None = None, blocklist: DataFrame | None = None) -> DataFrame:
    """The usual cleaning: listed users, inaccurate rows, rows before a day."""
    df = accurate(df, accuracy)
    if day is not None:
        df = not_before(df, day)
    return without_users(df, blocklist) if blocklist is not None else df


def in_country(df: DataFrame, countries: str | Sequence[str] | None) -> DataFrame:
    if countries is None:
        return df
    names = [countries] if isinstance(countries, str) else list(countries)
    return df.filter(F.col("country").isin(names))


def country_is_missing() -> Column:
    return F.coalesce(F.col("country"), F.lit("")) == ""


def overlaps(start: Column, end: Column) -> Column:
    """Rows whose interval shares time with ``[start, end)``, as SQL OVERLAPS.

    A row without duration overlaps when its instant lies in the interval.
    """
    began, ended = F.col("start_time"), F.col("end_time")
    return F.when(began == ended, (began >= start) & (began < end)).otherwise(
        (began < end) & (ended > start))


def bins_inside(period: Period) -> Column:
    """All bins of the row lie in ``[start, end)`` of the period."""
    return ((F.array_min("time_bins") >= period.start)
            & (F.array_max("time_bins") < period.end))


def in_period(df: DataFrame, period: Period | None) -> DataFrame:
    """Cut of a table that has a ``time_bin`` column."""
    if period is None:
        return df
    return df.filter((F.col("time_bin") >= period.start) & (F.col("time_bin") < period.end))


def sessions_in_period(apps: DataFrame, cfg: BinConfig, period: Period) -> DataFrame:
    """App rows that start and end inside the period."""
    last = start_bin(F.col("end_time"), cfg)
    return apps.filter((start_bin(F.col("start_time"), cfg) >= period.start) & (last < period.end))


def plausible_people(people: DataFrame, defaults: Sequence[str] = DEFAULT_BIRTHDATES) -> DataFrame:
    """No default birthdates, older than 16 and younger than 100."""
    filled_in = F.date_format("birthdate", "yyyy-MM-dd").isin(list(defaults))
    return people.filter(~filled_in & (F.col("age") > 16) & (F.col("age") < 100))


def specific(table: DataFrame, label: str = "label") -> DataFrame:
    """Positive rows with a specificity above 1 are measurement errors."""
    return table.filter(~((F.col(label) == 1) & (F.col("specificity") > 1)))


def matching(df: DataFrame, required: Mapping[str, object]) -> DataFrame:
    """Rows whose columns equal the required values."""
    for column, value in required.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def of_user(df: DataFrame, user: object, country: str | None = None,
            cell: int | None = None) -> DataFrame:
    df = df.filter(F.col("useruuid") == F.lit(user))
    if country is not None:
        df = df.filter(F.col("country") == country)
    return df if cell is None else df.filter(F.col("spatial_bin") == cell)


def _tile(coordinate: Column, shift: float, tile: float) -> Column:
    return F.floor((coordinate + shift) / F.lit(tile))


def perimeter_tiles(perimeters: DataFrame, tile: float = 0.05) -> DataFrame:
    """Every map tile each perimeter can touch, one row per tile."""
    reach_lat = F.degrees(F.col("radius_m") / EARTH_RADIUS_M) * 1.001
    worst_lat = F.least(F.abs("p_lat") + reach_lat, F.lit(89.9))
    reach_lng = F.least(reach_lat / F.cos(F.radians(worst_lat)), F.lit(180.0))
    around = int(round(360 / tile))
    rows = F.sequence(_tile(F.col("p_lat") - reach_lat, 90.0, tile),
                      _tile(F.col("p_lat") + reach_lat, 90.0, tile))
    columns = F.sequence(_tile(F.col("p_lng") - reach_lng, 180.0, tile),
                         _tile(F.col("p_lng") + reach_lng, 180.0, tile))
    return (perimeters
            .withColumn("p_row", F.explode(rows))
            .withColumn("p_column", F.explode(columns))
            .withColumn("p_column", F.pmod("p_column", F.lit(around)))
            .distinct())


def outside(df: DataFrame, perimeters: DataFrame, by_country: bool = True,
            tile: float = 0.05) -> DataFrame:
    """Rows that lie in none of the perimeters.

    ``perimeters`` has country, longitude, latitude, radius_m. Tiles make this
    an equi-join whatever the number of perimeters; the distance decides.
    ``by_country=False`` applies every perimeter to every row.
    """
    listed = perimeters.select(F.col("country").alias("p_country"), F.col("longitude").alias("p_lng"),
                               F.col("latitude").alias("p_lat"), "radius_m")
    tiles = perimeter_tiles(listed, tile)
    around = int(round(360 / tile))
    row = _tile(F.col("latitude"), 90.0, tile)
    column = F.pmod(_tile(F.col("longitude"), 180.0, tile), F.lit(around))
    near = ((row == F.col("p_row")) & (column == F.col("p_column"))
            & (distance_m(F.col("longitude"), F.col("latitude"), F.col("p_lng"), F.col("p_lat"))
               <= F.col("radius_m")))
    if by_country:
        near = near & (df["country"] == F.col("p_country"))
    return df.join(tiles, near, "left_anti")


def alias_country(df: DataFrame, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> DataFrame:
    """Country under its usual name."""
    names = F.create_map(*[F.lit(text) for pair in aliases.items() for text in pair])
    return df.withColumn("country", F.coalesce(F.try_element_at(names, F.col("country")), F.col("country")))


def country_by_cell(geocodes: DataFrame, cfg: BinConfig,
                    aliases: Mapping[str, str] = COUNTRY_ALIASES) -> DataFrame:
    """One country per cell from geocoder answers (lat, lng, country, motel).

    An answer without country but with a motel lies in South Korea. A cell
    with several answers takes the alphabetically first, so runs agree.
    """
    named = alias_country(geocodes, aliases).withColumn(
        "country", F.when(F.col("country").isNull() & F.col("motel").isNotNull(), "South Korea")
        .otherwise(F.col("country")))
    return (named.filter(F.col("country").isNotNull())
            .groupBy(spatial_bin(F.col("lng"), F.col("lat"), cfg.decimals, cfg.stride).alias("spatial_bin"))
            .agg(F.min("country").alias("found_country")))


def fill_country(binned: DataFrame, by_cell: DataFrame) -> DataFrame:
    """Blank countries filled from the lookup of their cell."""
    return (binned.join(by_cell, "spatial_bin", "left")
            .withColumn("country", F.when(country_is_missing(),
                                          F.coalesce("found_country", "country"))
                        .otherwise(F.col("country")))
            .drop("found_country"))
