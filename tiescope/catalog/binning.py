"""Projections, binning and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiescope.catalog.base import Query, r6, sql
from tiescope.config import BinConfig
from tiescope.functions import binning, calendar, geography
from tiescope.operators import cleaning, mobility, ordering, profiles
from tiescope.plans.inputs import CONFIG, ORIGIN, Inputs
from tiescope.sources.readers import nested_value

TEN_MINUTES = BinConfig(minutes=10, origin=ORIGIN)


def calendar_flag(flag):
    """A local-time predicate on the start of every presence row, two zones."""
    def build(t: Inputs):
        when = binning.bin_start(F.col("time_bin"), CONFIG)
        return t.presence.select("useruuid", "spatial_bin", "time_bin",
                                 flag(when, "Europe/Stockholm").alias("stockholm"),
                                 flag(when, "Asia/Tokyo").alias("tokyo"))
    return build


def flag_sql(condition: str) -> str:
    """The same with {h} for the local hour and {d} for the ISO weekday (winter offsets)."""
    columns = []
    for name, hours in (("stockholm", 1), ("tokyo", 9)):
        clock = f"(TIMESTAMP '2024-01-01' + to_hours(CAST(time_bin AS BIGINT) + {hours}))"
        columns.append(condition.format(h=f"hour({clock})", d=f"isodow({clock})") + f" AS {name}")
    return sql(f"SELECT useruuid, spatial_bin, time_bin, {', '.join(columns)} FROM pr")


def time_list(t: Inputs):
    """Half-hour steps of each day that has an event, with the end of each step."""
    day = t.locations.select(F.to_date("start_time").cast("timestamp").alias("day")).distinct()
    steps = calendar.time_steps(F.col("day"), F.col("day") + F.expr("interval 1 day"), 30)
    return (day.select("day", F.explode(steps).alias("begin"))
            .select("day", "begin", (F.unix_seconds("begin") + 1800).alias("finish")))


def slots(t: Inputs):
    return t.apps.select("id", F.explode(
        binning.slots_of_day(F.col("start_time"), F.col("end_time"), 15)).alias("slot"))


SLOT_SQL = """clocks AS (SELECT *, (s0 % 86400) // 60 AS m0, (s1 % 86400) // 60 AS m1 FROM apps),
slots AS (SELECT id, package_name, s0, unnest(CASE WHEN m1 < m0
  THEN list_distinct(range(m0 // 15, 96) || range(0, CAST(ceil(m1 / 15.0) AS BIGINT)))
  ELSE range(m0 // 15, CAST(ceil(m1 / 15.0) AS BIGINT)) END) AS slot FROM clocks)"""


def aliases(t: Inputs):
    spelled = t.locations.withColumn("country", F.when(F.col("id") % 5 == 0, "The Netherlands")
                                     .when(F.col("id") % 5 == 1, "Luxemburg").otherwise(F.col("country")))
    return cleaning.alias_country(spelled).select("id", "country")


def nested(t: Inputs):
    from tiescope.catalog.sources import records
    rows = records(t)
    return rows.select("id", nested_value(["devices", "id"], rows.schema).alias("device"),
                       nested_value(["name"], rows.schema).alias("place"))


def steps(t: Inputs):
    """Distance and speed from each update to the user's next one."""
    pairs = ordering.with_previous(t.locations, ["useruuid"], mobility.ORDER,
                                   F.floor(F.unix_seconds("start_time") / 3600),
                                   ["start_time", "longitude", "latitude"])
    metres = geography.distance_m(F.col("previous_longitude"), F.col("previous_latitude"),
                                  F.col("longitude"), F.col("latitude"))
    seconds = F.unix_seconds("end_time") - F.unix_seconds("previous_start_time")
    return (pairs.filter(F.col("previous_start_time").isNotNull() & (seconds > 0))
            .select("id", metres.alias("metres"), geography.speed_kmh(metres, seconds).alias("kmh")))


STEP_SQL = """prev AS (SELECT *, lag(s0) OVER w AS p0, lag(longitude) OVER w AS plng, lag(latitude) OVER w AS plat
  FROM loc WINDOW w AS (PARTITION BY useruuid ORDER BY s0, s1, id)),
steps AS (SELECT *, s1 - p0 AS secs, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(latitude - plat) / 2), 2)
  + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plng) / 2), 2)))) AS metres FROM prev)"""

CELL_REF = """CAST(floor((latitude + 90.0) * 1000.0) AS BIGINT) * {stride}
 + CAST(floor((longitude + 180.0) * 1000.0) AS BIGINT)"""


def bins_of_events(t: Inputs):
    return t.locations.select(
        "id", F.array_join(binning.time_bins(F.col("start_time"), F.col("end_time"), CONFIG)
                           .cast("array<string>"), ",").alias("hours"),
        F.array_join(binning.time_bins(F.col("start_time"), F.col("end_time"), TEN_MINUTES)
                     .cast("array<string>"), ",").alias("tens"),
        F.array_join(binning.time_bins(F.col("end_time"), F.col("start_time"), CONFIG)
                     .cast("array<string>"), ",").alias("reversed"),
        binning.time_bins(F.col("start_time"), None, CONFIG)[0].alias("start_bin"))


QUERIES = {
    "b1_spatial_bin": Query(
        lambda t: t.locations.select(
            "id", binning.spatial_bin(F.col("longitude"), F.col("latitude")).alias("spatial_bin"),
            binning.spatial_bin(F.col("longitude"), F.col("latitude"), 3, "ref").alias("narrow_bin"),
            binning.spatial_bin(F.col("longitude"), F.col("latitude"), 2).alias("coarse_bin")),
        sql(f"""SELECT id, spatial_bin, {CELL_REF.format(stride=180000)} AS narrow_bin,
 CAST(floor((latitude + 90.0) * 100.0) AS BIGINT) * 36000 + CAST(floor((longitude + 180.0) * 100.0) AS BIGINT)
 AS coarse_bin FROM binned""")),
    "b2_time_bins": Query(bins_of_events, sql("""SELECT id, array_to_string(time_bins, ',') AS hours,
 array_to_string(range(CAST(floor(s0 / 600.0) AS BIGINT), CAST(ceil(s1 / 600.0) AS BIGINT)), ',') AS tens,
 CASE WHEN CAST(floor(s1 / 3600.0) AS BIGINT) = CAST(ceil(s0 / 3600.0) AS BIGINT)
      THEN CAST(CAST(floor(s1 / 3600.0) AS BIGINT) AS VARCHAR)
      ELSE array_to_string(range(CAST(floor(s1 / 3600.0) AS BIGINT), CAST(ceil(s0 / 3600.0) AS BIGINT)), ',')
 END AS reversed, sb AS start_bin FROM binned""")),
    "b3_bin_start": Query(
        lambda t: t.presence.select("time_bin").distinct().select(
            "time_bin", binning.bin_start(F.col("time_bin"), CONFIG).alias("start"),
            binning.bin_start(F.col("time_bin"), TEN_MINUTES).alias("start_of_ten")),
        sql("""SELECT DISTINCT time_bin, 1704067200 + time_bin * 3600 AS start,
 1704067200 + time_bin * 600 AS start_of_ten FROM pr""")),
    "b4_is_evening": Query(calendar_flag(calendar.is_evening), flag_sql("({h} >= 18)")),
    "b5_is_weekend": Query(calendar_flag(calendar.is_weekend),
                           flag_sql("({d} IN (6, 7) OR ({d} = 5 AND {h} >= 18))")),
    "b6_is_saturday_night": Query(calendar_flag(calendar.is_saturday_night),
                                  flag_sql("({d} = 6 AND {h} >= 18)")),
    "b7_week_of_month": Query(
        lambda t: t.locations.select(F.to_date("start_time").alias("day")).distinct().select(
            "day", calendar.week_of_month(F.col("day")).alias("week")),
        sql("""SELECT DISTINCT strftime(d, '%Y-%m-%d') AS day,
 (day(d) + isodow(date_trunc('month', d)) - 2) // 7 + 1 AS week FROM (SELECT CAST(ts AS DATE) AS d FROM ev)""")),
    "b8_time_list": Query(time_list, sql("""SELECT day, day + i * 1800 AS begin, day + (i + 1) * 1800 AS finish
 FROM (SELECT DISTINCT 1704067200 + (s0 // 86400) * 86400 AS day FROM loc), (SELECT range AS i FROM range(48))""")),
    "b9_slots_of_day": Query(slots, sql("SELECT id, slot FROM slots", SLOT_SQL)),
    "b10_adjust_hour": Query(
        lambda t: t.locations.select(
            "id", calendar.shift_hour(F.hour("start_time"), F.col("country"), {"Japan": 7, "Sweden": 0}).alias("hour"),
            profiles.local_hour({"Japan": "Asia/Tokyo", "Sweden": "Europe/Stockholm"}).alias("local_hour")),
        sql("""SELECT id, ((s0 // 3600) % 24 + CASE WHEN country = 'Japan' THEN 7 ELSE 0 END) % 24 AS hour,
 ((s0 // 3600) + CASE country WHEN 'Japan' THEN 9 WHEN 'Sweden' THEN 1 ELSE 0 END) % 24 AS local_hour FROM loc""")),
    "b11_country_alias": Query(aliases, sql("""SELECT id, CASE id % 5 WHEN 0 THEN 'Netherlands' WHEN 1 THEN 'Luxembourg'
 ELSE country END AS country FROM loc""")),
    "b12_encode": Query(
        lambda t: ordering.encode(t.locations, "useruuid", "code").select("useruuid", "code"),
        sql("SELECT useruuid, dense_rank() OVER (ORDER BY useruuid) AS code FROM (SELECT DISTINCT useruuid FROM loc)")),
    "b12_encode_text": Query(
        lambda t: ordering.encode(t.apps, "package_name", "code"),
        sql("""SELECT package_name, dense_rank() OVER (ORDER BY package_name) AS code
 FROM (SELECT DISTINCT package_name FROM apps)""")),
    "b13_valid_point": Query(
        lambda t: t.locations.select(
            "id", F.when(F.col("id") % 10 == 0, "north").otherwise(F.col("latitude").cast("string")).alias("lat"),
            F.col("longitude").cast("string").alias("lng")).select(
            "id", geography.valid_point(F.col("lng"), F.col("lat")).alias("valid")),
        sql("SELECT id, id % 10 <> 0 AS valid FROM loc")),
    "b14_nested_value": Query(nested, sql("""SELECT CAST(id AS VARCHAR) AS id, CAST(useruuid AS VARCHAR) AS device,
 'place ' || place AS place FROM loc""")),
    "b15_distance": Query(steps, sql(
        f"SELECT id, {r6('metres')} AS metres, {r6('metres / secs * 18 / 5')} AS kmh FROM steps"
        " WHERE p0 IS NOT NULL AND secs > 0", STEP_SQL)),
    "b16_bin_edges": Query(
        lambda t: profiles.bin_edges(profiles.rows_per_user(t.locations), "rows", 7),
        sql("""SELECT unnest(range(lo, hi, step)) AS edge, step FROM (SELECT min(n) AS lo, max(n) AS hi,
 CAST(ceil((max(n) - min(n)) / 7.0) AS BIGINT) AS step FROM (SELECT count(*) AS n FROM loc GROUP BY country, useruuid))""")),
}
