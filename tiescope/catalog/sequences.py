"""Windows and sequences over a user's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiescope.catalog.base import Query, r6, sql
from tiescope.catalog.binning import STEP_SQL
from tiescope.catalog.cleaning import DAY_SQL
from tiescope.operators import cohorts, features, mobility
from tiescope.operators.cleaning import in_country
from tiescope.plans.inputs import DAYS, FIRST_DAY, LAST_DAY, PERIODS, Inputs

TRAVEL_SQL = """steps_of AS (SELECT *, CASE WHEN time_bin - lag(time_bin) OVER w = 1 THEN 0 ELSE 1 END AS fresh,
   CASE WHEN time_bin - lag(time_bin) OVER w = 1 AND spatial_bin <> lag(spatial_bin) OVER w THEN 1 ELSE 0 END AS moved
   FROM c1 WINDOW w AS (PARTITION BY user1, user2 ORDER BY time_bin, spatial_bin)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user1, user2 ORDER BY time_bin, spatial_bin) AS run FROM steps_of),
travels AS (SELECT user1, user2, CAST(count(*) FILTER (n > 1 AND m = n - 1) AS BIGINT) AS common_travels FROM (
   SELECT user1, user2, run, count(*) AS n, sum(moved) AS m FROM runs GROUP BY ALL) GROUP BY user1, user2)"""

# Days of a user as one 30-bit number; similar users differ on at most 3 days.
PATTERN_SQL = """pat AS (SELECT useruuid, bit_or(1::BIGINT << CAST(d AS INTEGER)) AS p, count(*) AS active
   FROM (SELECT DISTINCT useruuid, d FROM daily WHERE d < 30) GROUP BY 1),
busy AS (SELECT * FROM pat WHERE active >= 15),
sim AS (SELECT a.useruuid AS x, b.useruuid AS y FROM busy a JOIN busy b ON a.useruuid <> b.useruuid
   AND bit_count(xor(a.p, b.p)) <= 3),
reach AS (SELECT x AS node, x AS other FROM sim UNION SELECT r.node, s.y FROM reach r JOIN sim s ON s.x = r.other)"""


def trajectories(t: Inputs):
    lines = mobility.trajectories(t.locations, part_rows=25)

    def text(values, digits):
        return F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v)), ",")
    return lines.select(
        "useruuid", "part",
        F.when(F.col("joins").isNull(), "").otherwise(text("joins", 4)).alias("joins"),
        text(F.flatten("points"), 4).alias("points"),
        F.array_join(F.transform("times", lambda v: F.unix_seconds(v).cast("string")), ",").alias("times"),
        F.aggregate("shares", F.lit(0.0), lambda total, part: total + part).alias("share"))


TRAJECTORY_SQL = sql("""SELECT useruuid, part,
 coalesce(lag(last_point) OVER (PARTITION BY useruuid ORDER BY part), '') AS joins, points, times, round(share, 6) + 0.0 AS share
 FROM (SELECT useruuid, part, last(pt ORDER BY n) AS last_point, string_agg(pt, ',' ORDER BY n) AS points,
  string_agg(CAST(s0 + 1704067200 AS VARCHAR), ',' ORDER BY n) AS times,
  sum((s1 - s0) / total) AS share FROM (
   SELECT *, (n - 1) // 25 AS part FROM (SELECT *, row_number() OVER (PARTITION BY useruuid ORDER BY s0, s1, id) AS n,
   printf('%.4f', longitude) || ',' || printf('%.4f', latitude) AS pt,
   sum(s1 - s0) OVER (PARTITION BY useruuid) AS total FROM loc)) GROUP BY useruuid, part)""")

QUERIES = {
    "f1_mean_speed": Query(lambda t: mobility.mean_speed(in_country(t.locations, "Japan")), sql(
        f"""SELECT useruuid, {r6('coalesce(avg(metres / secs * 18 / 5) FILTER (secs > 0), 0)')} AS kmh
 FROM steps GROUP BY 1""", STEP_SQL.replace("FROM loc WINDOW", "FROM loc WHERE country = 'Japan' WINDOW"))),
    "f2_mean_gap": Query(lambda t: mobility.mean_gap(t.locations), sql(
        f"""SELECT {r6('avg(m)')} AS minutes FROM (SELECT useruuid, avg((s1 - p0) / 60.0) AS m FROM (
 SELECT *, lag(s0) OVER (PARTITION BY useruuid ORDER BY s0, s1, id) AS p0 FROM loc) WHERE p0 IS NOT NULL GROUP BY 1)""")),
    "f2_update_gaps": Query(lambda t: mobility.update_gaps(t.locations), sql(
        f"""SELECT useruuid, {r6('avg((s1 - p0) / 60.0)')} AS minutes FROM (
 SELECT *, lag(s0) OVER (PARTITION BY useruuid ORDER BY s0, s1, id) AS p0 FROM loc) WHERE p0 IS NOT NULL GROUP BY 1""")),
    "f3_common_travels": Query(lambda t: features.common_travels(t.met_in(1)), sql(
        "SELECT user1, user2, common_travels FROM travels", TRAVEL_SQL)),
    "f4_trajectories": Query(trajectories, TRAJECTORY_SQL),
    "f5_near_duplicates": Query(
        lambda t: cohorts.near_duplicates(t.locations, FIRST_DAY, LAST_DAY, DAYS), sql(
        "SELECT node AS useruuid, min(other) AS duplicate_group FROM reach GROUP BY 1",
        f"{DAY_SQL},\n{PATTERN_SQL}", recursive=True)),
    "f5_adjacent_duplicates": Query(
        lambda t: cohorts.adjacent_duplicates(t.locations, FIRST_DAY, LAST_DAY, DAYS), sql(
        """SELECT u AS user1, useruuid AS user2 FROM (SELECT *, lag(useruuid) OVER w AS u, lag(p) OVER w AS q,
 lag(active) OVER w AS busy_days FROM pat WINDOW w AS (ORDER BY active, useruuid))
 WHERE busy_days >= 15 AND bit_count(xor(p, q)) <= 3""", f"{DAY_SQL},\n{PATTERN_SQL}", recursive=True)),
    "f6_occupancy_curve": Query(lambda t: cohorts.occupancy_curve(t.presence, PERIODS), sql(
        """SELECT round(i / 100.0, 6) AS share, count(*) FILTER (low * 100 >= i * 240) AS users
 FROM (SELECT CAST(range AS BIGINT) AS i FROM range(100)) CROSS JOIN (
 SELECT useruuid, CASE WHEN count(*) FILTER (n > 0) = 3 THEN min(n) ELSE 0 END AS low FROM (
   SELECT useruuid, p, count(DISTINCT time_bin) AS n FROM (SELECT *, time_bin // 240 AS p FROM pr WHERE time_bin < 720) GROUP BY ALL)
 GROUP BY 1) GROUP BY 1""")),
}
