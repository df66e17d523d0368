"""Shared pieces of the query catalog: SQL tables and result clean-up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiescope.plans.inputs import Inputs


@dataclass(frozen=True)
class Query:
    """One catalog entry: a Spark job and, where SQL can say it, the SQL."""

    build: Callable[[Inputs], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return finish(self.build(Inputs(spark, folder)))


def finish(df: DataFrame) -> DataFrame:
    """Comparable result: 64-bit integers, doubles with 6 digits, dates as text."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType):
            column = F.unix_seconds(column)
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def r6(expression: str) -> str:
    """Rounding that agrees with ``finish``; adding 0 turns -0.0 into 0.0."""
    return f"(round(cast({expression} as double), 6) + 0.0)"


# Tables of plans.inputs in SQL; times are seconds since 2024-01-01 UTC.
TABLES = """
ev AS (SELECT event_id, user_id, event_type, ts,
              (epoch_us(ts) // 1000000) - 1704067200 AS s0,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
loc AS (SELECT event_id AS id, user_id AS useruuid, s0, s0 + (event_id % 180 + 5) * 60 AS s1,
               k % 20 AS place,
               13.0005::DOUBLE + ((k % 20) % 5) * 0.001::DOUBLE AS longitude,
               55.0005::DOUBLE + (k % 20) * 0.001::DOUBLE AS latitude,
               (event_id * 13) % 100000 AS altitude,
               CASE WHEN event_id % 97 = 0 THEN -1 ELSE (event_id * 37) % 60000 END AS accuracy,
               CASE WHEN event_id % 29 = 0 THEN '' WHEN user_id % 4 = 3 THEN 'Japan' ELSE 'Sweden' END AS country
        FROM ev),
bins AS (SELECT *, CAST(floor((latitude + 90.0) * 1000.0) AS BIGINT) * 360000
                   + CAST(floor((longitude + 180.0) * 1000.0) AS BIGINT) AS spatial_bin,
                CAST(floor(s0 / 3600.0) AS BIGINT) AS sb, CAST(ceil(s1 / 3600.0) AS BIGINT) AS eb FROM loc),
binned AS (SELECT *, CASE WHEN sb = eb THEN [sb] ELSE range(sb, eb) END AS time_bins FROM bins),
pr AS (SELECT DISTINCT useruuid, spatial_bin, unnest(time_bins) AS time_bin FROM binned),
co AS (SELECT a.useruuid AS user1, b.useruuid AS user2, a.spatial_bin, a.time_bin
       FROM pr a JOIN pr b ON a.spatial_bin = b.spatial_bin AND a.time_bin = b.time_bin
       WHERE a.useruuid < b.useruuid),
p1 AS (SELECT * FROM pr WHERE time_bin >= 0 AND time_bin < 240),
p2 AS (SELECT * FROM pr WHERE time_bin >= 240 AND time_bin < 480),
p3 AS (SELECT * FROM pr WHERE time_bin >= 480 AND time_bin < 720),
c1 AS (SELECT * FROM co WHERE time_bin >= 0 AND time_bin < 240),
c2 AS (SELECT * FROM co WHERE time_bin >= 240 AND time_bin < 480),
c3 AS (SELECT * FROM co WHERE time_bin >= 480 AND time_bin < 720),
apps AS (SELECT event_id AS id, user_id AS useruuid, event_type || '_' || (k % 7) AS package_name,
                s0, s0 + (event_id % 30 + 1) * 60 AS s1 FROM ev),
people AS (SELECT user_id AS useruuid, CASE WHEN user_id % 13 = 5 THEN NULL WHEN user_id % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS gender,
                  CASE WHEN user_id % 11 = 0 THEN DATE '1980-12-01'
                       ELSE DATE '1960-01-01' + CAST((user_id * 7919) % 18000 AS INTEGER) END AS birthdate
           FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 0)),
aged AS (SELECT *, (DATE '2024-02-01' - birthdate) // 365 AS age FROM people),
perimeters AS (SELECT country, 13.0005::DOUBLE + p * 0.001::DOUBLE AS lng, 55.0005::DOUBLE + p * 0.001::DOUBLE AS lat
               FROM (VALUES ('Sweden', 0), ('Japan', 2)) AS v(country, p)),
away AS (SELECT * FROM binned b WHERE NOT EXISTS (
           SELECT 1 FROM perimeters q WHERE q.country = b.country
           AND 2 * 6371008.8 * asin(sqrt(pow(sin(radians(q.lat - b.latitude) / 2), 2)
               + cos(radians(b.latitude)) * cos(radians(q.lat)) * pow(sin(radians(q.lng - b.longitude) / 2), 2))) <= 150)),
days AS (SELECT CAST(range AS BIGINT) AS d, strftime(DATE '2024-01-01' + CAST(range AS INTEGER), '%Y-%m-%d') AS day
         FROM range(30))
"""


#: Updates that met user 7.
MET_SQL = """own AS (SELECT DISTINCT spatial_bin, time_bins AS own_bins FROM binned WHERE useruuid = 7),
met AS (SELECT b.id, b.useruuid, b.spatial_bin, b.time_bins, o.own_bins, b.longitude, b.latitude
        FROM binned b JOIN own o ON b.spatial_bin = o.spatial_bin
        WHERE b.useruuid <> 7 AND list_has_any(b.time_bins, o.own_bins))"""


def sql(select: str, tables: str = "", recursive: bool = False) -> str:
    """A query over the shared tables and, optionally, further named ones."""
    more = f",\n{tables}" if tables else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{TABLES.strip()}{more}\n{select}"
