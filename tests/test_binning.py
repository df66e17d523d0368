from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tiescope.config import BinConfig
from tiescope.functions import binning, calendar, geography
from tiescope.plans.inputs import CONFIG


def bins(spark, start, end, cfg=CONFIG, period=None):
    row = spark.createDataFrame([(start, end)], "s string, e string").select(
        F.to_timestamp("s").alias("s"), F.to_timestamp("e").alias("e"))
    return row.select(binning.time_bins(F.col("s"), F.col("e"), cfg, period)).first()[0]


@pytest.mark.parametrize("start, end, expected", [
    ("00:10", "00:50", [0]), ("00:10", "02:00", [0, 1]), ("00:10", "02:01", [0, 1, 2]),
    ("01:00", "01:00", [1]), ("03:10", "01:20", []),
])
def test_time_bins(spark, start, end, expected):
    assert bins(spark, f"2024-01-01 {start}:00", f"2024-01-01 {end}:00") == expected


def test_time_bins_before_origin(spark):
    assert bins(spark, "2023-12-31 22:30:00", "2024-01-01 00:30:00") == [-2, -1, 0]


def test_time_bins_clipped_to_period(spark):
    period = CONFIG.period(datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 3))
    assert (period.start, period.end) == (1, 3)
    assert bins(spark, "2024-01-01 00:10:00", "2024-01-01 09:00:00", period=period) == [1, 2]
    assert bins(spark, "2024-01-01 05:10:00", "2024-01-01 09:00:00", period=period) == []


def test_default_origin_and_inverse(spark):
    cfg = BinConfig(minutes=10)
    assert cfg.bin_of(datetime(2015, 8, 8, 22, tzinfo=timezone.utc)) == 0
    start = spark.range(1).select(F.unix_seconds(binning.bin_start(F.lit(7), cfg))).first()[0]
    assert start == datetime(2015, 8, 8, 23, 10, tzinfo=timezone.utc).timestamp()


def test_spatial_bin(spark):
    cell = spark.range(1).select(
        binning.spatial_bin(F.lit(13.0005), F.lit(55.0005)),
        binning.spatial_bin(F.lit(13.0005), F.lit(55.0005), 3, "ref")).first()
    assert list(cell) == [145000 * 360000 + 193000, 145000 * 180000 + 193000]


def test_week_of_month(spark):
    days = spark.createDataFrame([(date(2015, 9, 6),), (date(2015, 9, 7),)], "d date")
    assert [row[0] for row in days.orderBy("d").select(calendar.week_of_month(F.col("d"))).collect()] == [1, 2]


def test_weekend_starts_friday_evening(spark):
    rows = spark.createDataFrame([("2024-01-05 16:59:00",), ("2024-01-05 17:00:00",)], "t string").select(
        F.to_timestamp("t").alias("t"))
    flags = rows.orderBy("t").select(calendar.is_weekend(F.col("t")),
                                     calendar.is_weekend(F.col("t"), friday_from=None)).collect()
    assert [tuple(row) for row in flags] == [(False, False), (True, False)]


def test_covered_days(spark):
    rows = spark.createDataFrame([("2024-01-01 23:00:00", "2024-01-02 00:00:00"),
                                  ("2024-01-02 00:00:00", "2024-01-02 00:00:00"),
                                  ("2024-01-02 23:00:00", "2024-01-04 01:00:00")], "s string, e string")
    days = rows.select(F.size(calendar.covered_days(F.to_timestamp("s"), F.to_timestamp("e")))).collect()
    assert [row[0] for row in days] == [1, 1, 3]


def test_distance(spark):
    metres = spark.range(1).select(geography.distance_m(*map(F.lit, (13.0, 55.0, 13.0, 56.0)))).first()[0]
    assert metres == pytest.approx(111195, abs=5)
