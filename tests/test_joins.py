import numpy as np
import pytest
from pyspark.sql import functions as F

from tiescope.operators import cleaning, pairing


@pytest.fixture(scope="module")
def updates(spark):
    """Updates with one crowded place and hour that holds a third of them."""
    rng = np.random.default_rng(3)
    rows = []
    for number in range(240):
        crowded = number % 3 == 0
        start = 5000 + int(rng.integers(0, 900)) if crowded else int(rng.integers(0, 86400))
        lng = 13.0 if crowded else 13.0 + float(rng.integers(0, 4)) * 0.0007
        rows.append((number, f"u{number % 17}", start, start + int(rng.integers(60, 9000)), lng, 55.0))
    table = spark.createDataFrame(rows, "id int, useruuid string, s bigint, e bigint, longitude double, latitude double")
    return rows, table.withColumns({"start_time": F.timestamp_seconds("s"), "end_time": F.timestamp_seconds("e")})


@pytest.mark.parametrize("block_rows", [4, 2048])
def test_containing_updates_against_loops(updates, block_rows):
    rows, table = updates
    found = pairing.containing_updates(table, 120, 0.001, block_rows).select("source_id", "target_id").collect()
    expected = {(s[0], t[0]) for s in rows for t in rows
                if s[1] != t[1] and s[2] - 3600 <= t[2] <= s[2] and s[3] <= t[3] <= s[3] + 3600
                and abs(t[4] - s[4]) <= 0.001}
    assert len(found) == len(expected) and {tuple(row) for row in found} == expected


@pytest.mark.parametrize("block_rows", [3, 2048])
def test_simultaneous_sessions_against_loops(updates, block_rows):
    rows, table = updates
    apps = table.withColumn("package_name", F.concat(F.lit("p"), (F.col("id") % 2).cast("string")))
    found = pairing.simultaneous_sessions(apps, 300, block_rows).select("id1", "id2").collect()
    expected = {(a[0], b[0]) for a in rows for b in rows
                if a[1] < b[1] and a[0] % 2 == b[0] % 2 and abs(a[2] - b[2]) <= 300 and abs(a[3] - b[3]) <= 300}
    assert len(found) == len(expected) and {tuple(row) for row in found} == expected


def test_perimeters_at_the_date_line_and_near_the_pole(spark):
    points = spark.createDataFrame(
        [(1, "A", 179.9999, 0.0), (2, "A", -179.9999, 0.0), (3, "A", 179.98, 0.0), (4, "B", 10.0, 89.5), (5, "B", 40.0, 89.5)],
        "id int, country string, longitude double, latitude double")
    circles = spark.createDataFrame([("A", 180.0, 0.0, 500.0), ("B", 10.2, 89.5, 500.0)],
                                    "country string, longitude double, latitude double, radius_m double")
    assert sorted(r["id"] for r in cleaning.outside(points, circles).collect()) == [3, 5]
    swapped = circles.withColumn("country", F.lit("C"))
    assert cleaning.outside(points, swapped).count() == 5
    assert sorted(r["id"] for r in cleaning.outside(points, swapped, by_country=False).collect()) == [3, 5]


def test_country_lookup_and_aliases(spark):
    from tiescope.plans.inputs import CONFIG
    answers = spark.createDataFrame(
        [(55.0, 13.0, "The Netherlands", None), (56.0, 13.0, None, "Motel"), (57.0, 13.0, None, None)],
        "lat double, lng double, country string, motel string")
    found = {row["found_country"] for row in cleaning.country_by_cell(answers, CONFIG).collect()}
    assert found == {"Netherlands", "South Korea"}


def test_pair_count_needs_no_pairs(people_of):
    people = people_of([(f"u{n}", 1, 1) for n in range(50)] + [("u1", 2, 1), ("u2", 2, 1)])
    assert pairing.pair_count(people).first()["coocs"] == 50 * 49 // 2 + 1
    assert pairing.co_occurrences(people).count() == 50 * 49 // 2 + 1
