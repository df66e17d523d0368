import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tiescope.functions.binning import magnitude_bucket
from tiescope.operators import cohorts, ordering, profiles


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(0, 500, 400).round(1), np.zeros(200), rng.integers(-5, 5, 100)])
    frame = pd.DataFrame({"id": range(len(data)), "v": data, "g": ["x" if n % 3 else "y" for n in range(len(data))]})
    return frame, spark.createDataFrame(frame)


def test_quantiles_equal_numpy(values):
    frame, table = values
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    for row in ordering.quantiles(table, "v", points, ["g"]).collect():
        part = frame[frame.g == row["g"]].v
        assert row["rows"] == len(part)
        for p in points:
            assert row[ordering.quantile_name(p)] == pytest.approx(np.quantile(part, p))
    whole = ordering.quantiles(table, "v", (0.5,)).first()
    assert whole["q50"] == pytest.approx(np.quantile(frame.v, 0.5))


def test_running_total_and_numbering(values):
    frame, table = values
    found = ordering.numbered(table, [F.col("v"), F.col("id")], [magnitude_bucket(F.col("v"))], by=["g"]).toPandas()
    ordered = frame.sort_values(["v", "id"])
    expected = ordered.groupby("g").cumcount() + 1
    joined = found.set_index("id").number
    assert (joined.loc[expected.index] == expected).all()
    assert set(found.groupby("g").number_all.first()) == set(frame.groupby("g").size())


def test_previous_row_across_chunks(values):
    frame, table = values
    found = ordering.with_previous(table, ["g"], ["id"], F.floor(F.col("id") / 50), ["v", "id"]).toPandas()
    expected = frame.groupby("g").id.shift()
    got = found.set_index("id").previous_id.sort_index()
    assert got.isna().sum() == 2
    assert (got.dropna() == expected.dropna()).all()


def test_encode_text_and_numbers(spark):
    words = spark.createDataFrame([(w,) for w in ["beta", "alpha", "alps", "gamma", "beta"]], "w string")
    assert dict(ordering.encode(words, "w").collect()) == {"alpha": 1, "alps": 2, "beta": 3, "gamma": 4}
    numbers = spark.range(0, 5000, 7)
    coded = {row["id"]: row["code"] for row in ordering.encode(numbers, "id").collect()}
    assert [coded[n] for n in sorted(coded)] == list(range(1, len(coded) + 1))


def test_histogram_last_bucket(spark):
    table = spark.createDataFrame([(90,), (95,), (250,), (-1,), (89,)], "v int")
    rows = {row["label"]: row["rows"] for row in profiles.histogram(table, "v", 10, 100).collect()}
    assert rows["90<"] == 3 and rows["80-90"] == 1 and len(rows) == 10 and sum(rows.values()) == 4


def test_boxplot(spark):
    table = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4, 5, 100]], "g string, v int")
    row = profiles.boxplot(table, "v", "g").first()
    assert (row["q25"], row["q50"], row["q75"]) == (2.25, 3.5, 4.75)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1, 5, 1)
    assert [r["v"] for r in profiles.outliers(table, "v", "g").collect()] == [100]


def test_near_duplicate_groups_of_chained_users(spark):
    """a and c differ on 6 days, each differs from b on 3 of 30."""
    days = {"a": range(1, 31), "b": range(4, 31), "c": range(7, 31), "d": range(1, 11), "e": range(1, 31)}
    rows = [(user, f"2024-01-{day:02d} 10:00:00") for user, active in days.items() for day in active]
    table = spark.createDataFrame(rows, "useruuid string, t string").select(
        "useruuid", F.to_timestamp("t").alias("start_time"), F.to_timestamp("t").alias("end_time"))
    groups = cohorts.near_duplicates(table, "2024-01-01", "2024-01-30", 30).collect()
    assert sorted((row["useruuid"], row["duplicate_group"]) for row in groups) == [
        ("a", "a"), ("b", "a"), ("c", "a"), ("e", "a")]


def test_near_patterns_by_flips_and_by_bands(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 20, 8)
    words = sorted({int(word ^ sum(1 << int(day) for day in rng.integers(0, 20, 3))) for word in base for _ in range(12)})
    patterns = spark.createDataFrame([(n, [word]) for n, word in enumerate(words)], "useruuid bigint, pattern array<bigint>")
    expected = {(a, b) for a in range(len(words)) for b in range(a + 1, len(words))
                if bin(words[a] ^ words[b]).count("1") <= 3}
    for near in (cohorts._near_by_flips, cohorts._near_by_bands):
        assert {tuple(row) for row in near(patterns, 20, 3).collect()} == expected


def test_counts_of_quantiles_are_made_once(spark, tmp_path):
    """The rows are read for the counts only, however many steps follow."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    table = spark.range(0, 500, 1, 4).selectExpr("id % 2 AS label", "cast(id AS double) AS v").mapInArrow(seen, "label bigint, v double")
    found = ordering.quantiles(table, "v", [0.0, 0.5, 1.0], ["label"]).collect()
    assert sorted(map(tuple, found)) == [(0, 250, 0.0, 249.0, 498.0), (1, 250, 1.0, 250.0, 499.0)]
    assert reads.value == 500
