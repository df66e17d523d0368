from math import e

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import coocs_of, features_of
from tiescope.config import Period
from tiescope.operators import features, graph, pairing
from tiescope.plans.inputs import CONFIG

PERIOD = Period(0, 240)


def by_pair(table):
    return {(row["user1"], row["user2"]): row.asDict() for row in table.collect()}


def coocs(spark, rows):
    return spark.createDataFrame(rows, "user1 string, user2 string, spatial_bin bigint, time_bin bigint")


def test_cooccurrence_pairs(people_of):
    met = pairing.co_occurrences(people_of([("a", 1, 5), ("b", 1, 5), ("c", 1, 5), ("a", 1, 6), ("d", 1, 7)]))
    assert sorted((row["user1"], row["user2"]) for row in met.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


@pytest.mark.parametrize("rows, expected", [
    ([(1, 5), (2, 10), (3, 11), (4, 12), (9, 14)], 1),
    ([(2, 10), (2, 11)], 0),
    ([(2, 10), (3, 11), (3, 12)], 0),
    ([(2, 10), (3, 11), (7, 20), (8, 21)], 2),
])
def test_common_travels(spark, rows, expected):
    table = features.common_travels(coocs(spark, [("a", "b", cell, when) for cell, when in rows]))
    assert table.first()["common_travels"] == expected


def test_diversity(spark):
    met = coocs(spark, [("a", "b", 1, 1), ("a", "b", 1, 2), ("a", "b", 2, 3), ("a", "b", 2, 4), ("a", "c", 1, 1)])
    by_log2 = by_pair(features.place_features(met))
    assert by_log2["a", "b"]["diversity"] == pytest.approx(e)
    assert by_log2["a", "c"]["diversity"] == pytest.approx(1.0)
    assert by_pair(features.place_features(met, "e"))["a", "b"]["diversity"] == pytest.approx(2.0)


def test_crowd_weight_and_timed_arrival(people_of):
    rows = [("a", 1, 1), ("b", 1, 1), ("a", 2, 5), ("b", 2, 5), ("c", 2, 5), ("d", 2, 5)]
    table = by_pair(features.crowd_features(features.context_coocs(people_of(rows))))
    assert table["a", "b"]["coocs_w"] == pytest.approx((1 + 1 / 3) / 2)
    assert table["a", "b"]["arr_leav"] == pytest.approx(((1 / 2 + 1 / 2) + (1 / 4 + 1 / 4)) / 2)


def test_mutual(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")], "user1 string, user2 string")
    assert by_pair(features.mutual(pairs))["a", "b"]["mutual"] == pytest.approx(0.25)
    assert by_pair(features.mutual(pairs, closed=True))["a", "b"]["mutual"] == pytest.approx(0.75)


def test_app_jaccard(spark):
    sets = {"a": {f"p{k}" for k in range(0, 150, 2)}, "b": {f"p{k}" for k in range(0, 150, 3)}, "c": {"p1"}}
    rows = [(user, app) for user, own in sets.items() for app in [*own, *own]] + [("c", None)]
    words = features.app_sets(spark.createDataFrame(rows, "useruuid string, package_name string"))
    assert {r["useruuid"]: r["n_apps"] for r in words.collect()} == {user: len(own) for user, own in sets.items()}
    users = [*sets, "nobody", "none"]
    pairs = spark.createDataFrame([(a, b) for a in users for b in users if a < b], "user1 string, user2 string")
    found = {(r["user1"], r["user2"]): r["j"] for r in pairing.attach_both(pairs, words).select(
        "user1", "user2", features.app_jaccard_of().alias("j")).collect()}
    for (a, b), jaccard in found.items():
        one, two = sets.get(a, set()), sets.get(b, set())
        assert jaccard == pytest.approx(len(one & two) / len(one | two) if one | two else 1.0)


def test_repeated_rows_add_nothing(spark):
    """Presence is distinct whatever the number of raw rows."""
    from tiescope.operators.presence import presence
    raw = spark.createDataFrame([("a", 13.0, 55.0)] * 5 + [("b", 13.0, 55.0)] * 3,
                                "useruuid string, longitude double, latitude double")
    raw = raw.withColumns({"start_time": F.lit("2024-01-01 00:10:00").cast("timestamp"),
                           "end_time": F.lit("2024-01-01 00:20:00").cast("timestamp")})
    assert pairing.co_occurrences(presence(raw, CONFIG)).count() == 1


presence_rows = st.lists(
    st.tuples(st.sampled_from("abcdefgh"), st.integers(1, 3), st.integers(0, 7)), min_size=2, max_size=60, unique=True)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=presence_rows)
def test_features_against_loops(people_of, rows):
    expected = features_of(rows)
    found = by_pair(features.dyad_features(people_of(rows), CONFIG, PERIOD))
    assert set(found) == set(expected)
    for pair, values in expected.items():
        for name, value in values.items():
            assert found[pair][name] == pytest.approx(value), (pair, name)
        assert found[pair]["diversity"] >= 1 - 1e-9
        assert 0 < found[pair]["coocs_w"] <= 1
        assert found[pair]["specificity"] <= 0.5
        assert 0 <= found[pair]["mutual"] <= 1
        assert found[pair]["unique_coocs"] <= found[pair]["num_coocs"]


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_crowded_cell_is_cut_into_blocks(people_of, block_rows):
    """One cell holds most rows; the pairs do not depend on the block size."""
    rows = [(f"u{number:03d}", 1, 1) for number in range(40)] + [(f"u{number:03d}", 2, number % 5) for number in range(20)]
    met = pairing.co_occurrences(people_of(rows), block_rows=block_rows)
    found = sorted((row["user1"], row["user2"], row["spatial_bin"], row["time_bin"]) for row in met.collect())
    expected = sorted((a, b, cell, when) for (a, b), list_ in coocs_of(rows).items() for when, cell in list_)
    assert found == expected


def test_carried_columns_follow_the_users(spark):
    people = spark.createDataFrame([(f"u{n}", 1, 1, n) for n in range(9)],
                                   "useruuid string, spatial_bin bigint, time_bin bigint, mark int")
    met = pairing.co_occurrences(people, carry=("mark",), block_rows=2)
    rows = met.select("user1", "user2", "mark1", "mark2").collect()
    assert len(rows) == 36
    assert all(row["user1"] == f"u{row['mark1']}" and row["user2"] == f"u{row['mark2']}" for row in rows)


def test_star_graph_common_contacts(spark):
    """One user met everybody: no pair of the star shares a contact."""
    pairs = spark.createDataFrame([("a", f"z{n}") for n in range(300)] + [("z1", "z2")], "user1 string, user2 string")
    common = {(row["user1"], row["user2"]): row["common"] for row in graph.common_contacts(pairs).collect()}
    assert common["a", "z1"] == common["a", "z2"] == common["z1", "z2"] == 1
    assert sum(common.values()) == 3
