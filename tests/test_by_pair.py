"""Co-occurrences and contacts grouped by pairs of blocks of users."""

import re

from pyspark.sql import functions as F

from tiescope.config import Period
from tiescope.operators import features, graph, pairing
from tiescope.plans.inputs import CONFIG, PERIODS, Inputs


def test_pairs_of_blocks_stay_where_they_are_made(spark, people_of):
    people = people_of([(f"u{user}", cell, 0) for user in range(300) for cell in (1, 2, 3) if user % (cell + 1) != 1]
                       + [(None, 1, 0)])
    people = people.withColumn("odd", F.substring("useruuid", 2, 9).cast("int") % 2)
    found = pairing.co_occurrences_by_pair(people, carry=("odd",), task_rows=5_000)
    assert "task" in found.columns
    columns = ["user1", "user2", "spatial_bin", "time_bin", "people", "odd1", "odd2"]
    wanted = pairing.co_occurrences(people.filter("useruuid is not null"), pairing.cell_population(people), carry=("odd",))
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, wanted.select(*columns).collect()))
    # the co-occurrences are grouped by pair without being moved
    counted = graph.edges(found)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.index("SortMergeJoin")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, graph.edges(wanted).collect()))


def test_contacts_of_blocks_are_looked_up_where_they_are(spark):
    edges = [(a, b) for a in range(150) for b in range(a + 1, 150) if (a * b) % 7 != 3] + [(149, 900), (900, 901)]
    pairs = spark.createDataFrame(edges, "user1 bigint, user2 bigint")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    wanted = {(a, b, len(near[a]), len(near[b]), len(near[a] & near[b])) for a, b in edges}
    for task_edges, task_masks in ((1_000, 10_000), (1_000_000, 1)):  # by blocks, and by moving the lookups
        found = graph.common_contacts(pairs, task_edges, task_masks)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("ShuffledHashJoin" in plan) == (task_masks > 1)
        if task_masks > 1:  # the lookups are not moved
            assert plan.index("Exchange") > plan.index("ShuffledHashJoin")
        assert {tuple(row) for row in found.select("user1", "user2", "degree1", "degree2", "common").collect()} == wanted


def test_label_of_the_following_period(people_of):
    people = people_of([("a", 1, 0), ("b", 1, 0), ("a", 2, 1), ("b", 2, 1), ("a", 1, 11), ("b", 1, 11),
                        ("c", 3, 2), ("a", 3, 2), ("c", 4, 12), ("b", 4, 12)])
    found = features.labelled_places(pairing.co_occurrences(people), Period(0, 10), Period(10, 20))
    assert {tuple(row) for row in found.select("user1", "user2", "num_coocs", "unique_coocs", "label").collect()} == {
        ("a", "b", 2, 2, 1), ("a", "c", 1, 1, 0)}


def test_features_of_all_pairs_are_not_moved_to_the_users(spark):
    """Tables with a row per user are written first, so that Spark knows their size."""
    t = Inputs(spark, "/root/testdata/sf0.001")
    found = features.dyad_features(t.presence, CONFIG, PERIODS[0], apps=t.apps, demographics=t.people)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1] for line in plan.split("\n") if "hashpartitioning(" in line]
    assert keys and not [key for key in keys if re.match(r"user[12]#\d+L?, \d", key)]


def test_pairs_are_not_moved_between_features_contacts_and_label(people_of, monkeypatch):
    """Features, contacts and label of a pair are made in the task that pairs two blocks of users."""
    rows = [(f"u{user}", cell, when) for user in range(120) for cell in (1, 2, 3) for when in (0, 1, 5, 11)
            if (user * 31 + cell * 7 + when * 5) % 11 < 5] + [(None, 1, 0), ("u1", None, 0), ("u2", None, 0)]
    people, now, then = people_of(rows), Period(0, 10), Period(10, 20)
    some = people_of([(f"u{user}", 0, 0) for user in range(0, 120, 2)])
    found = []
    for blocks in (None, 3):  # moved by pair, and by pairs of blocks
        monkeypatch.setattr(features, "pair_blocks", lambda cells, task_rows: blocks)
        found.append([features.labelled_features(people, CONFIG, now, then, users=users) for users in (None, some)])
    (few, _), (table, chosen) = found

    def rows_of(df):
        return sorted(map(tuple, df.select(*[F.round(name, 9) if kind == "double" else name for name, kind in few.dtypes]).collect()))

    expected = rows_of(few)
    assert len(expected) > 500 and {row[few.columns.index("label")] for row in expected} == {0, 1}
    assert rows_of(table) == expected
    assert rows_of(chosen) == [row for row in expected if int(row[0][1:]) % 2 == int(row[1][1:]) % 2 == 0]
    moved = "".join(re.findall(r"(?:hash|range)partitioning\(.*", table._jdf.queryExecution().executedPlan().toString()))
    assert "user1" not in moved and "small" not in moved


def test_presence_is_moved_by_cells_of_a_block(spark):
    """A row for each cell and block, not for each user; numbers of 64 bits come back whole, null too."""
    edge = [0, 1, -1, 32767, 32768, -32768, 65535, 65536, -65537, 1 << 31, (1 << 40) + 5, -(1 << 63), (1 << 63) - 1]
    users = edge + list(range(100_000, 100_060))
    rows = [(user, cell, 0, None if n % 5 == 0 else -user - 1, n % 2 == 0, f"u{n}") for n, user in enumerate(users) for cell in (1, 2)]
    people = spark.createDataFrame(rows, "useruuid bigint, spatial_bin bigint, time_bin bigint, other bigint, odd boolean, name string")
    carry = ("other", "odd", "name")
    found = pairing.co_occurrences_by_pair(people, carry=carry, blocks=3)
    wanted = pairing.co_occurrences(people, carry=carry)
    columns = ["user1", "user2", "spatial_bin", "time_bin", "people", *[f"{name}{side}" for name in carry for side in (1, 2)]]
    assert found.select(*columns).exceptAll(wanted.select(*columns)).count() == 0
    assert found.count() == wanted.count() == 2 * len(users) * (len(users) - 1) // 2
    blocked = people.withColumn("block", pairing.user_block("useruuid", 3))
    assert pairing._packed(blocked, ["useruuid", *carry]).count() == 2 * 3
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 2
