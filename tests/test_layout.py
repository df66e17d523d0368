"""Stored layout, work dealt by counts, cut lookups, contraction, pivots."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiescope.operators import graph, ordering, pairing
from tiescope.plans.inputs import Inputs
from tiescope.session import bucketed

SF = "/root/testdata/sf0.001"


def crowded_people(spark):
    """One cell with 600 users, and 3,000 cells with 2 to 12."""
    draw = random.Random(2)
    rows = [(f"u{k}", 0, 0) for k in range(600)]
    for cell in range(1, 3001):
        rows += [(f"u{k}", cell, cell % 24) for k in draw.sample(range(600), draw.randint(2, 12))]
    return rows, spark.createDataFrame(rows, "useruuid string, spatial_bin bigint, time_bin bigint")


def pairs_of(rows):
    cells = collections.defaultdict(set)
    for user, cell, time_bin in rows:
        cells[cell, time_bin].add(user)
    return cells


def test_pairs_are_dealt_by_their_counts(spark):
    rows, people = crowded_people(spark)
    found = pairing.co_occurrences(people, block_rows=40, task_pairs=10_000)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    total = sum(len(u) * (len(u) - 1) // 2 for u in pairs_of(rows).values())
    assert sum(sizes) == total and len(sizes) >= 20
    assert max(sizes) <= 2 * total / len(sizes)


@pytest.mark.parametrize("placed", [False, True])
@pytest.mark.parametrize("block_rows", [7, 2048])
def test_pairs_of_stored_presence(spark, placed, block_rows):
    draw = random.Random(3)
    rows = sorted({(f"u{draw.randint(0, 30)}", draw.choice([1, 1, 1, 2, 3]), draw.randint(0, 3)) for _ in range(400)})
    people = spark.createDataFrame(rows, "useruuid string, spatial_bin bigint, time_bin bigint").withColumn("odd", F.col("time_bin") % 2)
    if placed:
        people = bucketed(people, ["spatial_bin", "time_bin"])
    found = [tuple(r) for r in pairing.co_occurrences(people, carry=["odd"], block_rows=block_rows, placed=placed).select(
        "user1", "user2", "spatial_bin", "time_bin", "odd1", "odd2").collect()]
    expected = {(a, b, cell, time_bin, time_bin % 2, time_bin % 2)
                for (cell, time_bin), users in pairs_of(rows).items() for a in users for b in users if a < b}
    assert set(found) == expected and len(found) == len(expected)
    nobody = people.filter("useruuid = 'u1'")
    assert pairing.co_occurrences(nobody, placed=placed).count() == 0


def test_grid_is_dealt_by_counts(spark):
    draw = random.Random(4)
    left = [(0, k) for k in range(500)] + [(draw.randint(1, 400), 500 + k) for k in range(1500)]
    right = [(0, k) for k in range(300)] + [(draw.randint(1, 400), 300 + k) for k in range(1500)]
    a, b = spark.createDataFrame(left, "k int, l int"), spark.createDataFrame(right, "k int, r int")
    found = pairing.grid_join(a, b, ["k"], "l", "r", block_rows=40, task_pairs=10_000)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    number = collections.Counter(k for k, _ in right)
    total = sum(number[k] for k, _ in left)
    assert sum(sizes) == total and max(sizes) <= 2 * total / len(sizes)
    assert len({tuple(r) for r in found.collect()}) == total


def moved(df):
    """Keys of the hash exchanges of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1] for line in plan.split("\n") if "hashpartitioning(" in line]


def test_stored_presence_is_not_moved(spark):
    inputs = Inputs(spark, SF)
    assert inputs.met.count() > 0 and moved(inputs.met) == []
    assert moved(pairing.cell_population(inputs.stored)) == []


def test_stored_neighbours_are_not_moved(spark):
    pairs = spark.range(200).selectExpr("id as user1", "id + 1 as user2", "1L as weight")
    neighbours = bucketed(graph.ends(pairs), ["contact"])
    scores = neighbours.select("useruuid").distinct().withColumn("score", F.lit(1.0))
    joined = neighbours.join(scores.select(F.col("useruuid").alias("contact"), "score").hint("merge"), "contact")
    exchanged = moved(joined)
    assert len(exchanged) == 1 and exchanged[0].startswith("useruuid")  # the scores only


def test_lookup_cuts_hot_keys(spark):
    rows = spark.range(20000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as k")
    table = spark.range(20001).selectExpr("id as k", "id * 2 as v").filter("k <> 4")
    found = ordering.lookup(rows, "k", table, "left", hot_rows=500)
    got = {r.id: r.v for r in found.collect()}
    assert got == {k: None if k == 4 else 14 if k % 3 == 0 else 2 * k for k in range(20000)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in ordering.lookup(rows, "k", table, "inner", hot_rows=500)
                 .groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 2 * sum(sizes) / 8


def smallest(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    near = collections.defaultdict(list)
    for a, b in edges:
        near[a].append(b), near[b].append(a)
    seen = {}
    for start in sorted(label):
        stack = [start] if start not in seen else []
        while stack:
            u = stack.pop()
            if u not in seen:
                seen[u] = start
                stack += near[u]
    return seen


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(5)
    edges = {"chain": [(k, k + 1) for k in range(1500)],
             "star": [(0, k) for k in range(1, 1500)] + [(2000, 2001)],
             "random": [(a, b) for a, b in ((draw.randint(0, 900), draw.randint(0, 900)) for _ in range(700)) if a != b],
             "none": []}[shape]
    edges = sorted({(min(e), max(e)) for e in edges})
    df = spark.createDataFrame(edges, "user1 bigint, user2 bigint")
    assert dict(graph.components(df, hot_rows=100).collect()) == smallest(edges)


def test_rounds_shrink(spark):
    """One giant component: every round has a fraction of the users of the round before."""
    df = spark.range(3000).selectExpr("id as user1", "id + 1 as user2").unionByName(
        spark.range(3000).selectExpr("0L as user1", "id + 2 as user2")).distinct()
    sizes = [step.count() for step in graph.contractions(df, 200)]
    assert sizes[0] == 3002 and len(sizes) <= 6
    assert all(b <= a / 2 for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("edges", [[(1, 2, 1.0), (2, 3, 1.0)], [(k, k + 10, 1.0 + k) for k in range(3)] + [(k, (k + 1) % 3 + 10, 2.0) for k in range(3)],
                                   [(1, 2, 3.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 5.0)]])
def test_centrality(spark, edges):
    """Bipartite graphs too, against the eigenvector of the matrix."""
    users = sorted({u for e in edges for u in e[:2]})
    matrix = np.zeros((len(users), len(users)))
    for a, b, w in edges:
        matrix[users.index(a), users.index(b)] = matrix[users.index(b), users.index(a)] = w
    vector = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    found = dict(graph.eigenvector(spark.createDataFrame(edges, "user1 bigint, user2 bigint, weight double")).collect())
    assert [found[u] for u in users] == pytest.approx(vector / vector.max(), abs=1e-6)


def test_centrality_stops_at_the_limit(spark):
    df = spark.range(60).selectExpr("id as user1", "id + 1 as user2", "1L as weight")
    with pytest.raises(ValueError):
        graph.eigenvector(df, limit=5)


def test_quantiles_of_a_narrow_range(spark):
    """Microseconds of one month: slices are even, results exact."""
    draw = np.random.default_rng(6)
    values = 1_704_067_200_000_000 + np.sort(draw.integers(0, 30 * 86400 * 10 ** 6, 20000))
    df = spark.createDataFrame([(int(v), "g") for v in values], "v bigint, g string")
    pivots = ordering._pivots(df, "v", ["g"])
    sliced = df.join(pivots, "g").withColumn("s", ordering._slice(F.col("v").cast("double")))
    sizes = [r["count"] for r in sliced.groupBy("s").count().collect()]
    assert len(sizes) == ordering.PIVOTS + 1 and max(sizes) <= 4 * len(values) / len(sizes)
    points = (0.0, 0.1, 0.333, 0.5, 0.99, 1.0)
    for row in (ordering.quantiles(df, "v", points).first(), ordering.quantiles(df, "v", points, ["g"]).first()):
        assert row["rows"] == len(values)
        for p in points:
            assert row[ordering.quantile_name(p)] == pytest.approx(np.quantile(values, p), abs=0.51)
    assert ordering.quantiles(df.filter("v < 0"), "v", points).count() in (0, 1)
