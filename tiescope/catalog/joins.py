"""Joins: co-occurrences, lookups, range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiescope.catalog.base import MET_SQL, Query, r6, sql
from tiescope.operators import cleaning, pairing
from tiescope.operators.features import cell_visits, labelled_places
from tiescope.operators.presence import CELL, cell_population, location_entropy, stored
from tiescope.plans.inputs import CONFIG, PERIODS, Inputs


def of_one_user(t: Inputs):
    return pairing.co_occurrences_of(t.stored_binned, 7).select(
        "id", "useruuid", "spatial_bin", "time_bins", "own_bins", "own_user")


def of_two_users(t: Inputs):
    return pairing.co_occurrences_of(t.stored_binned, 12, 16, PERIODS[0], t.perimeters).select(
        "id", "spatial_bin", "time_bins", "own_bins")


def filled(t: Inputs):
    by_cell = cleaning.country_by_cell(t.geocodes, CONFIG)
    return cleaning.fill_country(t.binned, by_cell).select("id", "country")


def population(t: Inputs):
    return t.met.join(cell_population(t.stored), CELL)


def entropy(t: Inputs):
    people = stored(t.locations, CONFIG, PERIODS[0])
    met = cell_visits(pairing.co_occurrences_by_pair(people, placed=True)).drop("task")
    return met.join(location_entropy(people), "spatial_bin")


ENTROPY_SQL = """ent AS (SELECT spatial_bin, -sum(n / tot * log2(n / tot)) AS h FROM (
  SELECT spatial_bin, useruuid, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY spatial_bin) AS tot
  FROM p1 GROUP BY spatial_bin, useruuid) GROUP BY spatial_bin)"""

QUERIES = {
    "d1_cooccurrences": Query(
        lambda t: t.met.select("user1", "user2", "spatial_bin", "time_bin"),
        sql("SELECT user1, user2, spatial_bin, time_bin FROM co")),
    "d2_cooccurrences_of_user": Query(of_one_user, sql(
        """SELECT id, useruuid, spatial_bin, array_to_string(time_bins, ',') AS time_bins,
 array_to_string(own_bins, ',') AS own_bins, CAST(7 AS BIGINT) AS own_user FROM met""", MET_SQL)),
    "d2_cooccurrences_of_pair": Query(of_two_users, sql(
        """SELECT b.id, b.spatial_bin, array_to_string(b.time_bins, ',') AS time_bins,
 array_to_string(o.own_bins, ',') AS own_bins FROM far b JOIN own o ON b.spatial_bin = o.spatial_bin
 WHERE list_has_any(b.time_bins, o.own_bins) AND list_min(b.time_bins) >= 0 AND list_max(b.time_bins) < 240""",
        """own AS (SELECT DISTINCT spatial_bin, time_bins AS own_bins FROM binned WHERE useruuid = 12
   AND list_min(time_bins) >= 0 AND list_max(time_bins) < 240),
far AS (SELECT * FROM binned b WHERE useruuid = 16 AND NOT EXISTS (SELECT 1 FROM perimeters q
 WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(q.lat - b.latitude) / 2), 2)
 + cos(radians(b.latitude)) * cos(radians(q.lat)) * pow(sin(radians(q.lng - b.longitude) / 2), 2))) <= 150))""")),
    "d3_met_in_bin": Query(lambda t: pairing.met_in_bin(t.presence, 7, 12, 300), sql(
        """SELECT count(*) > 0 AS met FROM pr a JOIN pr b ON a.spatial_bin = b.spatial_bin AND a.time_bin = b.time_bin
 WHERE a.useruuid = 7 AND b.useruuid = 12 AND a.time_bin = 300""")),
    "d4_users_in_cell": Query(
        lambda t: pairing.users_in_cell(t.binned, t.binned.agg(F.min("spatial_bin")).scalar(), 100),
        sql("""SELECT DISTINCT useruuid FROM binned WHERE spatial_bin = (SELECT min(spatial_bin) FROM binned)
 AND list_contains(time_bins, 100)""")),
    "d5_containing_updates": Query(lambda t: pairing.containing_updates(t.locations), sql(
        """SELECT s.id AS source_id, s.useruuid AS source, t.id AS target_id, t.useruuid AS target
 FROM loc s JOIN loc t ON s.useruuid <> t.useruuid AND t.s0 BETWEEN s.s0 - 43200 AND s.s0
 AND t.s1 BETWEEN s.s1 AND s.s1 + 43200 AND abs(t.longitude - s.longitude) <= 0.001
 AND abs(t.latitude - s.latitude) <= 0.001""")),
    "d6_share_in_country": Query(
        lambda t: pairing.share_in_country(t.locations, "Japan", 0.5).select("useruuid", "inside", "rows", "ratio"),
        sql(f"""SELECT useruuid, inside, rows, {r6('inside / rows')} AS ratio FROM (SELECT useruuid,
 count(*) FILTER (country = 'Japan') AS inside, count(*) AS rows FROM loc WHERE country <> '' GROUP BY 1)
 WHERE inside > 0 AND inside / rows >= 0.5""")),
    "d7_fill_country": Query(filled, sql(
        """SELECT id, CASE WHEN country <> '' THEN country WHEN place % 3 = 0 THEN 'Sweden'
 WHEN place % 3 = 1 THEN 'South Africa' WHEN place % 6 = 2 THEN 'South Korea' ELSE '' END AS country FROM loc""")),
    "d8_met_next": Query(
        lambda t: labelled_places(t.met_over(1, 2), *PERIODS[:2]).select("user1", "user2", "label"),
        sql("""SELECT DISTINCT user1, user2, CAST(EXISTS (SELECT 1 FROM c2 n WHERE n.user1 = c1.user1
 AND n.user2 = c1.user2) AS BIGINT) AS label FROM c1""")),
    "d9_cell_population": Query(population, sql(
        """SELECT user1, user2, co.spatial_bin, co.time_bin, people FROM co JOIN (SELECT spatial_bin, time_bin,
 count(*) AS people FROM pr GROUP BY ALL) n ON n.spatial_bin = co.spatial_bin AND n.time_bin = co.time_bin""")),
    "d10_entropy": Query(entropy, sql(
        f"""SELECT user1, user2, c1.spatial_bin, count(*) AS visits, {r6('any_value(h)')} AS entropy
 FROM c1 JOIN ent USING (spatial_bin) GROUP BY ALL""", ENTROPY_SQL)),
    "d11_user_lookup": Query(
        lambda t: pairing.attach_both(pairing.dyads(t.met_by_pair),
                                      t.people.select("useruuid", "gender", "age"))
        .fillna(-1, ["age1", "age2"]),
        sql("""SELECT user1, user2, a.gender AS gender1, coalesce(CAST(a.age AS BIGINT), -1) AS age1, b.gender AS gender2,
 coalesce(CAST(b.age AS BIGINT), -1) AS age2 FROM (SELECT DISTINCT user1, user2 FROM co) c
 LEFT JOIN aged a ON a.useruuid = user1 LEFT JOIN aged b ON b.useruuid = user2""")),
    "d12_only_in_one": Query(
        lambda t: pairing.only_in_one(t.locations, t.people),
        sql("""SELECT useruuid, 'left' AS side FROM (SELECT useruuid FROM loc EXCEPT SELECT useruuid FROM people)
 UNION ALL SELECT useruuid, 'right' FROM (SELECT useruuid FROM people EXCEPT SELECT useruuid FROM loc)""")),
    "d13_simultaneous_sessions": Query(lambda t: pairing.simultaneous_sessions(t.apps, 600), sql(
        """SELECT a.package_name, a.id AS id1, a.useruuid AS user1, b.id AS id2, b.useruuid AS user2
 FROM apps a JOIN apps b ON a.package_name = b.package_name AND a.useruuid < b.useruuid
 AND abs(a.s0 - b.s0) <= 600 AND abs(a.s1 - b.s1) <= 600""")),
}
