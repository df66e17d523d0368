"""Filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiescope.catalog.base import Query, sql
from tiescope.operators import cleaning, features, heatmaps, profiles
from tiescope.operators.cohorts import cross_occupancy
from tiescope.operators.graph import edges
from tiescope.operators.pairing import both_selected, dyads
from tiescope.plans.inputs import CONFIG, PERIODS, Inputs

ROWS = "SELECT id, useruuid FROM loc"


def ids(df):
    return df.select("id", "useruuid")


def _time(text: str):
    return F.to_timestamp(F.lit(text))


FROM, TO = "2024-01-05 06:00:00", "2024-01-12 18:30:00"
# The same instants in seconds since 2024-01-01.
FROM_S, TO_S = 4 * 86400 + 6 * 3600, 11 * 86400 + 18 * 3600 + 1800


def overlapped_days(t: Inputs):
    return heatmaps.updates_per_day(t.locations)


DAY_SQL = """daily AS (SELECT useruuid, id, unnest(range(s0 // 86400, greatest(s0 // 86400, (s1 * 1000000 - 1) // 86400000000) + 1)) AS d
 FROM loc WHERE s1 >= s0)"""

QUERIES = {
    "c1_accuracy": Query(lambda t: ids(cleaning.accurate(t.locations)),
                         sql(f"{ROWS} WHERE accuracy BETWEEN 0 AND 55000")),
    "c2_not_before": Query(lambda t: ids(cleaning.not_before(t.locations, "2024-01-08")),
                           sql(f"{ROWS} WHERE NOT (s0 < 604800 AND s1 < 604800)")),
    "c3_within": Query(lambda t: ids(cleaning.within(t.locations, FROM, TO)),
                       sql(f"{ROWS} WHERE s0 >= {FROM_S} AND s1 <= {TO_S}")),
    "c4_without_users": Query(lambda t: ids(cleaning.without_users(t.locations, t.blocklist)),
                              sql(f"{ROWS} WHERE useruuid % 50 >= 2")),
    "c5_clean": Query(lambda t: ids(cleaning.clean(t.locations, day="2024-01-08", blocklist=t.blocklist)),
                      sql(f"""{ROWS} WHERE useruuid % 50 >= 2 AND accuracy BETWEEN 0 AND 55000
 AND NOT (s0 < 604800 AND s1 < 604800)""")),
    "c6_outside_perimeters": Query(lambda t: ids(cleaning.outside(t.locations, t.perimeters)),
                                   sql("SELECT id, useruuid FROM away")),
    "c6_outside_any_perimeter": Query(
        lambda t: ids(cleaning.outside(t.locations, t.perimeters, by_country=False)),
        sql("""SELECT id, useruuid FROM loc b WHERE NOT EXISTS (SELECT 1 FROM perimeters q
 WHERE 2 * 6371008.8 * asin(sqrt(pow(sin(radians(q.lat - b.latitude) / 2), 2)
 + cos(radians(b.latitude)) * cos(radians(q.lat)) * pow(sin(radians(q.lng - b.longitude) / 2), 2))) <= 150)""")),
    "c7_country": Query(lambda t: ids(cleaning.in_country(t.locations, "Sweden")),
                        sql(f"{ROWS} WHERE country = 'Sweden'")),
    "c8_overlaps": Query(lambda t: ids(t.locations.filter(cleaning.overlaps(_time(FROM), _time(TO)))),
                         sql(f"""{ROWS} WHERE CASE WHEN s0 = s1 THEN s0 >= {FROM_S} AND s0 < {TO_S}
 ELSE s0 < {TO_S} AND s1 > {FROM_S} END""")),
    "c9_day_overlap": Query(overlapped_days, sql("""SELECT useruuid, strftime(DATE '2024-01-01' + CAST(d AS INTEGER), '%Y-%m-%d')
 AS day, count(*) AS rows FROM daily GROUP BY ALL""", DAY_SQL)),
    "c10_bins_inside": Query(lambda t: ids(t.binned.filter(cleaning.bins_inside(PERIODS[1]))),
                             sql("""SELECT id, useruuid FROM binned WHERE len(time_bins) > 0
 AND list_min(time_bins) >= 240 AND list_max(time_bins) < 480""")),
    "c11_period_cut": Query(lambda t: t.presence_in(2), sql("SELECT useruuid, spatial_bin, time_bin FROM p2")),
    "c12_plausible_people": Query(
        lambda t: cleaning.plausible_people(t.people).select("useruuid", "gender", "age"),
        sql("""SELECT useruuid, gender, CAST(age AS BIGINT) AS age FROM aged WHERE age > 16 AND age < 100
 AND birthdate NOT IN (DATE '1980-12-01', DATE '1981-01-01', DATE '1990-01-01')""")),
    "c13_missing_country": Query(lambda t: ids(t.locations.filter(cleaning.country_is_missing())),
                                 sql(f"{ROWS} WHERE coalesce(country, '') = ''")),
    "c14_selected_pairs": Query(
        lambda t: both_selected(dyads(t.met_by_pair), cross_occupancy(t.presence, PERIODS, 0.2)),
        sql("""SELECT DISTINCT user1, user2 FROM co WHERE user1 IN (SELECT useruuid FROM often)
 AND user2 IN (SELECT useruuid FROM often)""", """occ AS (SELECT useruuid, time_bin // 240 AS p,
 count(DISTINCT time_bin) AS n FROM pr WHERE time_bin BETWEEN 0 AND 719 GROUP BY ALL),
often AS (SELECT useruuid FROM occ GROUP BY 1 HAVING count(*) = 3 AND min(n) / 240.0 >= 0.2)""")),
    "c15_sessions_in_period": Query(
        lambda t: ids(cleaning.sessions_in_period(t.apps, CONFIG, PERIODS[1])),
        sql("""SELECT id, useruuid FROM apps WHERE floor(s0 / 3600.0) >= 240 AND floor(s1 / 3600.0) < 480""")),
    "c16_categories": Query(
        lambda t: t.apps.join(profiles.most_common(t.apps, "package_name", 5), "package_name", "left_semi")
        .select("id", "package_name"),
        sql("""SELECT id, package_name FROM apps WHERE package_name IN (SELECT package_name FROM apps
 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)""")),
    "c17_specific": Query(
        # The ratio to the distinct bins of the users can exceed any limit, as
        # in the measurements this filter was made for; scaled by 20 some do.
        lambda t: cleaning.specific(_specificity(t)),
        sql("""SELECT user1, user2, CAST(label AS BIGINT) AS label, round(spec, 6) + 0.0 AS specificity FROM (
 SELECT c.user1, c.user2, c.n >= 2 AS label, 20.0 * c.n / (a.b + b.b) AS spec
 FROM (SELECT user1, user2, count(*) AS n FROM c1 GROUP BY ALL) c
 JOIN bb a ON a.useruuid = c.user1 JOIN bb b ON b.useruuid = c.user2) WHERE NOT (label AND spec > 1)""",
            "bb AS (SELECT useruuid, count(DISTINCT time_bin) AS b FROM p1 GROUP BY 1)")),
    "c18_required_values": Query(
        lambda t: cleaning.matching(t.locations, {"country": "Japan", "name": "place 3"})
        .groupBy("useruuid").agg(F.count("*").alias("rows")),
        sql("SELECT useruuid, count(*) AS rows FROM loc WHERE country = 'Japan' AND place = 3 GROUP BY 1")),
    "c19_rows_of_user": Query(
        lambda t: cleaning.of_user(t.binned, 7, "Japan").select("id", "start_time", "end_time", "longitude", "latitude"),
        sql("""SELECT id, s0 + 1704067200 AS start_time, s1 + 1704067200 AS end_time,
 round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM loc WHERE useruuid = 7 AND country = 'Japan'""")),
}


def _specificity(t: Inputs):
    from tiescope.operators.pairing import attach_both
    from tiescope.operators.presence import user_activity
    people = t.presence_in(1)
    counted = edges(t.met_in(1)).withColumnRenamed("weight", "num_coocs")
    return attach_both(counted, user_activity(people)).select(
        "user1", "user2", (F.col("num_coocs") >= 2).cast("int").alias("label"),
        (features.specificity_of("bins") * 20).alias("specificity"))
