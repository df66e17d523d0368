"""Features of pairs, one query each, and the whole labelled table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tiescope.catalog.base import Query, r6, sql
from tiescope.catalog.joins import ENTROPY_SQL
from tiescope.catalog.sequences import TRAVEL_SQL
from tiescope.ml.models import _vectors
from tiescope.operators import features
from tiescope.operators.cleaning import plausible_people, sessions_in_period
from tiescope.operators.graph import edges
from tiescope.operators.pairing import attach_both, co_occurrences_by_pair, dyads
from tiescope.operators.presence import user_activity
from tiescope.plans.dataset import build_dataset
from tiescope.plans.inputs import CONFIG, PERIODS, Inputs

PAIR = ["user1", "user2"]

PARTS = f"""{ENTROPY_SQL},
{TRAVEL_SQL},
place AS (SELECT user1, user2, CAST(sum(n) AS BIGINT) AS num_coocs, count(*) AS unique_coocs,
   CAST(count(*) >= 2 AS BIGINT) AS two_unique, exp(-sum(n / tot * log2(n / tot))) AS diversity,
   exp(-sum(n / tot * ln(n / tot))) AS natural_diversity
   FROM (SELECT *, sum(n) OVER (PARTITION BY user1, user2) AS tot FROM (
     SELECT user1, user2, spatial_bin, count(*)::DOUBLE AS n FROM c1 GROUP BY ALL)) GROUP BY user1, user2),
flags AS (SELECT p.*, b.useruuid IS NULL AS arrived, n.useruuid IS NULL AS leaves FROM p1 p
   LEFT JOIN p1 b ON b.useruuid = p.useruuid AND b.spatial_bin = p.spatial_bin AND b.time_bin = p.time_bin - 1
   LEFT JOIN p1 n ON n.useruuid = p.useruuid AND n.spatial_bin = p.spatial_bin AND n.time_bin = p.time_bin + 1),
cell AS (SELECT spatial_bin, time_bin, count(*) AS people, count(*) FILTER (arrived) AS arrivals,
   count(*) FILTER (leaves) AS leavers FROM flags GROUP BY ALL),
ctx AS (SELECT c.*, l.people, exp(-e.h) AS calm,
   CASE WHEN a.arrived AND b.arrived THEN 1.0::DOUBLE / l.arrivals ELSE 0 END AS came,
   CASE WHEN a.leaves AND b.leaves THEN 1.0::DOUBLE / l.leavers ELSE 0 END AS went,
   CASE WHEN a.leaves AND b.leaves THEN 1.0::DOUBLE / greatest(coalesce(nx.arrivals, 0), 1) ELSE 0 END AS went_compat
   FROM c1 c JOIN cell l ON l.spatial_bin = c.spatial_bin AND l.time_bin = c.time_bin
   JOIN ent e ON e.spatial_bin = c.spatial_bin
   JOIN flags a ON a.useruuid = c.user1 AND a.spatial_bin = c.spatial_bin AND a.time_bin = c.time_bin
   JOIN flags b ON b.useruuid = c.user2 AND b.spatial_bin = c.spatial_bin AND b.time_bin = c.time_bin
   LEFT JOIN cell nx ON nx.spatial_bin = c.spatial_bin AND nx.time_bin = c.time_bin + 1),
crowd AS (SELECT user1, user2, avg(1.0::DOUBLE / (people - 1)) AS coocs_w, sum(calm) AS weighted_frequency,
   avg(came + went) AS arr_leav, avg(came + went_compat) AS arr_leav_compat FROM ctx GROUP BY user1, user2),
timed AS (SELECT user1, user2, count(*) FILTER (h >= 18) AS evenings,
   count(*) FILTER (d IN (6, 7) OR (d = 5 AND h >= 18)) AS weekends,
   count(*) FILTER (d = 6 AND h >= 18) AS saturday_nights FROM (
     SELECT *, hour(TIMESTAMP '2024-01-01' + to_hours(CAST(time_bin AS BIGINT) + 1)) AS h,
     isodow(TIMESTAMP '2024-01-01' + to_hours(CAST(time_bin AS BIGINT) + 1)) AS d FROM c1) GROUP BY user1, user2),
dy AS (SELECT DISTINCT user1, user2 FROM c1),
nb AS (SELECT user1 AS u, user2 AS v FROM dy UNION ALL SELECT user2, user1 FROM dy),
deg AS (SELECT u, count(*) AS d FROM nb GROUP BY 1),
shared AS (SELECT user1, user2, count(y.v) AS common FROM dy JOIN nb x ON x.u = user1
   LEFT JOIN nb y ON y.u = user2 AND y.v = x.v GROUP BY ALL),
mut AS (SELECT user1, user2, common, a.d AS d1, b.d AS d2, common / (a.d + b.d - common) AS mutual,
   (common + 2) / (a.d + b.d - common) AS closed FROM shared JOIN deg a ON a.u = user1 JOIN deg b ON b.u = user2),
used AS (SELECT useruuid, list(DISTINCT package_name) AS s FROM apps
   WHERE floor(s0 / 3600.0) >= 0 AND floor(s1 / 3600.0) < 240 GROUP BY 1),
jac AS (SELECT user1, user2, CASE WHEN n1 + n2 = 0 THEN 1.0 ELSE i / (n1 + n2 - i) END AS app_jaccard FROM (
   SELECT user1, user2, coalesce(len(a.s), 0) AS n1, coalesce(len(b.s), 0) AS n2,
   coalesce(len(list_intersect(a.s, b.s)), 0)::DOUBLE AS i
   FROM dy LEFT JOIN used a ON a.useruuid = user1 LEFT JOIN used b ON b.useruuid = user2)),
act AS (SELECT useruuid, count(*) AS presences, count(DISTINCT time_bin) AS bins FROM p1 GROUP BY 1),
spec AS (SELECT user1, user2, num_coocs / (a.presences + b.presences) AS specificity, num_coocs / (a.bins + b.bins) AS of_bins
   FROM place JOIN act a ON a.useruuid = user1 JOIN act b ON b.useruuid = user2),
known AS (SELECT * FROM aged WHERE age > 16 AND age < 100 AND birthdate NOT IN (DATE '1980-12-01', DATE '1981-01-01', DATE '1990-01-01')),
sim AS (SELECT user1, user2, a.age IS NULL OR b.age IS NULL AS unk, abs(a.age - b.age) <= 6 AS near,
   a.gender IS NOT DISTINCT FROM b.gender AS same, a.useruuid IS NULL OR b.useruuid IS NULL AS absent
   FROM dy LEFT JOIN known a ON a.useruuid = user1 LEFT JOIN known b ON b.useruuid = user2),
similar_ AS (SELECT user1, user2, CAST(NOT unk AND NOT near AS BIGINT) AS age_far, CAST(NOT unk AND near AS BIGINT) AS age_near,
   CAST(unk AS BIGINT) AS age_unknown, CAST(NOT absent AND NOT same AS BIGINT) AS gender_differs,
   CAST(NOT absent AND same AS BIGINT) AS gender_same, CAST(absent AS BIGINT) AS gender_unknown FROM sim),
met_again AS (SELECT DISTINCT user1, user2, 1 AS m FROM c2),
full_ AS (SELECT * FROM place JOIN crowd USING (user1, user2) JOIN timed USING (user1, user2) JOIN travels USING (user1, user2)
   JOIN mut USING (user1, user2) JOIN jac USING (user1, user2) JOIN spec USING (user1, user2) JOIN similar_ USING (user1, user2)
   LEFT JOIN met_again USING (user1, user2))"""



def parts(first: int) -> str:
    """PARTS for the pairs of another period and the labels of the one after it."""
    moved = re.sub(r"\bc2\b", f"c{first + 1}", PARTS)
    moved = re.sub(r"\b([cp])1\b", rf"\g<1>{first}", moved)
    return moved.replace(">= 0 AND floor(s1 / 3600.0) < 240",
                         f">= {240 * (first - 1)} AND floor(s1 / 3600.0) < {240 * first}")


DOUBLES = {"arr_leav", "diversity", "weighted_frequency", "coocs_w", "mutual", "app_jaccard", "specificity"}
ALL_SQL = ", ".join(f"{r6(name)} AS {name}" if name in DOUBLES else name for name in features.FEATURES)


def part(table: str, *columns: str) -> str:
    chosen = ", ".join(f"{r6(name.split(':')[0])} AS {name.split(':')[-1]}" if name.split(":")[0] in DOUBLES | {
        "natural_diversity", "closed", "of_bins", "arr_leav_compat"} else name for name in columns)
    return sql(f"SELECT user1, user2, {chosen} FROM {table}", PARTS)


def period_one(t: Inputs):
    return t.stored_in(1)


def plain(t: Inputs):
    return t.met_in(1)


def crowd(name: str):
    return lambda t: features.crowd_features(features.context_coocs(period_one(t))).select(*PAIR, name)


def places(name: str):
    return lambda t: features.place_features(plain(t)).select(*PAIR, name)


def times(name: str):
    return lambda t: features.time_features(plain(t), CONFIG).select(*PAIR, name)


def similarity(t: Inputs):
    known = plausible_people(t.people).select("useruuid", "age", "gender", F.lit(True).alias("listed"))
    return attach_both(dyads(plain(t)), known).withColumns(features.similarity_columns())


def app_jaccard(t: Inputs):
    sets = features.app_sets(sessions_in_period(t.apps, CONFIG, PERIODS[0]))
    return attach_both(dyads(plain(t)), sets).select(*PAIR, features.app_jaccard_of().alias("app_jaccard"))


def specificity(activity: str):
    def build(t: Inputs):
        people = period_one(t)
        counted = edges(co_occurrences_by_pair(people, placed=True)).withColumnRenamed("weight", "num_coocs")
        return attach_both(counted, user_activity(people)).select(
            *PAIR, features.specificity_of(activity).alias("specificity"))
    return build


def dataset(t: Inputs, half: int, share: float | None):
    """Train (0) or test (1) set, of all users or of those seen in a share of the bins."""
    return build_dataset(t.locations, CONFIG, PERIODS, t.apps, t.people, share=share, halves=[half])[0]


OFTEN_SQL = """
occ AS (SELECT useruuid, time_bin // 240 AS p, count(DISTINCT time_bin) AS n FROM pr WHERE time_bin BETWEEN 0 AND 719 GROUP BY ALL),
often AS (SELECT useruuid FROM occ GROUP BY 1 HAVING count(*) = 3 AND min(n) / 240.0 >= 0.2)"""


def dataset_sql(half: int, filtered: bool) -> str:
    often = " WHERE user1 IN (SELECT useruuid FROM often) AND user2 IN (SELECT useruuid FROM often)" if filtered else ""
    return sql(f"SELECT user1, user2, {ALL_SQL}, saturday_nights, CAST(coalesce(m, 0) AS BIGINT) AS label FROM full_{often}",
               f"{parts(half + 1)},{OFTEN_SQL}")


def whole_table(t: Inputs):
    return features.labelled_features(t.stored, CONFIG, PERIODS[0], PERIODS[1],
                                      apps=t.apps, demographics=t.people)


def core_table(t: Inputs):
    table = whole_table(t).select(*PAIR, "label", *features.CORE_FEATURES)
    from pyspark.ml.functions import vector_to_array
    vector = _vectors(features.CORE_FEATURES, False)[0].transform(table)
    values = vector_to_array("features")
    return vector.select(*PAIR, "label", *[values[index].alias(name)
                                           for index, name in enumerate(features.CORE_FEATURES)])


def basic_features(t: Inputs):
    return features.place_features(t.met_by_pair)


QUERIES = {
    "i_basic_features": Query(basic_features, sql(
        f"""SELECT user1, user2, CAST(sum(n) AS BIGINT) AS num_coocs, count(*) AS unique_coocs,
 CAST(count(*) >= 2 AS BIGINT) AS two_unique, {r6('exp(log2(sum(n)) - sum(n * log2(n)) / sum(n))')} AS diversity
 FROM (SELECT user1, user2, spatial_bin, count(*)::DOUBLE AS n FROM co GROUP BY ALL) GROUP BY user1, user2""")),
    "i0_two_unique": Query(places("two_unique"), part("place", "two_unique")),
    "i1_arr_leav": Query(crowd("arr_leav"), part("crowd", "arr_leav")),
    "i1_arr_leav_compat": Query(
        lambda t: features.crowd_features(features.context_coocs(period_one(t), ref_compat=True)).select(*PAIR, "arr_leav"),
        part("crowd", "arr_leav_compat:arr_leav")),
    "i2_diversity": Query(places("diversity"), part("place", "diversity")),
    "i2_diversity_natural": Query(
        lambda t: features.place_features(plain(t), "e").select(*PAIR, "diversity"),
        part("place", "natural_diversity:diversity")),
    "i3_unique_coocs": Query(places("unique_coocs"), part("place", "unique_coocs")),
    "i4_weighted_frequency": Query(crowd("weighted_frequency"), part("crowd", "weighted_frequency")),
    "i5_coocs_w": Query(crowd("coocs_w"), part("crowd", "coocs_w")),
    "i6_common_travels": Query(lambda t: features.common_travels(plain(t)), part("travels", "common_travels")),
    "i7_num_coocs": Query(places("num_coocs"), part("place", "num_coocs")),
    "i8_mutual": Query(lambda t: features.mutual(dyads(plain(t))).select(*PAIR, "mutual"), part("mut", "mutual")),
    "i8_mutual_closed": Query(lambda t: features.mutual(dyads(plain(t)), closed=True).select(*PAIR, "mutual"),
                              part("mut", "closed:mutual")),
    "i9_app_jaccard": Query(app_jaccard, part("jac", "app_jaccard")),
    "i10_evenings": Query(times("evenings"), part("timed", "evenings")),
    "i11_weekends": Query(times("weekends"), part("timed", "weekends")),
    "i12_specificity": Query(specificity("presences"), part("spec", "specificity")),
    "i12_specificity_of_bins": Query(specificity("bins"), part("spec", "of_bins:specificity")),
    "i13_within_6_years": Query(lambda t: similarity(t).select(*PAIR, "age_far", "age_near", "age_unknown"),
                                part("similar_", "age_far", "age_near", "age_unknown")),
    "i16_same_gender": Query(lambda t: similarity(t).select(*PAIR, "gender_differs", "gender_same", "gender_unknown"),
                             part("similar_", "gender_differs", "gender_same", "gender_unknown")),
    "i19_saturday_nights": Query(times("saturday_nights"), part("timed", "saturday_nights")),
    "i20_features": Query(whole_table, sql(
        f"SELECT user1, user2, {ALL_SQL}, saturday_nights, CAST(coalesce(m, 0) AS BIGINT) AS label FROM full_", PARTS)),
    "i21_core_features": Query(core_table, sql(
        "SELECT user1, user2, CAST(coalesce(m, 0) AS BIGINT) AS label, "
        + ", ".join(f"{r6(name)} AS {name}" for name in features.CORE_FEATURES) + " FROM full_", PARTS)),
    "i22_feature_subset": Query(lambda t: features.select_features(whole_table(t), [7, 3, 2, "mutual"]), sql(
        f"""SELECT user1, user2, CAST(coalesce(m, 0) AS BIGINT) AS label, num_coocs, unique_coocs, {r6('diversity')} AS diversity,
 {r6('mutual')} AS mutual FROM full_""", PARTS)),
    "k11_build_dataset": Query(lambda t: dataset(t, 0, 0.2), dataset_sql(0, True)),
    "k11_test_set": Query(lambda t: dataset(t, 1, 0.2), dataset_sql(1, True)),
    "k11_all_train": Query(lambda t: dataset(t, 0, None), dataset_sql(0, False)),
    "k11_all_test": Query(lambda t: dataset(t, 1, None), dataset_sql(1, False)),
}
