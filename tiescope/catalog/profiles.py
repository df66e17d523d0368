"""Aggregations, distributions and heat maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiescope.catalog.base import Query, r6, sql
from tiescope.catalog.binning import SLOT_SQL
from tiescope.catalog.cleaning import DAY_SQL
from tiescope.catalog.features import PARTS
from tiescope.catalog.joins import ENTROPY_SQL
from tiescope.config import Period
from tiescope.operators import cohorts, heatmaps, presence, profiles
from tiescope.operators.cleaning import accurate, in_country
from tiescope.operators.features import CORE_FEATURES, cell_visits
from tiescope.plans.dataset import build_dataset
from tiescope.plans.inputs import CONFIG, DAYS, FIRST_DAY, LAST_DAY, PERIODS, Inputs
from tiescope.session import scratch_path
from tiescope.sources.readers import file_extent, input_folder

QUANTILE_SQL = ", ".join(f"{r6(f'quantile_cont(v, {p})')} AS q{round(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0))
SUMMARY_SQL = f"count(*) AS rows, {QUANTILE_SQL}, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS std"
SWEDEN = "(SELECT * FROM loc WHERE country = 'Sweden')"


def labelled(t: Inputs):
    """Pairs of the first period with the nine features and whether they met in the second."""
    return build_dataset(t.locations, CONFIG, PERIODS, halves=[0])[0].select("user1", "user2", "label", *CORE_FEATURES)


LABELLED_SQL = f"{PARTS},\nlab AS (SELECT *, CAST(coalesce(m, 0) AS BIGINT) AS label FROM full_)"


def boxes(t: Inputs):
    return profiles.boxplot(profiles.rows_per_user(t.locations), "rows", "country")


BOX_SQL = """rpu AS (SELECT country, useruuid, count(*) AS n FROM loc GROUP BY ALL),
cut AS (SELECT country, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75
        FROM rpu GROUP BY 1),
fen AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM cut)"""

SHARE_SQL = """cnt AS (SELECT package_name, count(*) AS rows FROM apps GROUP BY 1),
acc AS (SELECT *, rows / sum(rows) OVER () AS share, sum(rows) OVER (ORDER BY rows DESC, package_name) / sum(rows) OVER () AS cdf
        FROM cnt)"""


def package_counts(t: Inputs):
    return t.apps.groupBy("package_name").agg(F.count("*").alias("rows"))


def by_day_files(t: Inputs):
    """Locations written with one folder and file a day, and read again."""
    path = scratch_path(t.spark, "days")
    (t.locations.withColumn("day", F.date_format("start_time", "yyyy-MM-dd")).repartition("day")
     .write.partitionBy("day").parquet(path))
    return t.spark.read.parquet(path)


def counts_by_file(t: Inputs, order: str):
    counted = profiles.value_counts(by_day_files(t), F.col("name"), input_folder())
    return profiles.sorted_counts(counted, order)


def counts_sql(order: str) -> str:
    return sql(f"""SELECT 'day=' || source AS source, value, rows, row_number() OVER (PARTITION BY source ORDER BY {order}) AS place,
 {r6('max(rows) OVER (PARTITION BY source) / sum(rows) OVER (PARTITION BY source)')} AS top_share FROM vc""", VALUE_SQL)


VALUE_SQL = """vc AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS source, 'place ' || (k % 20) AS value, count(*) AS rows
  FROM ev GROUP BY ALL)"""


def hex_sql(size: float) -> str:
    """Hexagon of a point: rounding of three coordinates that sum to 0."""
    return f"""hx AS (SELECT id, (longitude * {3 ** 0.5 / 3!r}::DOUBLE - latitude / 3) / {size!r}::DOUBLE AS q,
  latitude * {2 / 3!r}::DOUBLE / {size!r}::DOUBLE AS r FROM loc),
hr AS (SELECT *, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM hx),
ho AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM hr),
hex AS (SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q,
  CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM ho)"""


def pairs_at_perimeters_sql(source: str) -> str:
    return f"""(SELECT country, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS c FROM (SELECT country, spatial_bin, time_bin, count(*) AS n
 FROM (SELECT DISTINCT country, useruuid, spatial_bin, unnest(time_bins) AS time_bin FROM {source}) GROUP BY ALL)
 WHERE n > 1 GROUP BY 1)"""


def per_bin_sql(source: str) -> str:
    return f"""(SELECT time_bin, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS c FROM (SELECT spatial_bin, time_bin, count(*) AS n
 FROM (SELECT DISTINCT useruuid, spatial_bin, unnest(time_bins) AS time_bin FROM {source}) GROUP BY ALL)
 WHERE n > 1 GROUP BY 1)"""


def calendar_sql() -> str:
    weeks = ", ".join(
        f"coalesce(max(CASE WHEN week = {w} THEN round(mean, 6) + 0.0 END), -1.0) AS week{w}" for w in range(1, 7))
    return sql(f"""SELECT month, weekday, {weeks} FROM (
 SELECT strftime(dt, '%Y-%m') AS month, isodow(dt) - 1 AS weekday,
 (day(dt) + isodow(date_trunc('month', dt)) - 2) // 7 + 1 AS week,
 coalesce(n, 0) / (SELECT count(DISTINCT useruuid) FROM {SWEDEN}) AS mean
 FROM (SELECT d, DATE '2024-01-01' + CAST(d AS INTEGER) AS dt FROM days)
 LEFT JOIN (SELECT d, count(*) AS n FROM daily WHERE id IN (SELECT id FROM {SWEDEN}) GROUP BY 1) USING (d)) GROUP BY ALL""", DAY_SQL)


CLOCK_SQL = """slotted AS (SELECT useruuid, unnest(range(s0 // 3600, greatest(s0 // 3600, (s1 * 1000000 - 1) // 3600000000) + 1)) AS h
  FROM loc WHERE s1 >= s0)"""

UPDATE_MONTH_SQL = """SELECT country, month, n AS rows, round(n / users, 6) + 0.0 AS mean_updates FROM
 (SELECT country, strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(s0 AS BIGINT)), '%Y-%m') AS month, count(*) AS n FROM loc GROUP BY ALL)
 JOIN (SELECT country, count(DISTINCT useruuid) AS users FROM loc GROUP BY 1) USING (country)"""


def feature_summary_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT label, '{name}' AS feature, CAST({name} AS DOUBLE) AS v FROM lab"
                               for name in CORE_FEATURES)
    return sql(f"SELECT label, feature, {SUMMARY_SQL} FROM ({parts}) GROUP BY ALL", LABELLED_SQL)


QUERIES = {
    "e1_histogram": Query(lambda t: profiles.histogram(t.locations, "altitude", 20), sql(
        """SELECT i AS bucket, CASE WHEN i = 19 THEN CAST(i * step AS VARCHAR) || '<'
 ELSE CAST(i * step AS VARCHAR) || '-' || CAST((i + 1) * step AS VARCHAR) END AS label, count(altitude) AS rows
 FROM (SELECT CAST(range AS BIGINT) AS i FROM range(20)) CROSS JOIN (SELECT max(altitude) // 20 AS step FROM loc)
 LEFT JOIN loc ON altitude >= 0 AND least(altitude // step, 19) = i GROUP BY i, step""")),
    "e2_categories": Query(lambda t: profiles.categories(t.locations, "country"), sql(
        "SELECT country, count(*) AS rows FROM loc GROUP BY 1")),
    "e3_duration_by_country": Query(lambda t: profiles.mean_duration(t.locations, "country"), sql(
        "SELECT country, round(avg(s1 - s0), 2) AS seconds, count(*) AS rows FROM loc WHERE country <> '' GROUP BY 1")),
    "e3_duration_by_user": Query(
        lambda t: profiles.mean_duration(in_country(t.locations, "Sweden"), "useruuid"),
        sql(f"SELECT useruuid, round(avg(s1 - s0), 2) AS seconds, count(*) AS rows FROM {SWEDEN} GROUP BY 1")),
    "e4_distinct": Query(lambda t: t.locations.select("useruuid").distinct(), sql("SELECT DISTINCT useruuid FROM loc")),
    "e5_start_range": Query(lambda t: profiles.start_range(t.locations, "Japan"), sql(
        """SELECT min(s0) + 1704067200 AS first_start, max(s0) + 1704067200 AS last_start FROM loc WHERE country = 'Japan'""")),
    "e6_records_in_cell": Query(
        lambda t: profiles.records_in_cell(t.binned, t.binned.agg(F.min("spatial_bin")).scalar(), 7)
        .withColumnRenamed("rows", "of_user")
        .withColumn("all_users", profiles.records_in_cell(
            t.binned, t.binned.agg(F.min("spatial_bin")).scalar()).scalar()),
        sql("""SELECT count(*) FILTER (useruuid = 7) AS of_user, count(*) AS all_users FROM binned
 WHERE spatial_bin = (SELECT min(spatial_bin) FROM binned)""")),
    "e7_rows_per_user": Query(lambda t: profiles.rows_per_user(t.locations), sql(
        "SELECT country, useruuid, count(*) AS rows FROM loc GROUP BY ALL")),
    "e8_accuracy_summary": Query(lambda t: profiles.summary(accurate(t.locations), "accuracy"), sql(
        f"SELECT {SUMMARY_SQL} FROM (SELECT accuracy AS v FROM loc WHERE accuracy BETWEEN 0 AND 55000)")),
    "e8_updates_summary": Query(lambda t: profiles.summary(profiles.rows_per_user(t.locations), "rows", ["country"]), sql(
        f"SELECT country, {SUMMARY_SQL} FROM (SELECT country, useruuid, count(*) AS v FROM loc GROUP BY ALL) GROUP BY 1")),
    "e9_boxplot": Query(boxes, sql(
        f"""SELECT country, {r6('any_value(q25)')} AS q25, {r6('any_value(q50)')} AS q50, {r6('any_value(q75)')} AS q75,
 min(n) FILTER (n BETWEEN lo AND hi) AS whisker_low, max(n) FILTER (n BETWEEN lo AND hi) AS whisker_high,
 count(*) FILTER (n NOT BETWEEN lo AND hi) AS outliers FROM rpu JOIN fen USING (country) GROUP BY 1""", BOX_SQL)),
    "e9_outliers": Query(lambda t: profiles.outliers(profiles.rows_per_user(t.locations), "rows", "country", k=0.5), sql(
        "SELECT country, useruuid, n AS rows FROM rpu JOIN fen USING (country) WHERE n NOT BETWEEN lo AND hi",
        BOX_SQL.replace("1.5", "0.5"))),
    "e10_updates_cdf": Query(lambda t: profiles.updates_cdf(t.locations), sql(
        f"""SELECT country, n AS rows, users, {r6('sum(users) OVER (PARTITION BY country ORDER BY n) / sum(users) OVER (PARTITION BY country)')} AS cdf
 FROM (SELECT country, n, count(*) AS users FROM (SELECT country, useruuid, count(*) AS n FROM loc GROUP BY ALL) GROUP BY ALL)""")),
    "e11_shares": Query(lambda t: profiles.shares(package_counts(t), "package_name"), sql(
        f"SELECT package_name, rows, {r6('share')} AS share, {r6('cdf')} AS cdf FROM acc", SHARE_SQL)),
    "e11_coverage": Query(lambda t: profiles.coverage(package_counts(t), "package_name", 0.8).select("package_name", "rows"), sql(
        "SELECT package_name, rows FROM acc WHERE cdf - share < 0.8", SHARE_SQL)),
    "e12_value_counts": Query(lambda t: counts_by_file(t, "desc"), counts_sql("rows DESC, value DESC")),
    "e12_counts_ascending": Query(lambda t: counts_by_file(t, "asc"), counts_sql("rows, value")),
    "e12_counts_by_value": Query(lambda t: counts_by_file(t, "value"), counts_sql("value")),
    "e13_updates_per_month": Query(lambda t: profiles.mean_updates_per_month(t.locations), sql(UPDATE_MONTH_SQL)),
    "e14_hourly_profile": Query(lambda t: profiles.hourly_profile(
        t.locations, profiles.local_hour({"Japan": "Asia/Tokyo", "Sweden": "Europe/Stockholm"})), sql(
        f"""SELECT country, hour, n AS rows, {r6('n / users')} AS per_user FROM (SELECT country,
 ((s0 // 3600) + CASE country WHEN 'Japan' THEN 9 WHEN 'Sweden' THEN 1 ELSE 0 END) % 24 AS hour, count(*) AS n
 FROM loc GROUP BY ALL) JOIN (SELECT country, count(DISTINCT useruuid) AS users FROM loc GROUP BY 1) USING (country)""")),
    "e15_calendar": Query(lambda t: heatmaps.calendar(in_country(t.locations, "Sweden"), FIRST_DAY, LAST_DAY), calendar_sql()),
    "e16_user_days": Query(lambda t: heatmaps.user_days(t.locations, FIRST_DAY, LAST_DAY, counts=True), sql(
        """SELECT useruuid, day, coalesce(n, 0) AS value FROM (SELECT DISTINCT useruuid FROM loc) CROSS JOIN days
 LEFT JOIN (SELECT useruuid, d, count(*) AS n FROM daily GROUP BY ALL) USING (useruuid, d)""", DAY_SQL)),
    "e16_user_days_wide": Query(lambda t: heatmaps.wide_user_days(
        heatmaps.user_days(t.locations, FIRST_DAY, LAST_DAY), [f"2024-01-{d:02d}" for d in range(1, DAYS + 1)]), sql(
        "SELECT useruuid, " + ", ".join(f"CAST(count(*) FILTER (d = {d}) > 0 AS BIGINT) AS \"2024-01-{d + 1:02d}\"" for d in range(DAYS))
        + " FROM daily GROUP BY 1", DAY_SQL)),
    "e17_user_clock": Query(lambda t: heatmaps.user_clock(t.locations, FIRST_DAY, LAST_DAY, counts=True), sql(
        "SELECT useruuid, h % 24 AS slot, count(*) AS value FROM slotted WHERE h < 720 GROUP BY ALL", CLOCK_SQL)),
    "e17_user_clock_days": Query(lambda t: heatmaps.user_clock(t.locations, FIRST_DAY, LAST_DAY), sql(
        "SELECT useruuid, h % 24 AS slot, count(DISTINCT h) AS value FROM slotted WHERE h < 720 GROUP BY ALL", CLOCK_SQL)),
    "e18_rows_at_perimeters": Query(lambda t: profiles.rows_at_perimeters(t.locations, t.perimeters), sql(
        """SELECT country, count(*) AS total, count(*) FILTER (id IN (SELECT id FROM away)) AS away FROM loc GROUP BY 1""")),
    "e19_coocs_at_perimeters": Query(lambda t: profiles.coocs_at_perimeters(t.locations, t.perimeters, CONFIG), sql(
        f"""SELECT country, a.c AS total, coalesce(b.c, 0) AS away FROM {pairs_at_perimeters_sql('binned')} a
 LEFT JOIN {pairs_at_perimeters_sql('away')} b USING (country)""")),
    "e20_coocs_per_bin": Query(lambda t: profiles.coocs_per_bin(t.locations, t.perimeters, CONFIG), sql(
        f"""SELECT strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(time_bin AS BIGINT)), '%Y-%m') AS month, time_bin, a.c AS total,
 coalesce(b.c, 0) AS away FROM {per_bin_sql('binned')} a LEFT JOIN {per_bin_sql('away')} b USING (time_bin)""")),
    "e21_pair_per_day": Query(lambda t: profiles.pair_per_day(t.presence, 12, 16, CONFIG, FIRST_DAY, LAST_DAY), sql(
        """SELECT day, count(time_bin) AS coocs FROM days LEFT JOIN co ON user1 = 12 AND user2 = 16 AND time_bin // 24 = d GROUP BY 1""")),
    "e22_updates_by_period": Query(lambda t: cohorts.updates_by_period(t.presence, PERIODS), sql(
        """SELECT useruuid, a AS rows1, b AS rows2, c AS rows3, CAST(a = 0 AS BIGINT) + CAST(b = 0 AS BIGINT) + CAST(c = 0 AS BIGINT)
 AS empty_periods FROM (SELECT useruuid, count(*) FILTER (time_bin BETWEEN 0 AND 239) AS a,
 count(*) FILTER (time_bin BETWEEN 240 AND 479) AS b, count(*) FILTER (time_bin BETWEEN 480 AND 719) AS c FROM pr GROUP BY 1)""")),
    "e22_users_by_empty_days": Query(
        lambda t: cohorts.users_by_empty_periods(t.presence, [Period(day * 24, day * 24 + 24) for day in range(DAYS)]), sql(
        """SELECT 30 - n AS empty_periods, count(*) AS users FROM (SELECT useruuid,
 count(DISTINCT CASE WHEN time_bin BETWEEN 0 AND 719 THEN time_bin // 24 END) AS n FROM pr GROUP BY 1) GROUP BY 1""")),
    "e23_app_clock": Query(lambda t: profiles.app_clock(t.apps, 15), sql(
        f"""SELECT package_name, slot, count(*) AS uses, {r6('count(*) / sum(count(*)) OVER (PARTITION BY package_name)')} AS share
 FROM slots GROUP BY package_name, slot""", SLOT_SQL)),
    "e23_app_clock_weekday": Query(lambda t: profiles.app_clock(t.apps, 15, by_weekday=True), sql(
        f"""SELECT package_name, weekday, slot, count(*) AS uses,
 {r6('count(*) / sum(count(*)) OVER (PARTITION BY package_name, weekday)')} AS share
 FROM (SELECT *, (s0 // 86400) % 7 AS weekday FROM slots) GROUP BY package_name, weekday, slot""", SLOT_SQL)),
    "e24_ages": Query(lambda t: profiles.categories(t.people, "age"), sql(
        "SELECT CAST(age AS BIGINT) AS age, count(*) AS rows FROM aged GROUP BY 1")),
    "e24_common_birthdates": Query(lambda t: profiles.most_common(t.people, "birthdate", 20), sql(
        """SELECT strftime(birthdate, '%Y-%m-%d') AS birthdate, count(*) AS rows FROM people GROUP BY people.birthdate
 ORDER BY count(*) DESC, people.birthdate LIMIT 20""")),
    "e25_cell_population": Query(lambda t: presence.cell_population(t.presence), sql(
        "SELECT spatial_bin, time_bin, count(*) AS people FROM pr GROUP BY ALL")),
    "e26_activity_by_period": Query(lambda t: presence.activity_by_period(t.presence, PERIODS), sql(
        """SELECT time_bin // 240 + 1 AS period, useruuid, count(*) AS presences, count(DISTINCT time_bin) AS bins
 FROM pr WHERE time_bin BETWEEN 0 AND 719 GROUP BY ALL""")),
    "e27_location_entropy": Query(lambda t: presence.location_entropy(t.presence_in(1)), sql(
        f"SELECT spatial_bin, {r6('h')} AS entropy FROM ent", ENTROPY_SQL)),
    "e28_class_counts": Query(lambda t: profiles.class_counts(labelled(t)), sql(
        "SELECT label, count(*) AS rows FROM lab GROUP BY 1", LABELLED_SQL)),
    "e29_feature_summary": Query(
        lambda t: profiles.feature_summary(labelled(t), list(CORE_FEATURES)), feature_summary_sql()),
    "e30_density": Query(lambda t: profiles.density(t.locations, 2), sql(
        f"""SELECT CAST(floor((latitude + 90.0) * 100.0) AS BIGINT) * 36000 + CAST(floor((longitude + 180.0) * 100.0) AS BIGINT) AS cell,
 count(*) AS rows, {r6('log10(count(*))')} AS log_rows FROM loc GROUP BY 1""")),
    "e30_hex_density": Query(lambda t: profiles.hex_density(t.locations, 0.0011), sql(
        f"SELECT q, r, count(*) AS rows, {r6('log10(count(*))')} AS log_rows FROM hex GROUP BY ALL", hex_sql(0.0011))),
    "e31_row_count": Query(lambda t: accurate(in_country(t.locations, "Sweden")).agg(F.count("*").alias("rows")), sql(
        f"SELECT count(*) AS rows FROM {SWEDEN} WHERE accuracy BETWEEN 0 AND 55000")),
    "e32_occupancy": Query(lambda t: cohorts.occupancy(t.presence, PERIODS), sql(
        f"""SELECT useruuid, time_bin // 240 + 1 AS period, count(DISTINCT time_bin) AS bins,
 {r6('count(DISTINCT time_bin) / 240.0')} AS occupancy FROM pr WHERE time_bin BETWEEN 0 AND 719 GROUP BY ALL""")),
    "e33_file_extent": Query(lambda t: file_extent(by_day_files(t), "folder"), sql(
        """SELECT 'day=' || strftime(CAST(ts AS DATE), '%Y-%m-%d') AS folder, min(s0) + 1704067200 AS first_start,
 max(s0 + (event_id % 180 + 5) * 60) + 1704067200 AS last_end FROM ev GROUP BY 1""")),
    "i_cell_visits": Query(lambda t: cell_visits(t.met_by_pair).drop("task"), sql(
        "SELECT user1, user2, spatial_bin, count(*) AS visits FROM co GROUP BY ALL")),
}
