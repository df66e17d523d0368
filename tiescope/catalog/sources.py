"""Readers and writers: each query writes derived rows and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiescope import schemas
from tiescope.catalog.base import MET_SQL, Query, r6, sql
from tiescope.catalog.profiles import LABELLED_SQL, labelled
from tiescope.operators.features import CORE_FEATURES
from tiescope.plans.inputs import AS_OF, CONFIG, Inputs
from tiescope.plans.viewer import cooccurrence_points
from tiescope.session import register, scratch_path, stage
from tiescope.sources import readers, writers

RECORD_SQL = f"""SELECT CAST(id AS VARCHAR) AS id, CAST(useruuid AS VARCHAR) AS useruuid,
 s0 + 1704067200 AS start_time, s1 + 1704067200 AS end_time, country,
 {r6('latitude')} AS latitude, {r6('longitude')} AS longitude, altitude, accuracy FROM loc"""


def records(inputs: Inputs) -> DataFrame:
    """Derived locations in the form of the raw records."""
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    device = F.struct(F.lit("phone").alias("name"), F.lit("mobile").alias("type"),
                      F.col("useruuid").cast("string").alias("id"))
    return inputs.locations.select(
        F.unix_millis("end_time").alias("timestamp_seen"),
        F.col("id").cast("string").alias("id"), F.col("useruuid").cast("string").alias("useruuid"),
        F.date_format("start_time", iso).alias("start_time"), F.date_format("end_time", iso).alias("end_time"),
        "name", F.lit("").alias("area"), "country", F.lit("").alias("region"), "latitude", "longitude",
        "altitude", "accuracy", F.lit("WGS84").alias("datum"), F.array(device).alias("devices"))


def as_result(read: DataFrame) -> DataFrame:
    return readers.with_instants(read).select(
        "id", "useruuid", "start_time", "end_time", "country", "latitude", "longitude", "altitude", "accuracy")


def read_parquet(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "records")
    records(inputs).write.parquet(path)
    return as_result(readers.read_locations(inputs.spark, [f"{path}/*.parquet"]))


def read_json_arrays(inputs: Inputs) -> DataFrame:
    """Files with one JSON array each, 2,000 records per array."""
    path = scratch_path(inputs.spark, "arrays")
    rows = records(inputs)
    (rows.withColumn("file", F.floor(F.col("id").cast("bigint") / 2000))
     .groupBy("file").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
     .select("value").write.option("maxRecordsPerFile", 1).text(path))
    return as_result(readers.read_locations(inputs.spark, path, "json"))


def merge_json(inputs: Inputs) -> DataFrame:
    """A folder with one sub-folder per country and one extra file."""
    folder, extra = scratch_path(inputs.spark, "folder"), scratch_path(inputs.spark, "extra")
    merged = scratch_path(inputs.spark, "merged")
    rows = records(inputs)
    is_extra = F.col("country") == ""
    rows.filter(~is_extra).withColumn("part", F.col("country")).write.partitionBy("part").json(folder)
    rows.filter(is_extra).write.json(extra)
    readers.merge_json(inputs.spark, folder, schemas.LOCATION, [extra]).write.json(merged)
    return as_result(readers.read_locations(inputs.spark, merged, "jsonl"))


def convert(inputs: Inputs) -> DataFrame:
    source, target = scratch_path(inputs.spark, "source"), scratch_path(inputs.spark, "target")
    records(inputs).write.parquet(source)
    writers.convert(inputs.spark, source, "parquet", target, "json")
    return as_result(readers.read_locations(inputs.spark, target, "jsonl"))


def demographics(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "people")
    inputs.people.select("useruuid", "gender", F.date_format("birthdate", "yyyy-MM-dd")).write.csv(path)
    return readers.read_demographics(inputs.spark, path, AS_OF)


def insert(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "locations")
    writers.write_locations(inputs.locations, path, CONFIG)
    return inputs.spark.read.parquet(path).select("id", "useruuid", "country", "spatial_bin", "time_bins")


def libsvm(inputs: Inputs, files: int | None) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    path = scratch_path(inputs.spark, "libsvm")
    columns = list(CORE_FEATURES)
    writers.write_libsvm(labelled(inputs), columns, path, files=files)
    read = readers.read_libsvm(inputs.spark, path, len(columns))
    values = vector_to_array("features")
    return (read.select(F.col("label").cast("bigint").alias("label"),
                        *[values[index].alias(name) for index, name in enumerate(columns)])
            .withColumns({name: F.round(name, 6) for name in columns})
            .groupBy("label", *columns).agg(F.count("*").alias("rows")))


LIBSVM_SQL = sql("SELECT label, " + ", ".join(f"{r6(name)} AS {name}" for name in CORE_FEATURES)
                 + ", count(*) AS rows FROM lab GROUP BY ALL", LABELLED_SQL)


def missing(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "missing")
    writers.write_missing_country(inputs.locations, path)
    return inputs.spark.read.schema("id bigint, longitude double, latitude double").json(path)


def edge_list(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "edges")
    writers.write_edges(inputs.met_by_pair, path)
    read = inputs.spark.read.schema("user1 bigint, user2 bigint").option("sep", ";").csv(path)
    return read.groupBy("user1", "user2").agg(F.count("*").alias("rows"))


def geojson(inputs: Inputs) -> DataFrame:
    path = scratch_path(inputs.spark, "geojson")
    writers.write_geojson(cooccurrence_points(inputs.stored_binned, 7), path)
    text = inputs.spark.read.text(path)
    return (text.select(F.get_json_object("value", "$.geometry.type").alias("type"),
                        F.get_json_object("value", "$.properties.id2").cast("bigint").alias("useruuid"),
                        F.get_json_object("value", "$.geometry.coordinates[0]").cast("double").alias("longitude"),
                        F.get_json_object("value", "$.geometry.coordinates[1]").cast("double").alias("latitude"))
            .groupBy("type", "useruuid", F.round("longitude", 6).alias("longitude"),
                     F.round("latitude", 6).alias("latitude")).agg(F.count("*").alias("rows")))


def read_csv(inputs: Inputs) -> DataFrame:
    """The records as CSV, the devices as JSON in a cell."""
    path = scratch_path(inputs.spark, "csv")
    rows = records(inputs)
    (rows.withColumn("devices", F.to_json("devices")).write.option("header", True).option("escape", '"').csv(path))
    read = readers.read_locations(inputs.spark, path, "csv")
    return as_result(read.filter(F.col("devices")[0]["id"] == F.col("useruuid"))).withColumn(
        "country", F.coalesce("country", F.lit("")))


def read_apps(inputs: Inputs) -> DataFrame:
    """App sessions as JSON lines, with the arrival time."""
    path = scratch_path(inputs.spark, "apps")
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    (inputs.apps.select(F.unix_millis("end_time").alias("timestamp_seen"), F.col("id").cast("string").alias("id"),
                        F.col("useruuid").cast("string").alias("useruuid"), "package_name",
                        F.date_format("start_time", iso).alias("start_time"),
                        F.date_format("end_time", iso).alias("end_time")).write.json(path))
    return readers.with_instants(readers.read_app_usage(inputs.spark, path, "jsonl")).select(
        "id", "useruuid", "package_name", "start_time", "end_time", "seen_at")


def read_geocodes(inputs: Inputs) -> DataFrame:
    """Geocoder answers, a JSON array for each part of a country.

    Parts follow the map, about a degree wide, so a country with many places is many arrays.
    """
    path = scratch_path(inputs.spark, "geocodes")
    rows = inputs.geocodes.select("lat", "lng", "country", "motel")
    (rows.groupBy(F.coalesce("country", F.lit("")).alias("part"), F.floor("lat"), F.floor("lng"))
     .agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
     .select("value").write.option("maxRecordsPerFile", 1).text(path))
    return readers.read_geocodes(inputs.spark, path)


def malformed(inputs: Inputs) -> DataFrame:
    """Rows kept and rows set aside when every tenth start time is damaged."""
    path = scratch_path(inputs.spark, "damaged")
    damaged = F.when(F.col("id").cast("bigint") % 10 == 0, F.lit("not a time")).otherwise(F.col("start_time"))
    records(inputs).withColumn("start_time", damaged).write.json(path)
    read = readers.read_locations(inputs.spark, path, "jsonl")
    good = readers.with_instants(read).filter(F.col("start_time").isNotNull())
    return (good.agg(F.count("*").alias("rows")).withColumn("kind", F.lit("kept"))
            .unionByName(readers.rejected(read).agg(F.count("*").alias("rows")).withColumn("kind", F.lit("set aside"))))


def by_sql(inputs: Inputs) -> DataFrame:
    """Meetings of each country's users, in SQL over registered tables."""
    register({"presence": inputs.presence, "locations": inputs.locations})
    return inputs.spark.sql("""
        SELECT country, count(*) AS presences FROM presence
        JOIN (SELECT DISTINCT useruuid, country FROM locations) USING (useruuid) GROUP BY country""")


QUERIES = {
    "a1_read_locations": Query(read_parquet, sql(RECORD_SQL)),
    "a1_read_csv": Query(read_csv, sql(RECORD_SQL)),
    "a1_read_apps": Query(read_apps, sql(
        "SELECT CAST(id AS VARCHAR) AS id, CAST(useruuid AS VARCHAR) AS useruuid, package_name, s0 + 1704067200 AS start_time,"
        " s1 + 1704067200 AS end_time, s1 + 1704067200 AS seen_at FROM apps")),
    "a1_read_geocodes": Query(read_geocodes, sql(
        f"""SELECT DISTINCT {r6('latitude')} AS lat, {r6('longitude')} AS lng,
 CASE place % 3 WHEN 0 THEN 'Territorial waters of Gotland' WHEN 1 THEN 'RSA' END AS country,
 CASE WHEN place % 6 = 2 THEN 'Motel' END AS motel FROM loc""")),
    "a1_malformed": Query(malformed, sql(
        "SELECT CASE WHEN id % 10 = 0 THEN 'set aside' ELSE 'kept' END AS kind, count(*) AS rows FROM loc GROUP BY 1")),
    "m5_views": Query(by_sql, sql(
        "SELECT country, count(*) AS presences FROM pr JOIN (SELECT DISTINCT useruuid, country FROM loc) USING (useruuid) GROUP BY 1")),
    "a2_read_json_arrays": Query(read_json_arrays, sql(RECORD_SQL)),
    "a3_merge_json": Query(merge_json, sql(RECORD_SQL)),
    "a4_convert": Query(convert, sql(RECORD_SQL)),
    "a5_demographics": Query(demographics, sql(
        "SELECT CAST(useruuid AS VARCHAR) AS useruuid, gender, strftime(birthdate, '%Y-%m-%d') AS birthdate,"
        " CAST(age AS BIGINT) AS age FROM aged")),
    "a6_insert_location": Query(insert, sql(
        "SELECT id, useruuid, country, spatial_bin, array_to_string(time_bins, ',') AS time_bins FROM binned")),
    "a7_libsvm": Query(lambda t: libsvm(t, None), LIBSVM_SQL),
    "a8_intermediate": Query(lambda t: stage(t.met, "coocs"), sql(
        "SELECT user1, user2, spatial_bin, time_bin FROM co")),
    "a9_missing_rows": Query(missing, sql(
        f"SELECT id, {r6('longitude')} AS longitude, {r6('latitude')} AS latitude FROM loc WHERE country = ''")),
    "a10_edge_list": Query(edge_list, sql(
        "SELECT user1, user2, count(*) AS rows FROM co GROUP BY ALL")),
    "a11_geojson": Query(geojson, sql(
        f"SELECT 'Point' AS type, useruuid, {r6('longitude')} AS longitude, {r6('latitude')} AS latitude,"
        " count(*) AS rows FROM met GROUP BY ALL", MET_SQL)),
    "a12_merge_parts": Query(lambda t: libsvm(t, 1), LIBSVM_SQL),
}
