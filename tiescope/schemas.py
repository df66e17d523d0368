"""Explicit schemas of the input records (field names are fixed by the data)."""

from pyspark.sql import types as T

DEVICE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("id", T.StringType()),
])

LOCATION = T.StructType([
    T.StructField("timestamp_seen", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("useruuid", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("area", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude", T.IntegerType()),
    T.StructField("accuracy", T.IntegerType()),
    T.StructField("datum", T.StringType()),
    T.StructField("devices", T.ArrayType(DEVICE)),
])

APP_USAGE = T.StructType([
    T.StructField("timestamp_seen", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("deleted_time", T.StringType()),
    T.StructField("useruuid", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("package_name", T.StringType()),
    T.StructField("application_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("genre", T.StringType()),
    T.StructField("icon", T.StringType()),
    T.StructField("devices", T.ArrayType(DEVICE)),
])

DEMOGRAPHICS = T.StructType([
    T.StructField("useruuid", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("birthdate", T.StringType()),
])

GEOCODE = T.StructType([
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("country", T.StringType()),
    T.StructField("motel", T.StringType()),
])


def with_corrupt(schema: T.StructType) -> T.StructType:
    """``schema`` plus the column that keeps unreadable rows."""
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
