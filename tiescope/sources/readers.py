"""Readers for location, app-usage, demographic and feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiescope import schemas
from tiescope.functions.calendar import age


def read_records(spark: SparkSession, paths: str | list[str], schema: T.StructType,
                 fmt: str = "parquet") -> DataFrame:
    """Records of one kind from files, folders or globs.

    ``json`` reads files that hold one array of records, ``jsonl`` one record
    per line, ``avro`` needs the spark-avro package on the classpath. JSON and
    CSV rows that do not fit the schema are kept in ``_corrupt_record``.
    """
    reader = spark.read
    if fmt in ("json", "jsonl", "csv"):
        reader = (reader.schema(schemas.with_corrupt(schema))
                  .option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", "_corrupt_record"))
        if fmt == "json":
            return reader.option("multiLine", True).json(paths)
        if fmt == "jsonl":
            return reader.json(paths)
        return _from_csv(spark, paths, schema)
    return reader.schema(schema).format(fmt).load(paths)


def _from_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV rows with a header; arrays and structs stand in a cell as JSON."""
    nested = [f for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
    flat = T.StructType([T.StructField(f.name, T.StringType() if f in nested else f.dataType) for f in schema.fields])
    read = (spark.read.schema(schemas.with_corrupt(flat)).option("mode", "PERMISSIVE").option("header", True)
            .option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt_record").csv(paths))
    return read.withColumns({f.name: F.from_json(f.name, f.dataType) for f in nested})


def rejected(records: DataFrame) -> DataFrame:
    """Rows that don't fit the schema, or whose times can't be read: to be counted and kept aside."""
    unread = F.lit(False)
    for name in ("start_time", "end_time"):
        if name in records.columns and dict(records.dtypes)[name] == "string":
            unread = unread | (F.col(name).isNotNull() & F.try_to_timestamp(name).isNull())
    if "_corrupt_record" in records.columns:
        unread = unread | F.col("_corrupt_record").isNotNull()
    return records.filter(unread)


def read_locations(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    return read_records(spark, paths, schemas.LOCATION, fmt)


def read_app_usage(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    return read_records(spark, paths, schemas.APP_USAGE, fmt)


def with_instants(records: DataFrame) -> DataFrame:
    """ISO-8601 texts to timestamps (null if malformed, see ``rejected``) and the arrival time."""
    return records.withColumns({
        "start_time": F.try_to_timestamp("start_time"),
        "end_time": F.try_to_timestamp("end_time"),
        "seen_at": F.timestamp_millis(F.col("timestamp_seen")),
    })


def merge_json(spark: SparkSession, folder: str, schema: T.StructType,
               extra: list[str] | None = None) -> DataFrame:
    """All JSON-lines files of a folder, and of its sub-folders, plus extra files."""
    merged = (spark.read.schema(schema).option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.json").json(folder))
    if extra:
        merged = merged.unionByName(spark.read.schema(schema).json(extra))
    return merged


def read_demographics(spark: SparkSession, path: str | list[str], as_of: str) -> DataFrame:
    """Header-less CSV of user, gender and birthdate; age on the day ``as_of``."""
    rows = spark.read.schema(schemas.DEMOGRAPHICS).csv(path)
    return with_age(rows.withColumn("birthdate", F.try_to_timestamp("birthdate").cast("date")), as_of)


def with_age(people: DataFrame, as_of: str) -> DataFrame:
    return people.withColumn("age", age(F.col("birthdate"), F.to_date(F.lit(as_of))))


def read_geocodes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(schemas.GEOCODE).option("multiLine", True).json(path)


def read_libsvm(spark: SparkSession, path: str, features: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", str(features)).load(path)


def input_folder() -> F.Column:
    """Name of the folder in which the input file of a row lies."""
    return F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)


def file_extent(records: DataFrame, by: str = "file") -> DataFrame:
    """Earliest start and latest end of every input file, or of every ``folder``."""
    source = F.col("_metadata.file_name") if by == "file" else input_folder()
    return (records.select(source.alias(by), "start_time", "end_time")
            .groupBy(by)
            .agg(F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end")))


def nested_value(keys: list[str], schema: T.StructType) -> F.Column:
    """Column at the end of a key path; of an array the first element is taken."""
    value, kind = None, schema
    for key in keys:
        if isinstance(kind, T.ArrayType):
            value, kind = F.get(value, F.lit(0)), kind.elementType
        value = F.col(f"`{key}`") if value is None else value.getField(key)
        kind = kind[key].dataType
    return value
