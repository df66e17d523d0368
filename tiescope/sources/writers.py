"""Writers: binned locations, missing-country rows, edges, GeoJSON, LIBSVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiescope.config import BinConfig
from tiescope.functions.binning import spatial_bin, time_bins


def with_bins(locations: DataFrame, cfg: BinConfig) -> DataFrame:
    """Locations with the columns ``spatial_bin`` and ``time_bins``."""
    return locations.withColumns({
        "spatial_bin": spatial_bin(F.col("longitude"), F.col("latitude"), cfg.decimals, cfg.stride),
        "time_bins": time_bins(F.col("start_time"), F.col("end_time"), cfg),
    })


def write_locations(locations: DataFrame, path: str, cfg: BinConfig) -> None:
    """Store binned locations, one folder per country, sorted by cell in each file.

    The blank country would become a null partition, so the folder column is a
    copy and the stored ``country`` keeps its value.
    """
    (with_bins(locations, cfg)
     .withColumn("country_key", F.when(F.col("country") == "", "unknown").otherwise(F.col("country")))
     .sortWithinPartitions("country_key", "spatial_bin")
     .write.partitionBy("country_key").parquet(path))


def convert(spark: SparkSession, path_in: str, fmt_in: str, path_out: str, fmt_out: str) -> None:
    """Rewrite a folder of records in another format."""
    spark.read.format(fmt_in).load(path_in).write.format(fmt_out).save(path_out)


def missing_country(locations: DataFrame) -> DataFrame:
    """Points of the rows whose country is blank or null."""
    return (locations.filter(F.coalesce("country", F.lit("")) == "")
            .select("id", "longitude", "latitude"))


def write_missing_country(locations: DataFrame, path: str) -> None:
    missing_country(locations).write.json(path)


def write_edges(coocs: DataFrame, path: str) -> None:
    """Edge list, one row per co-occurrence, ``;`` between the two users; gzipped, as it repeats them."""
    coocs.select("user1", "user2").write.option("sep", ";").option("compression", "gzip").csv(path)


def write_geojson(features: DataFrame, path: str, column: str = "feature") -> None:
    """One GeoJSON feature per line."""
    features.select(F.col(column).alias("value")).write.text(path)


def assemble(table: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Label and feature vector, columns in the given order."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    return assembler.transform(table.withColumn("label", F.col(label).cast("double")))


def write_libsvm(table: DataFrame, columns: Sequence[str], path: str,
                 label: str = "label", files: int | None = None) -> None:
    """Feature table as LIBSVM text, in ``files`` files if given; the table is still made by all tasks."""
    vectors = assemble(table, columns, label).select("label", "features")
    if files is not None:
        vectors = vectors.repartition(files)
    vectors.write.format("libsvm").save(path)
