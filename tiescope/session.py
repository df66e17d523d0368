"""Session helpers: the shared scratch folder and stage boundaries."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local: dict[str, str] = {}  # temporary folder of a local application


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder is there, a local
    master gets one temporary folder for the application; on a cluster that
    is an error, as executors can't see each other's temporary folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="tiescope-")
        folder = _local[context.applicationId]
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables known to SQL in their own session, by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table is what later steps start from: it is computed once
    although several branches use it, and a lost executor costs a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: Sequence[str], name: str = "bucketed", buckets: int | None = None) -> DataFrame:
    """Write ``df`` once in buckets by the columns ``by`` and read it back as a table.

    Joins and aggregates on those columns need no exchange of it. There are as
    many buckets as shuffle partitions unless ``buckets`` says otherwise.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by)
     .option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table))
    return spark.table(table)
