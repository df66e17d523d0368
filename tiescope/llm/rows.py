"""Text columns inside tasks, and how the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: The same where many arrays of a word each are made.
SMALL_SLICE = 1 << 19
#: Bytes of rows, whole rows at least, that Spark hands to a Python worker at once.
BATCH_BYTES = "2m"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark application.

    Batches of Arrow rows are limited by BATCH_BYTES in the session: 10,000
    texts, the default, are held several times over in the executor and its workers.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(context, "_tiescope_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tiescope-ship-"), "tiescope_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(target)
    context._tiescope_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str | Sequence[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text in its column or columns, one row at least."""
    columns = [column] if isinstance(column, str) else column
    offsets = sum(raw_text(batch.column(c))[1] for c in columns)
    at, rows = 0, batch.num_rows
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(before - starts, lengths)


def drawn(labelled: DataFrame, key: str, documents: int) -> DataFrame:
    """About ``documents`` rows, all if there are no more, drawn by hash of their key.

    The draw is a filter on the key, so it reaches both sides of a join on it.
    """
    parts = 1 << 30
    share = min(1.0, documents / max(1, labelled.count()))
    return labelled.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fit")), F.lit(parts)) < int(share * parts))


def extended(df: DataFrame, kept: list[str], added: str) -> StructType:
    """Schema of the kept columns and the added ones, given as DDL."""
    return StructType([df.schema[c] for c in kept] + StructType.fromDDL(added).fields)
