"""The corpus pipeline: documents through the filtering and packing operators.

Each stage takes what its predecessor kept, with the columns of documents,
and gives the same columns, but for the last, which gives pieces of sequences.
Stages go by rows, not by ids: repeated rows and rows without an id are told
apart by a row number, which is written with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiescope.llm import jaccard, linededup, suffixes
from tiescope.llm.queries import judged, packed
from tiescope.session import stage

LAST = (1 << 63) - 1


def _apart(docs: DataFrame) -> list:
    """All columns but the text as ``_doc``, so that none of them meets an operator's own, and the text."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_doc"), F.col("text")]


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """(_doc, text, row, ord): ``_apart`` with the row number and the order (by doc_id, null last); written."""
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    return stage(docs.select(*_apart(docs), F.monotonically_increasing_id().alias("row"), order.alias("ord")), name)


def _plain(table: DataFrame, columns: list[str]) -> DataFrame:
    """The documents, with the texts of ``table`` and their lengths."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return table.select(*[(new[c] if c in new else F.col("_doc").getField(c)).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the line model."""
    kept = judged(spark, docs.select(*_apart(docs)), sf_dir).filter("kept")
    return kept.select(*[(F.col("text") if c == "text" else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines."""
    return _plain(linededup.clean(docs.select(*_apart(docs), "source")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, by doc_id (null last), then row."""
    numbered = _numbered(docs, "pipeline-groups")
    found = jaccard.near_duplicates(numbered.select(F.struct("ord", "row").alias("place"), "text"), key="place")
    others = found.filter("place <> component_id").select("place.row")
    return _plain(numbered.join(others, "row", "left_anti"), docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one."""
    numbered = _numbered(docs, "pipeline-passages")
    found = suffixes.repeats(numbered.select("row", "ord", "text"))
    return _plain(suffixes.remove(numbered, found), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens in sequences of 4,096."""
    return packed(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages),
          ("packing", packing)]

#: Models, sketches and tokens are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
