"""Runs catalog queries next to their SQL on DuckDB and compares the results.

Usage: python tests/check.py [--no-sql] [--sf DIR] [name prefixes ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """Why two results differ, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    ours, theirs = canonical(ours), canonical(theirs)
    if len(ours):
        for name in ours.columns:
            if ours[name].dtype.kind != theirs[name].dtype.kind:
                return f"type of {name}: {ours[name].dtype} / {theirs[name].dtype}"
    for name in ours.columns:
        same = (ours[name] == theirs[name]) | (ours[name].isna() & theirs[name].isna())
        if not same.all():
            at = same.idxmin()
            return f"{name} differs in {(~same).sum()} rows:\n{ours.loc[at].to_dict()}\n{theirs.loc[at].to_dict()}"
    return None


def main(arguments: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    compare = arguments[:1] != ["--no-sql"]
    if not compare:
        arguments = arguments[1:]
    if arguments[:1] == ["--sf"]:
        folder, arguments = arguments[1], arguments[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql() if compare else {}
    bad = []
    for name, build in queries.items():
        if arguments and not any(name.startswith(prefix) for prefix in arguments):
            continue
        began = time.time()
        try:
            ours = build(spark, folder).toPandas()
            took = time.time() - began
            problem = difference(ours, con.execute(oracles[name]).df()) if name in oracles else None
            if not len(ours):
                problem = problem or "no rows"
        except Exception as error:  # report and go on with the next query
            took, problem = time.time() - began, f"{type(error).__name__}: {str(error)[:1500]}"
            ours = pd.DataFrame()
        kind = "sql" if name in oracles else "rows only"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {took:6.2f}s {len(ours):8d} rows  {kind}", flush=True)
        if problem:
            print("     ", problem, flush=True)
            bad.append(name)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
