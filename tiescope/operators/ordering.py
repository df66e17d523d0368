"""Running totals, quantiles and numbering over a whole table, in parallel.

A window without partitions would put all rows into one task. Here the order
key is cut into buckets by an expression that never decreases along the order.
Inside each bucket a window makes the local total; the totals of the buckets
before it come from a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiescope.session import stage

#: Pivots of a group (one less than a power of two), and the size of their sketch.
PIVOTS = 255
SKETCH_K = 1024
#: Rows of one key in a lookup from which on it is cut.
HOT_ROWS = 1_000_000


def running_total(df: DataFrame, order: Sequence[Column], bucket: Sequence[Column],
                  totals: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums in the given order, and grand totals.

    ``totals`` maps a value column to the name of its running sum; the grand
    total of the group is added as ``<name>_all``. ``bucket`` must be sorted in
    the same direction as ``order`` (negate it for a descending order).
    """
    names = [f"_bucket{index}" for index in range(len(bucket))]
    keyed = df.withColumns(dict(zip(names, bucket)))
    group = list(by) or [F.lit(0)]
    inside = Window.partitionBy(*by, *names).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)

    sums = keyed.groupBy(*by, *names).agg(*[F.sum(value).alias(value) for value in totals])
    for value, name in totals.items():
        sums = sums.withColumns({
            f"_before_{name}": F.coalesce(F.sum(value).over(before), F.lit(0)),
            f"{name}_all": F.sum(value).over(whole)})
    sums = sums.drop(*totals)

    local = keyed
    for value, name in totals.items():
        local = local.withColumn(name, F.sum(value).over(inside))
    joined = local.join(sums, [*by, *names])
    for name in totals.values():
        joined = joined.withColumn(name, F.col(name) + F.col(f"_before_{name}"))
    return joined.drop(*names, *[f"_before_{name}" for name in totals.values()])


def numbered(df: DataFrame, order: Sequence[Column], bucket: Sequence[Column],
             name: str = "number", by: Sequence[str] = ()) -> DataFrame:
    """1-based position of every row in a total order, and ``<name>_all`` rows."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), order, bucket,
                         {"_one": name}, by).drop("_one")


def with_bucket(df: DataFrame, column: str, name: str = "_part") -> DataFrame:
    """Adds a bucket that never decreases along the column.

    Spark's range partitioner finds slices of even size, for numbers in a
    narrow range too; the number of the slice is staged with the rows, as it
    must not change when a task runs again.
    """
    sliced = df.repartitionByRange(F.col(column)).withColumn(name, F.spark_partition_id())
    return stage(sliced, "slices")


def encode(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Distinct values numbered 1..K in their order."""
    values = with_bucket(df.select(column).distinct(), column)
    coded = numbered(values, [F.col(column)], [F.col("_part")], code)
    return coded.select(column, code)


def _pivots(counted: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One row per group: ``_pivots``, PIVOTS ascending values that cut the group evenly.

    They come from a mergeable sketch of the values. How even the slices are
    depends on it, results don't.
    """
    ranks = F.array(*[F.lit(k / (PIVOTS + 1)) for k in range(1, PIVOTS + 1)])
    sketch = counted.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("_sketch"),
                                      F.count(value).alias("_values"))
    cut = F.when(F.col("_values") > 0, F.sort_array(F.kll_sketch_get_quantile_double("_sketch", ranks)))
    return sketch.select(*by, cut.alias("_pivots"))  # an empty sketch can't be asked


def _slice(value: Column) -> Column:
    """Number of pivots below the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(PIVOTS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get("_pivots", at + step - 1) < value, at + step).otherwise(at))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float],
              by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one column ``q<percent>`` each.

    Values are counted first, so repeated values cost one row; the counts are
    staged, as three steps read them. A sketch gives pivots that cut each group into slices of even size; the exact counts of
    the slices say in which of them the wanted positions lie, and only those
    slices are put in order.
    """
    counted = stage(df.filter(F.col(value).isNotNull()).groupBy(*by, value)
                    .agg(F.count("*").alias("_rows")), "counted")
    pivots = _pivots(counted, value, by)
    if by:
        cut = counted.join(pivots, list(by))
    else:
        cut = counted.withColumn("_pivots", pivots.select("_pivots").scalar())
    sliced = cut.withColumn("_slice", _slice(F.col(value).cast("double"))).drop("_pivots")

    # a group has PIVOTS + 1 slices at most, so these windows are small
    group = list(by) or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*by, "_slice").agg(F.sum("_rows").alias("_own")).withColumns({
        "_before": F.coalesce(F.sum("_own").over(before), F.lit(0)),
        "_all": F.sum("_own").over(Window.partitionBy(*group))})
    positions = [F.lit(float(p)) * (F.col("_all") - 1) for p in probabilities]
    wanted = F.lit(False)
    for position in positions:
        for index in (F.floor(position), F.least(F.floor(position) + 1, F.col("_all") - 1)):
            wanted = wanted | ((index >= F.col("_before")) & (index < F.col("_before") + F.col("_own")))
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (sliced.join(sums.filter(wanted).drop("_own"), [*by, "_slice"])
              .withColumn("_upto", F.sum("_rows").over(inside) + F.col("_before")))
    first, last = F.col("_upto") - F.col("_rows"), F.col("_upto") - 1

    def at(index: Column) -> Column:
        return F.max(F.when(index.between(first, last), F.col(value).cast("double")))

    parts = []
    for p, position in zip(probabilities, positions):
        lower = F.floor(position)
        parts += [at(lower).alias(f"_low_{p}"), at(F.least(lower + 1, F.col("_all") - 1)).alias(f"_high_{p}"),
                  F.max(position - lower).alias(f"_part_{p}")]
    row = placed.groupBy(*by).agg(F.max("_all").alias("rows"), *parts)
    result = [(F.col(f"`_low_{p}`") + F.col(f"`_part_{p}`")
               * (F.col(f"`_high_{p}`") - F.col(f"`_low_{p}`"))).alias(quantile_name(p))
              for p in probabilities]
    return row.select(*by, "rows", *result)


def quantile_name(probability: float) -> str:
    return f"q{round(probability * 100)}"


def with_previous(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column,
                  columns: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """Values of the row before, in the order within ``by``; null for the first.

    ``chunk`` never decreases along the order and cuts a long group into
    pieces. A piece starts from the last row of the piece before it.
    """
    keyed = df.withColumn("_chunk", chunk)
    piece = Window.partitionBy(*by, "_chunk").orderBy(*order)
    row = F.struct(*columns)
    last = (keyed.groupBy(*by, "_chunk")
            .agg(F.max_by(row, F.struct(*order)).alias("_last")))
    group = list(by) or [F.lit(0)]
    carried = last.select(*by, "_chunk", F.lag("_last").over(
        Window.partitionBy(*group).orderBy("_chunk")).alias("_carried"))
    local = keyed.withColumn("_before", F.lag(row).over(piece))
    joined = local.join(carried, [*by, "_chunk"])
    source = F.coalesce("_before", "_carried")
    return (joined.withColumns({f"{prefix}{name}": source.getField(name) for name in columns})
            .drop("_chunk", "_before", "_carried"))


def lookup(rows: DataFrame, key: str, table: DataFrame, how: str = "inner", hot_rows: int = HOT_ROWS,
           most: int | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per value of ``key``.

    A key that more than ``hot_rows`` rows share is cut into parts; the table's
    row goes to each of them. There are fewer such keys than rows / hot_rows,
    and they are found with a count that is combined before it is moved. Where
    it is known that there are at most ``most`` rows, that may settle it.
    """
    if most is not None and most <= hot_rows:
        return rows.join(table, key, how)
    heavy = (rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
             .select(key, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_parts")))
    heavy = stage(heavy, "hot-keys")
    if heavy.isEmpty():
        return rows.join(table, key, how)
    # the list of hot keys is short by its definition, so Spark broadcasts it
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(heavy, key, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    right = table.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")
