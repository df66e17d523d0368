"""Joins that pair users: co-occurrences and range joins, safe for crowded cells.

A crowded cell is cut into blocks of users. Each pair of blocks becomes a join
key of its own, so the pairs of one cell are made by many tasks while every
pair is still made exactly once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tiescope.config import Period
from tiescope.operators.cleaning import outside
from tiescope.operators.ordering import running_total
from tiescope.operators.presence import CELL, cell_population
from tiescope.session import stage

#: Rows of a cell, or of one side of a key, from which on it is cut into blocks.
BLOCK_ROWS = 2048
#: Pairs made by one task.
TASK_PAIRS = 50_000_000
#: Co-occurrences of one task that also groups them by pair, and the most tasks that are made for it.
PAIR_TASK_ROWS = 4_000_000
PAIR_TASKS = 20_000


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _shares(light: int, crowded: int, least: int, task_pairs: int) -> tuple[int, int]:
    """Tasks for the light keys and for the blocks of the crowded ones, by their counted pairs."""
    total = light + crowded
    tasks = max(least, -(-total // task_pairs))
    if not crowded:
        return tasks, 0
    if not light:
        return 0, tasks
    dealt = min(max(1, round(tasks * crowded / total)), max(1, tasks - 1))
    return max(1, tasks - dealt), dealt


def _with_start(crowded: DataFrame, keys: Sequence[str], work: str) -> DataFrame:
    """Adds ``before``, the work of all keys before this one in the order of a hash."""
    number = F.pmod(F.xxhash64(*keys), F.lit(1024))
    placed = running_total(crowded, [number, *[F.col(key) for key in keys]], [number], {work: "_upto"})
    return placed.withColumn("before", F.col("_upto") - F.col(work)).drop("_upto", "_upto_all")


def co_occurrences(people: DataFrame, cells: DataFrame | None = None,
                   carry: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
                   placed: bool = False, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """All pairs user1 < user2 that share a cell and a bin.

    ``people`` holds distinct presence rows; it is read for counting and for
    pairing, so give a stored table, not a long plan. ``cells`` has one row per
    cell with at least the column ``people`` (its population); further columns
    of it are kept. ``carry`` names presence columns returned for both users
    with the suffixes 1 and 2. ``placed`` says that the table is stored in
    buckets by cell (``presence.stored``): light cells are then paired where
    they are, without an exchange.

    Cells of more than ``block_rows`` users are cut into blocks. The pairs are
    counted first; pairs of blocks are dealt to tasks by the running total of
    their counts.
    """
    cells = cell_population(people) if cells is None else cells
    kept = [name for name in cells.columns if name not in CELL]
    together = cells.filter(F.col("people") >= 2)
    pairs = F.col("people").cast("bigint") * (F.col("people") - 1) / 2
    is_light = F.col("people") <= block_rows
    counts = together.agg(F.coalesce(F.sum(F.when(is_light, pairs)), F.lit(0)).cast("bigint").alias("light"),
                          F.coalesce(F.sum(F.when(~is_light, pairs)), F.lit(0)).cast("bigint").alias("crowded")).first()
    light_tasks, dealt_tasks = _shares(counts["light"], counts["crowded"], _tasks(people), task_pairs)

    def sides(members: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        left = members.select(*CELL, *kept, *more, F.col("useruuid").alias("left_user"),
                              *[F.col(name).alias(f"left_{name}") for name in carry])
        right = members.select(*CELL, *more, F.col("useruuid").alias("right_user"),
                               *[F.col(name).alias(f"right_{name}") for name in carry])
        return left, right

    ordered = F.col("left_user") < F.col("right_user")
    both = []
    for name in carry:
        mine, theirs = F.col(f"left_{name}"), F.col(f"right_{name}")
        both.append(F.when(ordered, mine).otherwise(theirs).alias(f"{name}1"))
        both.append(F.when(ordered, theirs).otherwise(mine).alias(f"{name}2"))
    told = [F.least("left_user", "right_user").alias("user1"), F.greatest("left_user", "right_user").alias("user2"),
            *CELL, *kept, *both]

    parts = []
    if light_tasks:
        members, keys = people.join(together.filter(is_light), CELL), CELL
        if not placed:
            members = members.withColumn("task", F.pmod(F.xxhash64(*CELL), F.lit(light_tasks)).cast("int"))
            members, keys = members.repartitionById(light_tasks, "task"), ["task", *CELL]
        left, right = sides(members, *keys[:-len(CELL)])
        # the output is larger than the input: a sort-merge join, which can spill
        parts.append(left.join(right.hint("merge"), keys).filter(ordered).select(*told))
    if dealt_tasks:
        blocks = F.ceil(F.col("people") / F.lit(block_rows))
        block_pairs = blocks * (blocks + 1) / 2
        crowd = together.filter(~is_light).withColumns(
            {"blocks": blocks, "each": pairs / block_pairs, "work": pairs})
        members = (people.join(_with_start(crowd, CELL, "work"), CELL)
                   .withColumn("block", F.pmod(F.xxhash64("useruuid"), F.col("blocks"))))
        left, right = sides(members, "blocks", "each", "before", "block")
        # Each user meets the blocks at or above the own one from the left side,
        # and the blocks at or below it from the right side.
        left = left.withColumnRenamed("block", "low").withColumn("high", F.explode(F.sequence("low", F.col("blocks") - 1)))
        right = right.withColumnRenamed("block", "high").withColumn(
            "low", F.explode(F.sequence(F.lit(0).cast("bigint"), "high")))
        nth = F.col("low") * F.col("blocks") - F.col("low") * (F.col("low") - 1) / 2 + F.col("high") - F.col("low")
        at = (F.col("before") + (nth + 0.5) * F.col("each")) / F.lit(counts["crowded"]) * dealt_tasks
        task = F.least(F.floor(at), F.lit(dealt_tasks - 1)).cast("int")
        left, right = (side.withColumn("task", task).drop("blocks", "each", "before").repartitionById(dealt_tasks, "task")
                       for side in (left, right))
        once = (F.col("low") < F.col("high")) | ordered
        parts.append(left.join(right.hint("merge"), ["task", *CELL, "low", "high"]).filter(once).select(*told))
    if not parts:  # nobody met
        left, right = sides(people.join(together, CELL))
        return left.join(right, CELL).filter(ordered).select(*told)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def triangle(tasks: int) -> int:
    """Blocks of users of which the pairs, each block with itself too, are at least ``tasks``."""
    return math.ceil((math.sqrt(8 * tasks + 1) - 1) / 2)


def triangle_task(blocks: int, low: Column, high: Column) -> Column:
    """Number of a pair of blocks, ``low`` <= ``high``, from 0."""
    low, high = low.cast("bigint"), high.cast("bigint")
    return (low * F.lit(blocks) - F.shiftright(low * (low - 1), 1) + high - low).cast("int")


def user_block(user: str, blocks: int) -> Column:
    """Block, from 0, to which a user is dealt."""
    return F.pmod(F.xxhash64(user), F.lit(blocks)).cast("int")


def pair_blocks(cells: DataFrame, task_rows: int = PAIR_TASK_ROWS) -> int | None:
    """Blocks of users for ``co_occurrences_by_pair``.

    None where the counted co-occurrences are fewer rows than the presence that
    would be moved to the pairs of blocks.
    """
    counts = cells.filter(F.col("people") >= 2).agg(F.coalesce(F.sum("people"), F.lit(0)).cast("bigint").alias("rows"), F.coalesce(
        F.sum(F.col("people").cast("bigint") * (F.col("people") - 1) / 2), F.lit(0)).cast("bigint").alias("pairs")).first()
    wanted = min(PAIR_TASKS, -(-counts["pairs"] // task_rows))
    blocks = triangle(max(wanted, 2 * cells.sparkSession.sparkContext.defaultParallelism))
    return None if counts["rows"] * (blocks + 1) >= counts["pairs"] else blocks


def co_occurrences_by_pair(people: DataFrame, cells: DataFrame | None = None, carry: Sequence[str] = (),
                           block_rows: int = BLOCK_ROWS, placed: bool = False,
                           task_rows: int = PAIR_TASK_ROWS, blocks: int | None = None) -> DataFrame:
    """``co_occurrences`` for grouping by pair.

    Users are dealt to blocks by a hash. A task makes the co-occurrences of one
    pair of blocks, so those of a pair of users lie in one task, named in the
    column ``task``, and grouping by ``pair_key`` moves none of them. What is
    moved is the presence, once for each block. Where the counted
    co-occurrences are fewer than that, they are moved, and there is no ``task``.
    ``blocks`` says how many blocks there are, so that tables of two calls lie alike.
    """
    cells = cell_population(people) if cells is None else cells
    kept = [name for name in cells.columns if name not in CELL]
    together = cells.filter(F.col("people") >= 2)
    blocks = pair_blocks(cells, task_rows) if blocks is None else blocks
    if blocks is None:
        return co_occurrences(people, cells, carry, block_rows, placed)
    names = ["useruuid", *carry]
    packed = _packed(people.filter(F.col("useruuid").isNotNull()).withColumn("block", user_block("useruuid", blocks)), names).join(together, CELL)
    held = [name for name in packed.columns if name.startswith("_")]

    def side(name: str, own: str, other: str, first: Column, last: Column, *more: str) -> DataFrame:
        spread = (packed.withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(first, last)))
                  .withColumn("task", triangle_task(blocks, F.col("low"), F.col("high"))))
        # inside a task the two blocks are known, so a row says only whether they are one
        return spread.select("task", *CELL, *more, (F.col("low") == F.col("high")).alias(f"{name}_one"),
                             *[F.col(column).alias(f"{name}{column}") for column in held])

    total = blocks * (blocks + 1) // 2
    left = side("left", "low", "high", F.col("low"), F.lit(blocks - 1), *kept).repartitionById(total, "task")
    right = side("right", "high", "low", F.lit(0), F.col("high")).drop("right_one").repartitionById(total, "task")
    met = left.join(right.hint("merge"), ["task", *CELL])
    for name in ("left", "right"):
        met = met.select("*", F.posexplode(f"{name}_0").alias(f"{name}_at", f"{name}_low")).drop(f"{name}_0")
        met = met.withColumn(f"{name}_user", _unpacked(met, name, 0, F.col(f"{name}_low")))
    ordered = F.col("left_user") < F.col("right_user")
    both = []
    for number, name in enumerate(names[1:], start=1):
        mine, theirs = (_unpacked(met, side, number, F.get(f"{side}_{number}", F.col(f"{side}_at"))) for side in ("left", "right"))
        both += [F.when(ordered, mine).otherwise(theirs).alias(f"{name}1"),
                 F.when(ordered, theirs).otherwise(mine).alias(f"{name}2")]
    return (met.filter(~F.col("left_one") | ordered)
            .select("task", F.least("left_user", "right_user").alias("user1"),
                    F.greatest("left_user", "right_user").alias("user2"), *CELL, *kept, *both))


def _packed(people: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per block and cell with the columns ``names`` as arrays ``_0``, ``_1``, ... in the order of the first.

    A cell is then moved once for its users of a block. 64-bit numbers become two arrays, the
    upper 48 bits (``_0h``) and the lower 16: in order, the upper ones hardly change, so they
    take next to nothing where they are compressed.
    """
    row = F.struct(*[F.col(name).alias(f"f{number}") for number, name in enumerate(names)])
    rows = people.groupBy("block", *CELL).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def array(make) -> Column:
        return F.transform("rows", make)

    arrays = {}
    for number, name in enumerate(names):
        if isinstance(people.schema[name].dataType, LongType):
            arrays[f"_{number}"] = array(lambda one: (one[f"f{number}"].bitwiseAND(F.lit(65535)) - 32768).cast("smallint"))
            arrays[f"_{number}h"] = array(lambda one: F.shiftright(one[f"f{number}"], 16))
        else:
            arrays[f"_{number}"] = array(lambda one: one[f"f{number}"])
    return rows.withColumns(arrays).drop("rows")


def _unpacked(met: DataFrame, side: str, number: int, value: Column) -> Column:
    """The value of ``_packed`` at the place of a row, given the one of its first array."""
    upper = f"{side}_{number}h"
    if upper not in met.columns:
        return value
    return F.shiftleft(F.get(upper, F.col(f"{side}_at")), 16).bitwiseOR((value + 32768).cast("bigint"))


def pair_key(coocs: DataFrame) -> list[str]:
    """Columns that name a pair of users, with its task where there is one."""
    return [name for name in ("task", "user1", "user2") if name in coocs.columns]


def pair_count(people: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of co-occurrences without making the pairs: n(n-1)/2 per cell."""
    cells = people.groupBy(*CELL, *[name for name in by if name not in CELL]).agg(
        F.count("*").alias("people"))
    pairs = (F.col("people") * (F.col("people") - 1) / 2).cast("bigint")
    return (cells.filter(F.col("people") >= 2)
            .groupBy(*by).agg(F.sum(pairs).alias("coocs")))


def dyads(coocs: DataFrame) -> DataFrame:
    """Distinct pairs."""
    return coocs.select(*pair_key(coocs)).distinct().select("user1", "user2")


def co_occurrences_of(binned: DataFrame, user: object, other: object | None = None,
                      period: Period | None = None,
                      perimeters: DataFrame | None = None) -> DataFrame:
    """Updates of others that share a cell and a bin with updates of one user.

    One row per pair of updates, as (other's id and bins, the user's bins).
    With a period, all bins of both updates must lie inside; perimeters drop
    the other's updates near the listed points.
    """
    if period is not None:
        binned = binned.filter((F.array_min("time_bins") >= period.start)
                               & (F.array_max("time_bins") < period.end))
    mine = (binned.filter(F.col("useruuid") == F.lit(user))
            .select("spatial_bin", F.col("time_bins").alias("own_bins")).distinct())
    others = binned.filter(F.col("useruuid") != F.lit(user))
    if other is not None:
        others = others.filter(F.col("useruuid") == F.lit(other))
    if perimeters is not None:
        others = outside(others, perimeters, by_country=False)
    # Only updates in a cell of the user, within the range of bins spent there,
    # are opened; the rows of the one user are few, so this goes first.
    spent = mine.groupBy("spatial_bin").agg(F.min(F.array_min("own_bins")).alias("own_low"),
                                            F.max(F.array_max("own_bins")).alias("own_high"))
    near = (others.select("id", "useruuid", "spatial_bin", "time_bins", "longitude", "latitude").join(spent, "spatial_bin")
            .filter((F.array_max("time_bins") >= F.col("own_low")) & (F.array_min("time_bins") <= F.col("own_high"))))
    # One row per shared bin is enough to find the pair of updates; keyed by
    # cell and bin no single place becomes one join key.
    own = mine.select("spatial_bin", "own_bins", F.explode("own_bins").alias("bin"))
    theirs = near.drop("own_low", "own_high").withColumn("bin", F.explode("time_bins"))
    # the first bin both have: neither side has one before it in common
    first_shared = F.array_min(F.array_intersect("time_bins", "own_bins"))
    return (theirs.join(own, ["spatial_bin", "bin"])
            .filter(F.col("bin") == first_shared)
            .withColumn("own_user", F.lit(user)).drop("bin"))


def met_in_bin(people: DataFrame, user1: object, user2: object, time_bin: int) -> DataFrame:
    """One row, ``met``: did the two users share a cell in the bin."""
    there = people.filter(F.col("time_bin") == time_bin)
    mine = there.filter(F.col("useruuid") == F.lit(user1)).select("spatial_bin")
    theirs = there.filter(F.col("useruuid") == F.lit(user2)).select("spatial_bin")
    return mine.join(theirs, "spatial_bin", "left_semi").agg((F.count("*") > 0).alias("met"))


def users_in_cell(binned: DataFrame, cell: int | Column, time_bin: int | None = None) -> DataFrame:
    """Distinct users seen in a cell, optionally in one bin of it."""
    there = binned.filter(F.col("spatial_bin") == cell)
    if time_bin is not None:
        there = there.filter(F.array_contains("time_bins", F.lit(time_bin).cast("bigint")))
    return there.select("useruuid").distinct()


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
              left_id: str, right_id: str, block_rows: int = BLOCK_ROWS,
              task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Equi-join in which a key with many rows on both sides is cut into a grid.

    Rows of a key are hashed into blocks of about ``block_rows`` on each side;
    a block of the left meets every block of the right exactly once. The pairs
    of every key are counted first: blocks of crowded keys are dealt to tasks
    by the running total of their pairs, other keys by hash, and the number of
    tasks follows from the pairs.
    """
    left_size = left.groupBy(*keys).agg(F.count("*").alias("left_rows"))
    right_size = right.groupBy(*keys).agg(F.count("*").alias("right_rows"))
    blocks = {side: F.ceil(F.col(f"{side}_rows") / F.lit(block_rows)) for side in ("left", "right")}
    # Only keys present on both sides can join, and only split ones need a row.
    sizes = left_size.join(right_size, list(keys)).withColumns(
        {f"{side}_blocks": blocks[side] for side in blocks}).withColumn("work", F.col("left_rows") * F.col("right_rows"))
    is_crowded = (F.col("left_blocks") > 1) | (F.col("right_blocks") > 1)
    counts = sizes.agg(F.coalesce(F.sum(F.when(~is_crowded, F.col("work"))), F.lit(0)).alias("light"),
                       F.coalesce(F.sum(F.when(is_crowded, F.col("work"))), F.lit(0)).alias("crowded")).first()
    light_tasks, dealt_tasks = _shares(counts["light"], counts["crowded"], _tasks(left), task_pairs)
    if not dealt_tasks:
        cut = [side.repartition(max(1, light_tasks), *keys) for side in (left, right)]
        return cut[0].join(cut[1].hint("merge"), list(keys))
    crowded = stage(_with_start(sizes.filter(is_crowded), keys, "work")
                    .select(*keys, "left_blocks", "right_blocks", "work", "before"), "crowded-keys")
    zero = F.lit(0).cast("bigint")

    def spread(side: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        sized = side.join(crowded, list(keys), "left")
        own_blocks, other_blocks = (F.coalesce(f"{which}_blocks", F.lit(1)).cast("bigint")
                                    for which in (own, other))
        nth = F.col("_left") * F.col("right_blocks") + F.col("_right")
        each = F.col("work") / (F.col("left_blocks") * F.col("right_blocks"))
        at = (F.col("before") + (nth + 0.5) * each) / F.lit(counts["crowded"]) * dealt_tasks
        dealt = light_tasks + F.least(F.floor(at), F.lit(dealt_tasks - 1))
        hashed = F.pmod(F.xxhash64(*keys), F.lit(max(1, light_tasks)))
        return (sized.withColumn(f"_{own}", F.pmod(F.xxhash64(row_id), own_blocks))
                .withColumn(f"_{other}", F.explode(F.sequence(zero, other_blocks - 1)))
                .withColumn("_task", F.coalesce(dealt, hashed).cast("int"))
                .drop("left_blocks", "right_blocks", "work", "before")
                .repartitionById(light_tasks + dealt_tasks, "_task"))

    joined = ["_task", *keys, "_left", "_right"]
    return (spread(left, left_id, "left", "right").join(spread(right, right_id, "right", "left").hint("merge"), joined)
            .drop("_task", "_left", "_right"))


def containing_updates(locations: DataFrame, tolerance_minutes: int = 24 * 60,
                       cell_size: float = 0.001, block_rows: int = BLOCK_ROWS,
                       task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Pairs of updates of two users where the target's stay encloses the source's.

    The target starts at most half the tolerance before the source starts,
    ends at most half the tolerance after it ends, and is at most ``cell_size``
    degrees away on both axes. The target is present in the hour the source
    starts in, so (hour, map tile) is the join key; the source looks at the
    3 x 3 tiles around its own and the exact conditions decide. A target whose
    source starts inside it can't have begun earlier than half the tolerance
    before, so only its hours up to then are made, however long it lasts.
    """
    half = F.lit(tolerance_minutes * 60 * 1_000_000 // 2).cast("bigint")
    hour = 3_600_000_000
    # Tiles a little wider than the reach, so rounding of the coordinates
    # cannot put two points in reach further than one tile apart.
    tile = cell_size * 1.001

    def tile_of(coordinate: str) -> Column:
        return F.floor(F.col(coordinate) / F.lit(tile))

    timed = locations.filter(F.col("end_time") >= F.col("start_time")).select(
        "id", "useruuid", "longitude", "latitude",
        F.unix_micros("start_time").alias("begin"), F.unix_micros("end_time").alias("finish"))
    around = F.array(*[F.lit(step).cast("bigint") for step in (-1, 0, 1)])
    source = (timed.select(*[F.col(name).alias(f"s_{name}") for name in timed.columns])
              .withColumn("slot", F.floor(F.col("s_begin") / F.lit(hour)))
              .withColumn("row_step", F.explode(around)).withColumn("column_step", F.explode(around))
              .withColumn("row", tile_of("s_latitude") + F.col("row_step"))
              .withColumn("column", tile_of("s_longitude") + F.col("column_step"))
              .drop("row_step", "column_step"))
    target = (timed.select(*[F.col(name).alias(f"t_{name}") for name in timed.columns])
              .withColumn("slot", F.explode(F.sequence(F.floor(F.col("t_begin") / F.lit(hour)),
                                                       F.floor(F.least("t_finish", F.col("t_begin") + half) / F.lit(hour)))))
              .withColumn("row", tile_of("t_latitude")).withColumn("column", tile_of("t_longitude")))
    pairs = grid_join(source, target, ["slot", "row", "column"], "s_id", "t_id", block_rows, task_pairs)
    return (pairs.filter(
        (F.col("s_useruuid") != F.col("t_useruuid"))
        & F.col("t_begin").between(F.col("s_begin") - half, F.col("s_begin"))
        & F.col("t_finish").between(F.col("s_finish"), F.col("s_finish") + half)
        & (F.abs(F.col("t_longitude") - F.col("s_longitude")) <= cell_size)
        & (F.abs(F.col("t_latitude") - F.col("s_latitude")) <= cell_size))
        .select(F.col("s_id").alias("source_id"), F.col("s_useruuid").alias("source"),
                F.col("t_id").alias("target_id"), F.col("t_useruuid").alias("target")))


def simultaneous_sessions(apps: DataFrame, seconds: int = 10,
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sessions of one app by two users that start and end within ``seconds``."""
    width = seconds * 1_000_000
    timed = apps.select("id", "useruuid", "package_name",
                        F.unix_micros("start_time").alias("begin"),
                        F.unix_micros("end_time").alias("finish"))

    def slot(name: str) -> Column:
        return F.floor(F.col(name) / F.lit(width))

    around = F.array(*[F.lit(step).cast("bigint") for step in (-1, 0, 1)])
    left = (timed.select("package_name", *[F.col(name).alias(f"l_{name}")
                                           for name in ("id", "useruuid", "begin", "finish")])
            .withColumn("step", F.explode(around)).withColumn("begin_slot", slot("l_begin") + F.col("step"))
            .withColumn("step", F.explode(around)).withColumn("finish_slot", slot("l_finish") + F.col("step"))
            .drop("step"))
    right = (timed.select("package_name", *[F.col(name).alias(f"r_{name}")
                                            for name in ("id", "useruuid", "begin", "finish")])
             .withColumn("begin_slot", slot("r_begin")).withColumn("finish_slot", slot("r_finish")))
    pairs = grid_join(left, right, ["package_name", "begin_slot", "finish_slot"],
                      "l_id", "r_id", block_rows)
    return (pairs.filter(
        (F.col("l_useruuid") < F.col("r_useruuid"))
        & (F.abs(F.col("l_begin") - F.col("r_begin")) <= width)
        & (F.abs(F.col("l_finish") - F.col("r_finish")) <= width))
        .select("package_name", F.col("l_id").alias("id1"), F.col("l_useruuid").alias("user1"),
                F.col("r_id").alias("id2"), F.col("r_useruuid").alias("user2")))


def share_in_country(locations: DataFrame, country: str, ratio: float = 0.5) -> DataFrame:
    """Users with at least ``ratio`` of their rows (blank countries aside) in a country."""
    per_user = (locations.filter(F.col("country") != "")
                .groupBy("useruuid")
                .agg(F.count_if(F.col("country") == country).alias("inside"),
                     F.count("*").alias("rows")))
    return (per_user.withColumn("ratio", F.col("inside") / F.col("rows"))
            .filter((F.col("inside") > 0) & (F.col("ratio") >= ratio)))


def met_next(pairs: DataFrame, next_pairs: DataFrame) -> DataFrame:
    """Label 1 for pairs that co-occur in the following period, else 0.

    Where both have a ``task``, they are of as many blocks of users.
    """
    by_task = "task" in pairs.columns and "task" in next_pairs.columns
    marked = (next_pairs.select(*pair_key(next_pairs)).distinct() if by_task else dyads(next_pairs)).withColumn("label", F.lit(1))
    return pairs.join(marked, pair_key(pairs) if by_task else ["user1", "user2"], "left").fillna(0, ["label"])


def attach_both(pairs: DataFrame, users: DataFrame, how: str = "left") -> DataFrame:
    """Per-user columns for both ends of a pair, suffixed 1 and 2."""
    columns = [name for name in users.columns if name != "useruuid"]
    for side in ("1", "2"):
        renamed = users.select(F.col("useruuid").alias(f"user{side}"),
                               *[F.col(name).alias(f"{name}{side}") for name in columns])
        pairs = pairs.join(renamed, f"user{side}", how)
    return pairs


def both_selected(pairs: DataFrame, selected: DataFrame) -> DataFrame:
    """Pairs whose two users are in the selection."""
    for side in ("user1", "user2"):
        pairs = pairs.join(selected.select(F.col("useruuid").alias(side)).distinct(), side, "left_semi")
    return pairs


def only_in_one(left: DataFrame, right: DataFrame, key: str = "useruuid") -> DataFrame:
    """Keys present in exactly one of two tables, with the side they are in."""
    sides = (left.select(key).distinct().withColumn("side", F.lit("left"))
             .unionByName(right.select(key).distinct().withColumn("side", F.lit("right"))))
    return (sides.groupBy(key).agg(F.count("*").alias("tables"), F.min("side").alias("side"))
            .filter(F.col("tables") == 1).select(key, "side"))
