"""Selections of users by how regularly they report, and near-duplicate users."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiescope.config import Period
from tiescope.functions.calendar import covered_days, local
from tiescope.operators.graph import components
from tiescope.operators.heatmaps import activity
from tiescope.operators.ordering import running_total, with_bucket, with_previous
from tiescope.operators.pairing import grid_join
from tiescope.operators.presence import activity_by_period, period_of
from tiescope.session import stage

WORD = 62


def occupancy(people: DataFrame, periods: list[Period]) -> DataFrame:
    """Share of the bins of a period in which the user was seen."""
    length = F.lit(None).cast("int")
    for index, period in enumerate(periods, start=1):
        length = F.when(F.col("period") == index, period.length).otherwise(length)
    return activity_by_period(people, periods).select(
        "useruuid", "period", "bins", (F.col("bins") / length).alias("occupancy"))


def lowest_occupancy(people: DataFrame, periods: list[Period]) -> DataFrame:
    """Smallest occupancy over all periods, 0 when one is empty."""
    return (occupancy(people, periods).groupBy("useruuid")
            .agg(F.when(F.count("*") == len(periods), F.min("occupancy")).otherwise(0.0).alias("occupancy")))


def cross_occupancy(people: DataFrame, periods: list[Period], share: float,
                    strict: bool = False) -> DataFrame:
    """Users seen in at least ``share`` of the bins of every period."""
    lowest = lowest_occupancy(people, periods)
    enough = F.col("occupancy") > share if strict else F.col("occupancy") >= share
    # A user absent from a period is never selected, even for a share of 0.
    return lowest.filter(enough & (F.col("occupancy") > 0)).select("useruuid")


def occupancy_curve(people: DataFrame, periods: list[Period], steps: int = 100) -> DataFrame:
    """Users with at least x of every period, for x = 0, 1/steps, ..."""
    lowest = lowest_occupancy(people, periods)
    reached = F.least(F.floor(F.col("occupancy") * steps + 1e-9), F.lit(steps - 1)).cast("bigint")
    counted = lowest.groupBy(reached.alias("step")).agg(F.count("*").alias("users"))
    frame = people.sparkSession.range(steps).select(F.col("id").alias("step"))
    filled = frame.join(counted, "step", "left").fillna(0, ["users"])
    placed = running_total(filled, [F.desc("step")], [-F.col("step")], {"users": "upto"})
    return placed.select((F.col("step") / steps).alias("share"), F.col("upto").alias("users"))


def _days_by_month(df: DataFrame, zone: str) -> DataFrame:
    day = F.to_date(local(F.col("start_time"), zone))
    return (df.select("useruuid", day.alias("day")).distinct()
            .groupBy("useruuid", F.date_format("day", "yyyy-MM").alias("month"))
            .agg(F.count("*").alias("days")))


def users_with_days(df: DataFrame, groups: list[tuple[str, str]], least: int) -> DataFrame:
    """Users with at least ``least`` distinct days in both parts of each group.

    ``groups`` names pairs of columns of ``df`` rows' period, e.g.
    [("2015-09", "2015-10"), ("2015-10", "2015-11")] for train and test months.
    Returns user and one flag per group, ``group1``, ``group2``.
    """
    per_month = _days_by_month(df, "UTC")
    return _groups_with_days(per_month, groups, least)


def users_with_period_days(people_days: DataFrame, groups: list[tuple[int, int]],
                           least: int) -> DataFrame:
    """The same on a table of user, month (here: period number) and days."""
    return _groups_with_days(people_days, groups, least)


def _groups_with_days(per_month: DataFrame, groups: list[tuple], least: int) -> DataFrame:
    def enough(month: object) -> F.Column:
        return F.max(F.when((F.col("month") == F.lit(month)) & (F.col("days") >= least), 1).otherwise(0))
    flags = [(enough(first) * enough(second)).alias(f"group{index}")
             for index, (first, second) in enumerate(groups, start=1)]
    result = per_month.groupBy("useruuid").agg(*flags)
    anywhere = F.lit(False)
    for index in range(1, len(groups) + 1):
        anywhere = anywhere | (F.col(f"group{index}") == 1)
    return result.filter(anywhere)


def days_by_period(df: DataFrame, bounds: list[tuple[str, str]]) -> DataFrame:
    """Distinct start days per user and period of days (first, last)."""
    day = F.to_date("start_time")
    number = F.lit(None).cast("int")
    for index, (first, last) in enumerate(bounds, start=1):
        inside = F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
        number = F.when(inside, index).otherwise(number)
    return (df.select("useruuid", day.alias("day")).distinct().withColumn("month", number)
            .filter(F.col("month").isNotNull())
            .groupBy("useruuid", "month").agg(F.count("*").alias("days")))


def users_every_day(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Users with an update on every day of the range."""
    day = F.to_date("start_time")
    first, last = F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day))
    seen = df.select("useruuid", day.alias("day")).filter(F.col("day").between(first, last)).distinct()
    return (seen.groupBy("useruuid").agg(F.count("*").alias("days"))
            .filter(F.col("days") == F.datediff(last, first) + 1).select("useruuid"))


def users_with_few_gaps(df: DataFrame, first_day: str, last_day: str, below: int) -> DataFrame:
    """Users with fewer than ``below`` days without an update."""
    return (activity(df, first_day, last_day).filter(F.col("empty_days") < below)
            .select("useruuid", "empty_days"))


def updates_by_period(people: DataFrame, periods: list[Period]) -> DataFrame:
    """Rows per user in each period (columns rows1..) and the number of empty periods."""
    numbered = people.withColumn("period", period_of(F.col("time_bin"), periods))
    indexes = range(1, len(periods) + 1)
    sums = numbered.groupBy("useruuid").agg(
        *[F.count_if(F.col("period") == index).alias(f"rows{index}") for index in indexes])
    empty = sum(((F.col(f"rows{index}") == 0).cast("int") for index in indexes), F.lit(0))
    return sums.withColumn("empty_periods", empty)


def users_by_empty_periods(people: DataFrame, periods: list[Period]) -> DataFrame:
    return (updates_by_period(people, periods).groupBy("empty_periods")
            .agg(F.count("*").alias("users")))


def day_patterns(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Days with an update as bit words, 62 days each, plus the active days.

    Only days that were seen are opened; the words of a range are as many for
    every user, those without a day are 0.
    """
    days = covered_days(F.col("start_time"), F.col("end_time"), "UTC", (first_day, last_day))
    start = F.to_date(F.lit(first_day))
    seen = df.select("useruuid", F.explode_outer(days).alias("day")).distinct().withColumn(
        "offset", F.datediff("day", start))
    bit = F.expr(f"shiftleft(1L, cast(offset % {WORD} as int))")
    words = seen.groupBy("useruuid", F.floor(F.col("offset") / WORD).alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.count("offset").alias("active"))
    last_word = F.floor(F.datediff(F.to_date(F.lit(last_day)), start) / WORD)
    own = F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "bits"))))
    return words.groupBy("useruuid").agg(own.alias("own"), F.sum("active").alias("active")).select(
        "useruuid", F.transform(F.sequence(F.lit(0).cast("bigint"), last_word),
                                lambda word: F.coalesce(F.try_element_at("own", word), F.lit(0).cast("bigint"))).alias("pattern"),
        "active")


def _different(first: F.Column, second: F.Column) -> F.Column:
    """Days on which two patterns differ."""
    return F.aggregate(F.zip_with(first, second, lambda a, b: F.bit_count(a.bitwiseXOR(b))),
                       F.lit(0), lambda total, bits: total + bits)


def near_duplicates(df: DataFrame, first_day: str, last_day: str, days: int,
                    agree: float = 0.9, active: float = 0.5) -> DataFrame:
    """Groups of users whose active days agree on at least ``agree`` of the days.

    Users active on less than ``active`` of the days are left out. Users with
    equal patterns form one node, so a common pattern costs one row. Groups are
    the components of the similar nodes.
    """
    allowed = days - ceil(days * agree)
    users = stage(day_patterns(df, first_day, last_day).filter(
        F.col("active") >= days - ceil(days * (1 - active))), "patterns")
    patterns = users.groupBy("pattern").agg(F.min("useruuid").alias("useruuid"), F.count("*").alias("members"))
    near = _near_by_flips if days <= WORD and _flips(days, (allowed + 1) // 2) <= 2000 else _near_by_bands
    similar = near(patterns, days, allowed)
    joined = patterns.join(components(similar), "useruuid", "left").select(
        "pattern", "members", F.coalesce("component", "useruuid").alias("component"))
    grouped = users.join(joined, "pattern").select("useruuid", "component")
    sizes = grouped.groupBy("component").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    return grouped.join(sizes, "component").select("useruuid", F.col("component").alias("duplicate_group"))


def _flips(days: int, most: int) -> int:
    """Number of ways to change at most ``most`` of the days."""
    return sum(comb(days, count) for count in range(most + 1))


def _near_by_flips(patterns: DataFrame, days: int, allowed: int) -> DataFrame:
    """Pairs that differ on at most ``allowed`` days, for short ranges.

    Two such patterns meet in a third one that differs from the first on half
    of these days at most and from the second on the rest. A meeting point has
    a bounded number of patterns around it, whatever the number of users.
    """
    def around(most: int) -> F.Column:
        masks = [sum(1 << day for day in chosen)
                 for count in range(most + 1) for chosen in combinations(range(days), count)]
        changed = F.transform(F.array(*[F.lit(mask).cast("bigint") for mask in masks]),
                              lambda mask: F.col("pattern")[0].bitwiseXOR(mask))
        return F.explode(changed).alias("meeting")

    left = patterns.select(F.col("useruuid").alias("user1"), around((allowed + 1) // 2))
    right = patterns.select(F.col("useruuid").alias("user2"), around(allowed // 2))
    return (left.join(right, "meeting").filter(F.col("user1") != F.col("user2"))
            .select(F.least("user1", "user2").alias("user1"), F.greatest("user1", "user2").alias("user2"))
            .distinct())


def _near_by_bands(patterns: DataFrame, days: int, allowed: int) -> DataFrame:
    """Pairs that differ on at most ``allowed`` days, for long ranges.

    Of ``allowed + 1`` bands of days at least one is equal in such a pair.
    """
    edges = [round(index * days / (allowed + 1)) for index in range(allowed + 2)]
    bands = F.array(*[F.struct(F.lit(index).alias("band"),
                               F.transform("pattern", lambda word, number: _band(word, number, low, high))
                               .alias("slice"))
                      for index, (low, high) in enumerate(zip(edges, edges[1:]))])
    keyed = patterns.select("useruuid", "pattern", F.explode(bands).alias("key")).select(
        "useruuid", "pattern", "key.*")
    left = keyed.select(F.col("useruuid").alias("user1"), F.col("pattern").alias("pattern1"), "band", "slice")
    right = keyed.select(F.col("useruuid").alias("user2"), F.col("pattern").alias("pattern2"), "band", "slice")
    return (grid_join(left, right, ["band", "slice"], "user1", "user2")
            .filter((F.col("user1") < F.col("user2"))
                    & (_different(F.col("pattern1"), F.col("pattern2")) <= allowed))
            .select("user1", "user2").distinct())


def _band(word: F.Column, number: F.Column, low: int, high: int) -> F.Column:
    """Bits of one word that belong to the days [low, high)."""
    first = F.greatest(F.lit(low) - number * WORD, F.lit(0))
    stop = F.least(F.lit(high) - number * WORD, F.lit(WORD))
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), (stop - first).cast("int")) - 1
    mask = F.call_function("shiftleft", ones, first.cast("int"))
    return F.when(stop > first, word.bitwiseAND(mask)).otherwise(F.lit(0).cast("bigint"))


def adjacent_duplicates(df: DataFrame, first_day: str, last_day: str, days: int,
                        agree: float = 0.9, active: float = 0.5) -> DataFrame:
    """Similar neighbours only: users sorted by active days, each compared with the next."""
    allowed = days - ceil(days * agree)
    users = with_bucket(day_patterns(df, first_day, last_day), "useruuid")
    chunk = F.struct("active", "_part")
    lined = with_previous(users, [], ["active", "useruuid"], chunk, ["useruuid", "pattern", "active"])
    busy = F.col("previous_active") >= days - ceil(days * (1 - active))
    return (lined.filter(F.col("previous_useruuid").isNotNull() & busy
                         & (_different(F.col("pattern"), F.col("previous_pattern")) <= allowed))
            .select(F.col("previous_useruuid").alias("user1"), F.col("useruuid").alias("user2")))
