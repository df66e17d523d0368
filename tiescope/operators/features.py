"""Features of a pair of users, as aggregates over its co-occurrences.

One pass makes everything that depends on the co-occurrences alone: cell
statistics travel through the pair join as columns, then one shuffle by pair
feeds a window and two aggregates. Features that depend on the users (contacts,
apps, age, gender, activity) are joined to the aggregated pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiescope.config import BinConfig, Period
from tiescope.functions.binning import bin_start
from tiescope.functions.calendar import is_evening, is_saturday_night, is_weekend
from tiescope.operators.cleaning import in_period, plausible_people, sessions_in_period
from tiescope.operators.graph import TASK_MASKS, common_contacts, contacts_met, with_common_contacts
from tiescope.operators.ordering import encode, lookup
from tiescope.operators.pairing import (BLOCK_ROWS, PAIR_TASK_ROWS, attach_both, both_selected, co_occurrences_by_pair,
                                        met_next, pair_blocks, pair_key)
from tiescope.operators.presence import (CELL, location_entropy, user_activity, with_arrivals)
from tiescope.session import stage

PAIR = ["user1", "user2"]

# Column order of the full feature vector.
FEATURES = [
    "two_unique", "arr_leav", "diversity", "unique_coocs", "weighted_frequency", "coocs_w",
    "common_travels", "num_coocs", "mutual", "app_jaccard", "evenings", "weekends",
    "specificity", "age_far", "age_near", "age_unknown", "gender_differs", "gender_same",
    "gender_unknown",
]

# Column order of the production subset.
CORE_FEATURES = [
    "num_coocs", "unique_coocs", "diversity", "weighted_frequency", "weekends", "evenings",
    "coocs_w", "mutual", "specificity",
]


def select_features(table: DataFrame, features: Sequence[int | str],
                    keep: Sequence[str] = (*PAIR, "label")) -> DataFrame:
    """Columns by feature number (position in ``FEATURES``) or name."""
    names = [FEATURES[item] if isinstance(item, int) else item for item in features]
    return table.select(*[name for name in keep if name in table.columns], *names)


#: Flags of presence that co-occurrences carry for both users.
FLAGS = ("arrived", "leaves")


def cell_context(people: DataFrame, ref_compat: bool = False) -> DataFrame:
    """Per cell and bin: population, arrivals, leavers and exp(-entropy).

    ``people`` carries the arrival flags. The entropy is joined per cell, so
    one spatial bin contributes as many rows as there are time bins, however
    many people were there. ``ref_compat`` weighs leaving by the newcomers of
    the next bin (at least 1) in place of those who left.
    """
    cells = people.groupBy(*CELL).agg(
        F.count("*").alias("people"),
        F.count_if(F.col("arrived")).alias("arrivals"),
        F.count_if(F.col("leaves")).alias("leavers"))
    if ref_compat:
        newcomers = cells.select("spatial_bin", (F.col("time_bin") - 1).alias("time_bin"),
                                 F.col("arrivals").alias("newcomers"))
        cells = (cells.join(newcomers, CELL, "left").drop("leavers")
                 .withColumn("leavers", F.greatest(F.coalesce("newcomers", F.lit(0)), F.lit(1)))
                 .drop("newcomers"))
    calm = location_entropy(people).select("spatial_bin", F.exp(-F.col("entropy")).alias("calm"))
    return cells.filter(F.col("people") >= 2).join(calm, "spatial_bin")


def with_context(people: DataFrame, ref_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Staged presence with arrival flags, and staged statistics of its cells."""
    flagged = stage(with_arrivals(people), "flagged")
    return flagged, stage(cell_context(flagged, ref_compat), "cells")


def context_coocs(people: DataFrame, block_rows: int = BLOCK_ROWS,
                  ref_compat: bool = False) -> DataFrame:
    """Co-occurrences, by pair, with the statistics of their cell and both arrival flags."""
    flagged, cells = with_context(people, ref_compat)
    return co_occurrences_by_pair(flagged, cells, FLAGS, block_rows)


def arrive_leave_term() -> Column:
    """Timed arrival and leaving of one co-occurrence.

    Both came into the cell in this bin: one over the number of arrivals. Both
    are gone in the next bin: one over the number of leavers.
    """
    came = F.when(F.col("arrived1") & F.col("arrived2"), 1.0 / F.col("arrivals")).otherwise(0.0)
    went = F.when(F.col("leaves1") & F.col("leaves2"), 1.0 / F.col("leavers")).otherwise(0.0)
    return came + went


def with_travels(coocs: DataFrame) -> DataFrame:
    """Marks the last row of every common travel of a pair with 1, others 0.

    A travel is a run of at least two consecutive bins in which each step goes
    to another cell. The window holds one pair, a few rows per time bin.
    """
    pair = Window.partitionBy(*pair_key(coocs)).orderBy("time_bin", "spatial_bin")
    so_far = pair.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.coalesce(F.col("time_bin") - F.lag("time_bin").over(pair) == 1, F.lit(False))
    continues = F.coalesce(F.lead("time_bin").over(pair) - F.col("time_bin") == 1, F.lit(False))
    stays = follows & (F.col("spatial_bin") == F.lag("spatial_bin").over(pair))
    return (coocs
            .withColumns({"_follows": follows, "_continues": continues,
                          "_stays": F.coalesce(stays, F.lit(False)).cast("int")})
            .withColumn("_stayed", F.sum("_stays").over(so_far))
            .withColumn("_at_start", F.max(F.when(~F.col("_follows"), F.col("_stayed"))).over(so_far))
            .withColumn("travel", (F.col("_follows") & ~F.col("_continues")
                                   & (F.col("_stayed") == F.col("_at_start"))).cast("int"))
            .drop("_follows", "_continues", "_stays", "_stayed", "_at_start"))


def common_travels(coocs: DataFrame) -> DataFrame:
    key = pair_key(coocs)
    return (with_travels(coocs.select(*key, *CELL)).groupBy(*key)
            .agg(F.sum("travel").alias("common_travels")).drop("task"))


def diversity_of(visits: str, num: Column, log_base: str = "2") -> Column:
    """exp of the entropy of the cell shares, from the aggregated visit counts."""
    log = F.log2 if log_base == "2" else F.log
    return F.exp(log(num) - F.sum(F.col(visits) * log(F.col(visits))) / num)


def cell_visits(coocs: DataFrame) -> DataFrame:
    """Co-occurrences of each pair per cell, partitioned by pair.

    Rows that lie by pair already (``co_occurrences_by_pair``) stay where they
    are. Otherwise one shuffle by pair serves this count and every aggregate
    per pair that follows; counting first would not make the rows of a shuffle
    much fewer, as a pair seldom meets twice in the rows of one task.
    """
    key = pair_key(coocs)
    rows = coocs.select(*key, "spatial_bin")
    if "task" not in key:
        rows = rows.repartition(*PAIR)
    return rows.groupBy(*key, "spatial_bin").agg(F.count("*").alias("visits"))


def place_features(coocs: DataFrame, log_base: str = "2") -> DataFrame:
    """num_coocs, unique_coocs, two_unique and diversity of plain co-occurrences."""
    num = F.sum("visits")
    return (cell_visits(coocs).groupBy(*pair_key(coocs))
            .agg(num.alias("num_coocs"), F.count("*").alias("unique_coocs"),
                 (F.count("*") >= 2).cast("int").alias("two_unique"),
                 diversity_of("visits", num, log_base).alias("diversity")).drop("task"))


def labelled_places(coocs: DataFrame, period: Period, following: Period) -> DataFrame:
    """num_coocs and unique_coocs of the pairs of a period, and whether they met in the following one.

    ``coocs`` spans both periods, so the label needs no join of pairs with pairs.
    """
    when, key = F.col("time_bin"), pair_key(coocs)
    per_cell = coocs.groupBy(*key, "spatial_bin").agg(
        F.count_if((when >= period.start) & (when < period.end)).alias("visits"),
        F.count_if((when >= following.start) & (when < following.end)).alias("later"))
    return (per_cell.groupBy(*key)
            .agg(F.sum("visits").alias("num_coocs"), F.count_if(F.col("visits") > 0).alias("unique_coocs"),
                 (F.sum("later") > 0).cast("int").alias("label"))
            .filter(F.col("num_coocs") > 0).drop("task"))


def time_features(coocs: DataFrame, cfg: BinConfig, zone: str = "Europe/Stockholm",
                  friday_from: int | None = 18, from_hour: int = 18) -> DataFrame:
    """Evening, weekend and Saturday-night co-occurrences."""
    when = bin_start(F.col("time_bin"), cfg)
    return coocs.groupBy(*pair_key(coocs)).agg(
        F.count_if(is_evening(when, zone, from_hour)).alias("evenings"),
        F.count_if(is_weekend(when, zone, friday_from)).alias("weekends"),
        F.count_if(is_saturday_night(when, zone, from_hour)).alias("saturday_nights")).drop("task")


def crowd_features(coocs: DataFrame) -> DataFrame:
    """coocs_w, weighted_frequency and arr_leav of co-occurrences with context."""
    return coocs.groupBy(*pair_key(coocs)).agg(
        F.avg(1.0 / (F.col("people") - 1)).alias("coocs_w"),
        F.sum("calm").alias("weighted_frequency"),
        F.avg(arrive_leave_term()).alias("arr_leav")).drop("task")


def cooc_features(coocs: DataFrame, cfg: BinConfig, zone: str = "Europe/Stockholm",
                  friday_from: int | None = 18, log_base: str = "2") -> DataFrame:
    """All features that depend on the co-occurrences (``context_coocs``) of the pair, in one pass."""
    when = bin_start(F.col("time_bin"), cfg)
    key = pair_key(coocs)
    rows = with_travels(coocs).select(
        *key, "spatial_bin", "travel", "calm",
        (1.0 / (F.col("people") - 1)).alias("rarity"),
        arrive_leave_term().alias("timed"),
        is_evening(when, zone).cast("int").alias("evening"),
        is_weekend(when, zone, friday_from).cast("int").alias("weekend"),
        is_saturday_night(when, zone).cast("int").alias("saturday"))
    # The window left the rows grouped by pair, so neither aggregate shuffles.
    per_cell = rows.groupBy(*key, "spatial_bin").agg(
        F.count("*").alias("visits"),
        *[F.sum(name).alias(name) for name in ("travel", "calm", "rarity", "timed",
                                               "evening", "weekend", "saturday")])
    num = F.sum("visits")
    return per_cell.groupBy(*key).agg(
        num.alias("num_coocs"),
        F.count("*").alias("unique_coocs"),
        (F.count("*") >= 2).cast("int").alias("two_unique"),
        diversity_of("visits", num, log_base).alias("diversity"),
        F.sum("calm").alias("weighted_frequency"),
        (F.sum("rarity") / num).alias("coocs_w"),
        (F.sum("timed") / num).alias("arr_leav"),
        F.sum("travel").alias("common_travels"),
        F.sum("evening").alias("evenings"),
        F.sum("weekend").alias("weekends"),
        F.sum("saturday").alias("saturday_nights"))


def mutual(pairs: DataFrame, closed: bool = False) -> DataFrame:
    """Jaccard index of the contact sets of two users who met.

    Open neighbourhoods leave the two users themselves out; closed ones count
    both of them in both sets. The pairs are staged, as they are read as
    edges, contacts and users.
    """
    return mutual_from(common_contacts(stage(pairs.select(*PAIR), "pairs")), closed)


def mutual_from(table: DataFrame, closed: bool = False) -> DataFrame:
    """Adds ``mutual`` to pairs that have common, degree1 and degree2."""
    union = F.col("degree1") + F.col("degree2") - F.col("common")
    both = F.col("common") + 2 if closed else F.col("common")
    return table.withColumn("mutual", both / union)


def specificity_of(activity: str = "presences") -> Column:
    """Co-occurrences as a share of the activity of both users."""
    return F.col("num_coocs") / (F.col(f"{activity}1") + F.col(f"{activity}2"))


APP_SET = "map<bigint,bigint>"


def app_sets(apps: DataFrame) -> DataFrame:
    """Set of packages per user as bit words: ``apps``, a map from word to bits, and ``n_apps``.

    Packages are numbered in the order of their names, 64 to a word; a set
    holds the words that have a bit.
    """
    used = stage(apps.select("useruuid", "package_name").filter(F.col("package_name").isNotNull()).distinct(), "used")
    slots = encode(used, "package_name").select(
        "package_name", F.shiftright("code", 6).alias("word"), F.expr("shiftleft(1L, cast(code % 64 as int))").alias("bit"))
    words = lookup(used, "package_name", slots, most=used.count()).groupBy("useruuid", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("useruuid").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("word").cast("bigint"), "bits"))).alias("apps"),
        F.sum(F.bit_count("bits")).alias("n_apps"))


def app_jaccard_of() -> Column:
    """Jaccard index of the two app sets; two empty sets are equal."""
    none = F.create_map().cast(APP_SET)
    first, second = F.coalesce("apps1", none), F.coalesce("apps2", none)
    shared = F.aggregate(F.map_entries(first), F.lit(0), lambda total, e: total + F.coalesce(
        F.bit_count(e["value"].bitwiseAND(F.try_element_at(second, e["key"]))), F.lit(0)))
    total = F.coalesce("n_apps1", F.lit(0)) + F.coalesce("n_apps2", F.lit(0)) - shared
    return F.when(total == 0, 1.0).otherwise(shared / total)


def similarity_columns() -> dict[str, Column]:
    """One-hot age and gender agreement from age1/2, gender1/2 and listed1/2.

    Genders are compared for all users in the demographic table, a missing
    one like any other value; users who aren't listed are unknown.
    """
    unknown = F.col("age1").isNull() | F.col("age2").isNull()
    near = F.abs(F.col("age1") - F.col("age2")) <= 6
    absent = F.col("listed1").isNull() | F.col("listed2").isNull()
    same = F.col("gender1").eqNullSafe(F.col("gender2"))
    flags = {
        "age_far": ~unknown & ~near, "age_near": ~unknown & near, "age_unknown": unknown,
        "gender_differs": ~absent & ~same, "gender_same": ~absent & same,
        "gender_unknown": absent,
    }
    return {name: F.coalesce(flag, F.lit(False)).cast("int") for name, flag in flags.items()}


def user_profiles(people: DataFrame, apps: DataFrame | None,
                  demographics: DataFrame | None) -> DataFrame:
    """Everything known per user, so that a pair needs two joins only."""
    profiles = user_activity(people)
    if apps is not None:
        profiles = profiles.join(app_sets(apps), "useruuid", "left")
    else:
        profiles = profiles.withColumns({"apps": F.lit(None).cast(APP_SET), "n_apps": F.lit(0)})
    if demographics is not None:
        known = demographics.select("useruuid", "gender", "age", F.lit(True).alias("listed"))
        return profiles.join(known, "useruuid", "left")
    return profiles.withColumns({"gender": F.lit(None).cast("string"), "age": F.lit(None).cast("bigint"),
                                 "listed": F.lit(None).cast("boolean")})


def period_pairs(present: DataFrame, cfg: BinConfig, zone: str = "Europe/Stockholm", users: DataFrame | None = None,
                 task_rows: int = PAIR_TASK_ROWS) -> tuple[DataFrame, int | None]:
    """Features of the pairs of a stored presence that depend on co-occurrences and contacts.

    Pairs are made in tasks, one for each two of the blocks of users, whose
    number is returned as well; contacts come to these tasks, and pairs are
    neither written nor moved. Where the co-occurrences are few (None), they are
    moved by pair, and the pairs are staged. ``users`` restricts the pairs.
    """
    flagged, cells = with_context(present)
    blocks = pair_blocks(cells, task_rows)
    if blocks is None:
        base = stage(cooc_features(co_occurrences_by_pair(flagged, cells, FLAGS, task_rows=task_rows), cfg, zone), "pairs")
        table = base.join(common_contacts(base.select(*PAIR)), PAIR)
        return (table if users is None else both_selected(table, users)), None
    masks = stage(contacts_met(present, cells, blocks), "contacts")
    blocks = max(blocks, -(-masks.count() // TASK_MASKS))
    base = cooc_features(co_occurrences_by_pair(flagged, cells, FLAGS, blocks=blocks), cfg, zone)
    if users is not None:
        base = both_selected(base, users)
    return with_common_contacts(base, masks, blocks), blocks


def dyad_features(people: DataFrame, cfg: BinConfig, period: Period, zone: str = "Europe/Stockholm",
                  apps: DataFrame | None = None, demographics: DataFrame | None = None,
                  users: DataFrame | None = None, closed: bool = False, denominator: str = "presences",
                  following: Period | None = None, task_rows: int = PAIR_TASK_ROWS) -> DataFrame:
    """Feature table of one period, a row per pair that met in it.

    Contact sets, populations and entropies use everybody; ``users`` only
    restricts the pairs that are returned. With ``following`` there is a label:
    did the pair meet in that period too.
    """
    present = stage(in_period(people, period), "presence")
    table, blocks = period_pairs(present, cfg, zone, users, task_rows)
    label = []
    if following is not None:
        table, label = met_next(table, co_occurrences_by_pair(in_period(people, following), blocks=blocks)), ["label"]
    if apps is not None:
        apps = sessions_in_period(apps, cfg, period)
    if demographics is not None:
        demographics = plausible_people(demographics)
    # written, so that their size is known before the features of all pairs would be moved to them
    profiles = stage(user_profiles(present, apps, demographics), "profiles")
    table = mutual_from(attach_both(table, profiles), closed)
    return (table
            .withColumns({"specificity": specificity_of(denominator), "app_jaccard": app_jaccard_of(),
                          **similarity_columns()})
            .select(*PAIR, *FEATURES, "saturday_nights", *label))


def labelled_features(people: DataFrame, cfg: BinConfig, period: Period, following: Period,
                      **options: object) -> DataFrame:
    """Feature table of one period with the label of the following one."""
    return dyad_features(people, cfg, period, following=following, **options)
