"""Contact graph: edges, degrees, common contacts, components, centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiescope.operators.ordering import HOT_ROWS, encode, lookup, running_total
from tiescope.operators.pairing import (attach_both, co_occurrences_by_pair, pair_key, triangle, triangle_task,
                                        user_block)
from tiescope.operators.presence import CELL
from tiescope.session import bucketed, stage

PAIR = ["user1", "user2"]
#: Words of 64 users that one row of contacts holds.
WORDS = [f"w{number}" for number in range(4)]
#: Edges of a task that looks up contacts, and rows of contacts of one of its two blocks of users.
TASK_EDGES = 1_000_000
TASK_MASKS = 250_000


def edges(coocs: DataFrame) -> DataFrame:
    """Pairs with the number of their co-occurrences as weight."""
    return coocs.groupBy(*pair_key(coocs)).agg(F.count("*").alias("weight")).drop("task")


def nodes(pairs: DataFrame) -> DataFrame:
    return ends(pairs).select("useruuid").distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """Every edge from both of its ends, in one scan."""
    other = [name for name in pairs.columns if name not in PAIR]
    both = F.array(F.struct(F.col("user1").alias("useruuid"), F.col("user2").alias("contact")),
                   F.struct(F.col("user2").alias("useruuid"), F.col("user1").alias("contact")))
    return pairs.select(F.explode(both).alias("end"), *other).select("end.*", *other)


def degrees(pairs: DataFrame) -> DataFrame:
    return ends(pairs.select(*PAIR)).groupBy("useruuid").agg(F.count("*").alias("degree"))


def weighted_degrees(weighted: DataFrame) -> DataFrame:
    return ends(weighted).groupBy("useruuid").agg(F.sum("weight").alias("weighted_degree"))


def degree_distribution(pairs: DataFrame) -> DataFrame:
    """Step form of the degree CDF.

    Sorting all degrees and plotting position / n gives, for each degree, the
    range of values from ``cdf_first`` to ``cdf_last``.
    """
    counted = degrees(pairs).groupBy("degree").agg(F.count("*").alias("users"))
    placed = running_total(counted, [F.col("degree")], [F.floor(F.log2("degree"))], {"users": "upto"})
    return placed.select("degree", "users",
                         ((F.col("upto") - F.col("users")) / F.col("upto_all")).alias("cdf_first"),
                         ((F.col("upto") - 1) / F.col("upto_all")).alias("cdf_last"))


def _contact_masks(neighbours: DataFrame) -> DataFrame:
    """Contacts of a user as bits: (user, chunk of users, a word for 64 users each).

    Users are numbered in the order of their ids; the number gives chunk, word
    and bit. It depends on the ids alone, so a recomputed task agrees.
    """
    codes = encode(neighbours, "useruuid").select(F.col("useruuid").alias("contact"), "code")
    return _masks_of(neighbours.join(codes, "contact"))


def _masks_of(coded: DataFrame) -> DataFrame:
    """Bits of (useruuid, code) rows, ``code`` the number of a contact."""
    word, bit = F.pmod(F.shiftright("code", 6), F.lit(len(WORDS))), F.expr("shiftleft(1L, cast(code % 64 as int))")
    zero = F.lit(0).cast("bigint")
    return (coded.withColumn("chunk", F.floor(F.col("code") / F.lit(64 * len(WORDS)))).groupBy("useruuid", "chunk").agg(*[
        F.bit_or(F.when(word == number, bit).otherwise(zero)).alias(name) for number, name in enumerate(WORDS)]))


def contacts_met(people: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """Contacts as bits, like ``_contact_masks``, from presence: no table of pairs is written or moved.

    Users are numbered block by block, so a task, which pairs the users of two
    blocks, fills few chunks of each and combines its rows before they move.
    """
    known = people.filter(F.col("useruuid").isNotNull())
    placed = known.select(F.struct(user_block("useruuid", blocks).alias("block"), "useruuid").alias("placed"))
    codes = encode(placed, "placed").select("placed.useruuid", "code")
    coded = stage(known.join(codes, "useruuid"), "coded")
    coocs = co_occurrences_by_pair(coded, cells.select(*CELL, "people"), ("code",), blocks=blocks)
    both = F.array(F.struct(F.col("user1").alias("useruuid"), F.col("code2").alias("code")),
                   F.struct(F.col("user2").alias("useruuid"), F.col("code1").alias("code")))
    return _masks_of(coocs.select(F.explode(both).alias("end")).select("end.*"))


def with_common_contacts(pairs: DataFrame, masks: DataFrame, blocks: int) -> DataFrame:
    """Adds ``common``, ``degree1`` and ``degree2`` to pairs that lie in the tasks of ``blocks`` blocks of users.

    ``masks`` is a stored table of contacts. It is moved to the tasks, once for
    each block; the pairs stay where they are, with all their columns.
    """
    known = stage(masks.groupBy("useruuid").agg(
        F.sum(sum((F.bit_count(name) for name in WORDS), F.lit(0))).alias("degree"), F.count("*").alias("chunks")), "known")
    others = [name for name in pairs.columns if name not in ("task", *PAIR)]
    first_is_small = F.col("chunks1") <= F.col("chunks2")
    lookups = attach_both(pairs, known, "inner").withColumns({
        "small": F.when(first_is_small, F.col("user1")).otherwise(F.col("user2")),
        "large": F.when(first_is_small, F.col("user2")).otherwise(F.col("user1"))})
    block = user_block("useruuid", blocks)
    spread = (masks.filter(F.col("useruuid").isNotNull() & F.col("chunk").isNotNull())
              .withColumns({"_block": block, "_other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
              .withColumn("task", triangle_task(blocks, F.least("_block", "_other"), F.greatest("_block", "_other")))
              .drop("_block", "_other").repartitionById(blocks * (blocks + 1) // 2, "task"))
    shared = sum((F.bit_count(F.col(f"small_{name}").bitwiseAND(F.col(f"large_{name}"))) for name in WORDS), F.lit(0))
    small, large = (spread.select("task", F.col("useruuid").alias(side), "chunk",
                                  *[F.col(name).alias(f"{side}_{name}") for name in WORDS]).hint("shuffle_hash")
                    for side in ("small", "large"))
    # the rows of a pair differ in their chunk only
    return (lookups.join(small, ["task", "small"]).join(large, ["task", "large", "chunk"], "left")
            .groupBy("task", *PAIR)
            .agg(*[F.max(name).alias(name) for name in (*others, "degree1", "degree2")],
                 F.coalesce(F.sum(shared), F.lit(0)).cast("bigint").alias("common")))


def common_contacts(pairs: DataFrame, task_edges: int = TASK_EDGES, task_masks: int = TASK_MASKS) -> DataFrame:
    """Per pair: users who met both (``common``) and the degrees of the two.

    ``pairs`` is read several times; give a stored table, not a long plan.

    From each edge the contacts of the end with fewer of them are looked up in
    those of the other end, 256 users per row. The work is at most the sum
    over the edges of the smaller degree, also when one user met everybody.

    Where users have met a good part of all others, these lookups are many more
    than the contacts. Users are then dealt to blocks by a hash and a task gets
    the edges between two blocks and the contacts of both: the contacts are
    moved once for each block, and the lookups are made and counted where they
    are. The counted rows decide which of the two moves less.
    """
    pairs = pairs.select(*PAIR)
    masks = stage(_contact_masks(ends(pairs)), "contacts")
    # written, so that its size is known before the pairs would be moved to it
    known = stage(degrees(pairs).join(masks.groupBy("useruuid").agg(F.count("*").alias("chunks")), "useruuid"), "known")
    sized = pairs
    for side in ("1", "2"):
        sized = sized.join(known.select(*[F.col(name).alias(f"{new}{side}") for name, new in (
            ("useruuid", "user"), ("degree", "degree"), ("chunks", "chunks"))]), f"user{side}")
    first_is_small = F.col("chunks1") <= F.col("chunks2")
    lookups = stage(sized.select(
        *PAIR, "degree1", "degree2", F.least("chunks1", "chunks2").alias("chunks"),
        F.when(first_is_small, F.col("user1")).otherwise(F.col("user2")).alias("small"),
        F.when(first_is_small, F.col("user2")).otherwise(F.col("user1")).alias("large")), "lookups")
    counts = lookups.agg(F.count("*").alias("edges"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("rows")).first()
    held = masks.count()
    tasks = max(-(-counts["edges"] // task_edges), 2 * pairs.sparkSession.sparkContext.defaultParallelism)
    blocks = max(triangle(tasks), -(-held // task_masks))
    key = []
    if held * blocks < counts["rows"]:
        key = ["task"]
        total = blocks * (blocks + 1) // 2

        def between(first: Column, second: Column) -> Column:
            return triangle_task(blocks, F.least(first, second), F.greatest(first, second))

        lookups = (lookups.withColumn("task", between(user_block("user1", blocks), user_block("user2", blocks)))
                   .repartitionById(total, "task"))
        masks = (masks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                 .withColumn("task", between(user_block("useruuid", blocks), F.col("_other"))).drop("_other")
                 .repartitionById(total, "task"))
    shared = F.lit(0)
    for name in WORDS:
        shared = shared + F.bit_count(F.col(f"small_{name}").bitwiseAND(F.col(f"large_{name}")))
    small, large = (masks.select(*key, F.col("useruuid").alias(side), "chunk",
                                 *[F.col(name).alias(f"{side}_{name}") for name in WORDS]) for side in ("small", "large"))
    if key:  # the edges pass by the contacts of two blocks, unsorted
        small, large = small.hint("shuffle_hash"), large.hint("shuffle_hash")
    return (lookups.drop("chunks").join(small, [*key, "small"]).join(large, [*key, "large", "chunk"], "left")
            .groupBy(*key, *PAIR)
            .agg(F.first("degree1").alias("degree1"), F.first("degree2").alias("degree2"),
                 F.coalesce(F.sum(shared), F.lit(0)).cast("bigint").alias("common")).drop("task"))


def clustering(pairs: DataFrame) -> DataFrame:
    """Triangles and clustering coefficient 2t / (d (d-1)) of every user.

    A common contact of two users who met closes a triangle; each triangle of
    a user is seen from two of the user's edges.
    """
    shared = common_contacts(stage(pairs.select(*PAIR), "pairs")).select(*PAIR, "common")
    per_user = (ends(shared).groupBy("useruuid")
                .agg(F.count("*").alias("degree"), (F.sum("common") / 2).cast("bigint").alias("triangles")))
    possible = F.col("degree") * (F.col("degree") - 1)
    return per_user.withColumn(
        "clustering", F.when(possible > 0, 2 * F.col("triangles") / possible).otherwise(0.0))


def contractions(pairs: DataFrame, hot_rows: int = HOT_ROWS) -> list[DataFrame]:
    """Staged tables (useruuid, parent), one per round, until no edge is left.

    Each user takes the contact (or itself) that comes first in the order of a
    hash, then the choice of that one. Users are replaced by their choice;
    edges inside a group go, double ones become one. The hash keeps chains of
    choices short, so the graph shrinks by a constant factor in each round.
    """
    links = stage(pairs.select(*PAIR), "links")
    maps = []
    while count := links.count():  # of a written table
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("u"))
        first = ends(links).groupBy("useruuid").agg(F.min(ranked("contact")).alias("best")).select(
            "useruuid", F.least("best", ranked("useruuid"))["u"].alias("parent"))
        chosen = stage(first, "chosen")
        further = chosen.filter(F.col("useruuid") != F.col("parent")).select(
            F.col("useruuid").alias("parent"), F.col("parent").alias("further"))
        step = stage(lookup(chosen, "parent", further, "left", hot_rows, 2 * count).select(
            "useruuid", F.coalesce("further", "parent").alias("parent")), "contracted")
        maps.append(step)
        for side in PAIR:
            renamed = step.select(F.col("useruuid").alias(side), F.col("parent").alias(f"new_{side}"))
            links = lookup(links, side, renamed, "inner", hot_rows, count)
        a, b = F.col("new_user1"), F.col("new_user2")
        links = stage(links.filter(a != b).select(F.least(a, b).alias("user1"), F.greatest(a, b).alias("user2")).distinct(),
                      "links")
    return maps


def components(pairs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Component of every user, named by its smallest user.

    The graph is contracted round by round; what lies inside a group leaves
    the work. The choices of the rounds are then followed from the last to the
    first, and groups that many users share are cut in every lookup.
    """
    maps = contractions(pairs, hot_rows)
    if not maps:
        return nodes(pairs).select("useruuid", F.col("useruuid").alias("component"))
    roots = maps[-1]
    for step in reversed(maps[:-1]):
        then = roots.select(F.col("useruuid").alias("parent"), F.col("parent").alias("root"))
        roots = stage(lookup(step, "parent", then, "left", hot_rows, step.count()).select(
            "useruuid", F.coalesce("root", "parent").alias("parent")), "roots")
    names = roots.groupBy("parent").agg(F.min("useruuid").alias("component"))
    return lookup(roots, "parent", names, "inner", hot_rows, roots.count()).select("useruuid", "component")


def eigenvector(weighted: DataFrame, tolerance: float = 1e-9, limit: int = 1000, stage_every: int = 5) -> DataFrame:
    """Eigenvector centrality by power iteration, largest value 1.

    The iteration runs on the matrix plus a multiple of the identity, a quarter
    of the largest value as the Rayleigh quotient of the rounds so far gives it.
    It has the same vectors, but where the contacts fall into two sides (a
    bipartite graph) its largest value stands alone, so the scores converge
    there as well. Rounds go on until no score changes by more than
    ``tolerance``; without that after ``limit`` rounds the result would be
    wrong, so it is an error.

    The edges are stored once in buckets by contact: no round moves them.
    """
    itself = nodes(weighted).select("useruuid", F.col("useruuid").alias("contact"),
                                    F.lit(None).cast(weighted.schema["weight"].dataType).alias("weight"))
    neighbours = bucketed(ends(weighted).select("useruuid", "contact", "weight").unionByName(itself), ["contact"], "neighbours")
    scores = stage(neighbours.select("useruuid").distinct().withColumn("score", F.lit(1.0)), "scores")
    shift = 0.0
    for _ in range(limit // stage_every):
        raw = scores
        for _ in range(stage_every):
            # Only relative sizes matter between rounds; scaling waits for a stage.
            part = F.col("score") * F.coalesce(F.col("weight").cast("double"), F.lit(shift))
            raw = (neighbours.join(raw.select(F.col("useruuid").alias("contact"), "score"), "contact")
                   .groupBy("useruuid").agg(F.sum(part).alias("score")))
        both = stage(raw.join(scores.select("useruuid", F.col("score").alias("old")), "useruuid"), "scores")
        told = both.agg(F.max("score").alias("top"), F.sum(F.col("old") * F.col("score")).alias("product"),
                        F.sum(F.col("old") * F.col("old")).alias("square")).first()
        if told["top"] is None:
            return both.select("useruuid", F.col("score").alias("centrality"))
        scaled = both.withColumn("score", F.col("score") / F.lit(told["top"]))
        moved = scaled.agg(F.max(F.abs(F.col("score") - F.col("old"))).alias("moved")).first()["moved"]
        scores = scaled.select("useruuid", "score")
        if moved <= tolerance:
            return scores.withColumnRenamed("score", "centrality")
        shift = ((told["product"] / told["square"]) ** (1 / stage_every) - shift) / 4
    raise ValueError(f"no centrality within {tolerance} after {limit} rounds")
