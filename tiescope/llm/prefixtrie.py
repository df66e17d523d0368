"""Prefix trie of conversations, by vertical bitmaps.

Conversations are dealt to shards of a bounded number of turns. A shard indexes
(position, turn) to a bitset of its conversations. A depth-first walk from the
root intersects the bitset of a node with the postings of the next position:
each intersection is a child, its popcount the number of members there, and the
members that are as long as the path is deep end in it. The lowest bit is the
smallest conversation, as bits follow the ids.

Nodes of all shards are put together by the digest of their path. What a node
adds to its subtree (one leaf, tokens saved) is laid on its smallest member, so
that one shard holds it; sums over subtrees are differences of running sums in
the walk's order inside each shard, added up over the shards.

A shared start is no group that has to be in one place: a third of all
conversations with the same turns are spread over the shards like all others. A
conversation longer than PIECE turns is cut, and its later pieces start from
the digest of the path before them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tiescope.llm import rows
from tiescope.session import stage

#: Turns of a conversation in one piece, and turns of a shard on average.
PIECE = 512
SHARD_TURNS = 40000
ROOT = b""

TURN = "struct<a:bigint,b:bigint,n:bigint>"


def digest(path: bytes, a: int, b: int) -> bytes:
    """Name of the path that goes on with the turn (a, b)."""
    return hashlib.blake2b(path + a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True),
                           digest_size=16).digest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, n): two hashes and the code points of each turn; null role and text are empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("turn"), role, text).alias("b"), F.length(text).cast("bigint").alias("n"))


def rebuilt(told: DataFrame, block: Column, most: int, heads: Column) -> DataFrame:
    """(conv_id, piece, entry, last, turns): pieces of conversations that start like another one.

    ``block`` names the conversation whose first turns replace as many of a
    conversation's own: ``heads`` of them, ``most`` at the most. The rows of a
    block come in order as a stream, the named conversation first; a task holds
    the first turns of that one and the open piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        weight = 0
        here = base = conv = None
        first: list[tuple] = []
        path, piece, open_ = ROOT, 0, []
        entry, skip, at = ROOT, 0, 0

        def add(turn: tuple) -> None:
            nonlocal path, piece, open_, entry, weight
            if len(open_) == PIECE:
                found.append((conv, piece, entry, False, open_))
                weight += PIECE
                piece, open_, entry = piece + 1, [], path
            open_.append({"a": turn[0], "b": turn[1], "n": turn[2]})
            path = digest(path, turn[0], turn[1])

        def batch_of() -> pa.RecordBatch:
            kinds = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("entry", pa.binary()), ("last", pa.bool_()),
                               ("turns", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])))])
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k].type) for k in range(5)], schema=kinds)

        for batch in batches:
            for block_, own, head, *turn in zip(*(batch.column(n).to_pylist() for n in ("block", "conv_id", "head", "a", "b", "n"))):
                if own != conv:
                    if conv is not None:
                        found.append((conv, piece, entry, True, open_))
                        weight += len(open_) + 1
                    if block_ != here:
                        here, first = block_, []
                    conv, base = own, own == block_
                    path, piece, open_, entry, skip, at = ROOT, 0, [], ROOT, head, 0
                    if not base:
                        for t in first[:head]:
                            add(t)
                if base and len(first) < most:
                    first.append(tuple(turn))
                if base or at >= skip:
                    add(tuple(turn))
                at += 1
                if weight > 20000:
                    yield batch_of()
                    found, weight = [], 0
        if conv is not None:
            found.append((conv, piece, entry, True, open_))
            yield batch_of()

    rows.ship(told.sparkSession)
    marked = told.withColumns({"block": block, "head": heads})
    ordered = marked.repartition("block").sortWithinPartitions(
        "block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "a", "b")
    return ordered.mapInArrow(run, f"conv_id bigint, piece bigint, entry binary, last boolean, turns array<{TURN}>")


def walk(convs: list[int], entries: list[tuple[int, bytes]], told: list[list[tuple]], last: list[bool]) -> Iterator[tuple]:
    """Nodes of a shard in depth-first order: (path, parent, depth, n, members, first, ends, size).

    ``entries`` are (turns before, path before) of the pieces, ``told`` their
    turns. ``members`` is the popcount, ``first`` the piece with the smallest
    conversation, ``ends`` the pieces whose conversation ends here, ``size`` the
    nodes of the subtree in this shard. The nodes where a conversation was cut
    belong to the shard of the piece before; only the root comes from here.
    """
    order = sorted(range(len(convs)), key=convs.__getitem__)
    postings: dict = defaultdict(int)
    starts: dict = defaultdict(int)
    stops: dict = defaultdict(int)
    for bit, k in enumerate(order):
        mark = 1 << bit
        starts[entries[k]] |= mark
        for place, turn in enumerate(told[k]):
            postings[place, turn] |= mark
        stops[len(told[k])] |= mark
    nodes = []

    def ends_of(bits: int, place: int) -> list[int]:
        ended, found = bits & stops.get(place, 0), []
        while ended:
            low = ended & -ended
            k = order[low.bit_length() - 1]
            if last[k]:
                found.append(k)
            ended ^= low
        return found

    for (before, path), members in sorted(starts.items()):
        # a stack of (bitset, place, path, parent, turn's length, node); node -1: enter, else: leave
        stack = [(members, 0, path, None, 0, -1)]
        while stack:
            bits, place, name, parent, length, node = stack.pop()
            if node >= 0:
                nodes[node][7] = len(nodes) - node
                continue
            if place or not before:
                lowest = order[(bits & -bits).bit_length() - 1]
                nodes.append([name, parent, before + place, length, bits.bit_count(), lowest, ends_of(bits, place), 1])
                stack.append((0, 0, name, None, 0, len(nodes) - 1))
            rest = bits & ~stops.get(place, 0)
            while rest:
                low = rest & -rest
                turn = told[order[low.bit_length() - 1]][place]
                child = rest & postings[place, turn]
                rest ^= child
                stack.append((child, place + 1, digest(name, turn[0], turn[1]), name, turn[2], -1))
    return iter(nodes)


def _nodes(sharded: DataFrame) -> DataFrame:
    """(shard, place, path, parent, depth, n, members, conv_id, ends, size) of every node of every shard."""
    kinds = [("shard", pa.int64()), ("place", pa.int64()), ("path", pa.binary()), ("parent", pa.binary()),
             ("depth", pa.int64()), ("n", pa.int64()), ("members", pa.int64()), ("conv_id", pa.int64()),
             ("ends", pa.list_(pa.int64())), ("size", pa.int64())]

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        convs = table.column("conv_id").to_pylist()
        entries = [(p * PIECE, e) for p, e in zip(table.column("piece").to_pylist(), table.column("entry").to_pylist())]
        told = [[(t["a"], t["b"], t["n"]) for t in own] for own in table.column("turns").to_pylist()]
        last = table.column("last").to_pylist()
        nodes = [(shard, place, path, parent, depth, n, members, convs[first], [convs[k] for k in ends], size)
                 for place, (path, parent, depth, n, members, first, ends, size)
                 in enumerate(walk(convs, entries, told, last))]
        return pa.table([pa.array([node[k] for node in nodes], kind) for k, (_, kind) in enumerate(kinds)],
                        names=[name for name, _ in kinds])

    return sharded.groupBy("shard").applyInArrow(
        run, "shard bigint, place bigint, path binary, parent binary, depth bigint, n bigint, members bigint,"
             " conv_id bigint, ends array<bigint>, size bigint")


def _subtrees(values: DataFrame) -> DataFrame:
    """(path, leaves, saved): sums over the subtree of each node inside its shard."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        until = np.arange(table.num_rows) + table.column("size").to_numpy()
        sums = []
        for name in ("leaves", "saved"):
            total = np.append(0, np.cumsum(table.column(name).to_numpy()))
            sums.append(pa.array(total[until] - total[:-1]))
        return pa.table([table.column("path"), *sums], names=["path", "leaves", "saved"])

    return values.groupBy("shard").applyInArrow(run, "path binary, leaves bigint, saved bigint")


def _digests(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256) of (path, conv_id) rows: ids in order, as a stream through the digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, hashed = None, None
        for batch in batches:
            found = []
            for own, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
                if own != path:
                    if path is not None:
                        found.append((path, hashed.hexdigest()))
                    path, hashed = own, hashlib.sha256(str(conv).encode())
                else:
                    hashed.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                              pa.array([f[1] for f in found], pa.string())], ["path", "ends_sha256"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([hashed.hexdigest()])],
                                             ["path", "ends_sha256"])

    return (ends.repartition("path").sortWithinPartitions("path", "conv_id")
            .mapInArrow(run, "path binary, ends_sha256 string"))


def trie(pieces: DataFrame, near: Column, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of ``pieces`` (see ``rebuilt``; a written table), one row each.

    ``near`` is a value of conversations that are likely to share a start and
    are few: they come into one shard.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Repeated conversations are members of
    the same nodes. Without conversations there is no node, not even a root.
    """
    rows.ship(pieces.sparkSession)
    size = pieces.agg(F.coalesce(F.sum(F.size("turns") + 1), F.lit(0)).alias("n")).first().n
    shards = size // shard_turns + 1
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64(near, "piece"), F.lit(shards)))
    local = stage(_nodes(sharded), "trie-nodes")

    nodes = local.groupBy("path").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("n").alias("n"),
        F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = stage(nodes, "trie-merged")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(
        F.count("*").alias("n_children"))
    nodes = nodes.join(children, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))

    own = nodes.select("path", "conv_id", (F.col("n_children") == 0).cast("bigint").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    laid = local.join(own, ["path", "conv_id"], "left").select(
        "shard", "place", "path", "size", "conv_id", "depth", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("leaves", "saved")])
    laid = _with_later(laid, sharded)
    sums = _subtrees(laid).groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ended = _digests(local.select("path", F.explode("ends").alias("conv_id")))
    parents = nodes.filter("n_children > 0").select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (nodes.join(sums, "path").join(ended, "path", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def _with_later(laid: DataFrame, sharded: DataFrame) -> DataFrame:
    """``laid`` with the values of a cut conversation's later pieces on the last node of each piece.

    A node's subtree goes on in the shards of its members' later pieces. The
    values there lie on nodes by their smallest conversation; they are added up
    by conversation and piece and handed to the node where the piece before is cut.
    """
    cut = sharded.filter(~F.col("last")).select("conv_id", "piece")
    if cut.isEmpty():
        return laid
    laid = stage(laid, "trie-laid")
    piece = F.when(F.col("depth") == 0, 0).otherwise(F.floor((F.col("depth") - 1) / PIECE))
    long_ = cut.select("conv_id").distinct()
    values = (laid.join(long_, "conv_id").groupBy("conv_id", piece.alias("piece"))
              .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    after = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # pieces without a value of their own count as well
    known = cut.select("conv_id", (F.col("piece") + 1).alias("piece")).join(values, ["conv_id", "piece"], "left")
    later = known.select("conv_id", (F.col("piece") - 1).alias("piece"),
                         *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in ("leaves", "saved")])
    # the path at which a piece is cut is where the next one enters
    entered = sharded.filter("piece > 0").select("conv_id", (F.col("piece") - 1).alias("piece"), F.col("entry").alias("path"))
    held = sharded.filter(~F.col("last")).select("conv_id", "piece", "shard")
    where = held.join(entered, ["conv_id", "piece"]).join(later, ["conv_id", "piece"])
    added = where.groupBy("shard", "path").agg(F.sum("later_leaves").alias("l"), F.sum("later_saved").alias("s"))
    return laid.join(added, ["shard", "path"], "left").select(
        "shard", "place", "path", "size", "conv_id", "depth",
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
