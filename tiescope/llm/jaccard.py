"""Exact Jaccard join of shingle sets by parity sketches.

A set's sketch is a row of blocks; each shingle is XOR-ed, as a 64-bit hash,
into one block. Two sets' sketches differ in at most as many blocks as the
sets differ in shingles, and sets with Jaccard J >= 3/4 of sizes a and b
differ in at most (a + b) / 7. So of all non-empty blocks, put in one global
random order, the first d + 1 of either set share one, where d is the largest
possible difference for a set of that size: sets are joined on those blocks.
The number of blocks follows the size band of the larger set; a set emits for
its own band and, where a partner may be in the next, for that too. Sets with
no more than d blocks that aren't empty also emit their first shingles, which
join two such sets.

Work on crowded blocks grows with their rows, not with pairs. A first pass
links every set to the first set of some of its blocks; whatever is one
component then needs no further pairs. Blocks that still hold several
components are joined in full if they have few sets. Larger ones (a passage
that many documents share) are taken back: their sets emit their rarer
shingles instead, frequent ones last. Only sets with hardly a rare shingle are
compared with each other.
Candidates pass a bit sketch (parities, Hamming distance at most the size of
the difference) before their shingles are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiescope.llm import rows, words
from tiescope.operators import graph
from tiescope.session import stage

SHINGLE = 5
#: Sets of a block that are joined pair by pair.
FULL_BLOCK = 16
#: Sets of a cell of a block in which all sets are compared, and words of sketches that are compared at once.
CELL_SETS = 1024
COMPARED_WORDS = 1 << 18
#: Pairs that a task remembers to have tried; a pair forgotten is tried again.
RECENT = 1 << 16
#: Bits of a block's name that are moved. Blocks that fall together by that are one block: work, no lost link.
NAME_BITS = 40
#: Rows of a block that a task holds before it gives them out.
HELD_ROWS = 1 << 16
#: One of so many blocks takes part in the first pass.
FIRST_PASS = 16
#: Bits, as a power of two, of the bitmaps that name sets and frequent shingles: eight for each value within these
#: limits. They only save work; beyond 2 ** 24 values more and more others pass.
LEAST_BITS, MOST_BITS = 16, 27
LINK, OF = 75, 100
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """Distinct shingle hashes of each row, ascending, and where each row's begin.

    A text of fewer words is one shingle; a text without a word has none.
    """
    starts, ends, row = words.spans(data, offsets)
    hashed = words.hashes(data, starts, ends)
    n = len(offsets) - 1
    token, first = words.windows(hashed, row, SHINGLE)
    owner = row[first]
    size = np.bincount(row, minlength=n)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        at = np.searchsorted(row, short)
        folded = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            here = size[short] > k
            folded[here] = words.mix(folded[here] + hashed[at[here] + k] + _U(k + 101))
        token, owner = np.concatenate([token, folded]), np.concatenate([owner, short])
    order = np.argsort(token)
    narrow = np.uint16 if n < 1 << 16 else np.int64
    order = order[np.argsort(owner[order].astype(narrow), kind="stable")]
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def fingerprints(token: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit name of each set, positive; sets without shingles have 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(token + _U(17)))])
    name = words.mix(total[begin[1:]] - total[begin[:-1]]) >> _U(1)
    return np.where(np.diff(begin) > 0, name, _U(0)).astype(np.int64)


def bit_sketches(token: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Parity of the shingles at each bit; two to four bits for each shingle."""
    size = np.diff(begin)
    bits = np.maximum(64, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    place = (words.mix(token + _U(23)).astype(np.int64) & (bits[owner] - 1)) + base[owner]
    packed = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8:b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def near_enough(a: bytes, b: bytes, size_a: int, size_b: int) -> bool:
    """Whether sizes and sketches allow a link."""
    if OF * min(size_a, size_b) < LINK * max(size_a, size_b):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):  # folding in half keeps parities, as places are taken from low bits
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum()) <= (size_a + size_b) // 7


def band(size: np.ndarray) -> np.ndarray:
    """Blocks of the sketch, a power of four: half to two shingles for each block."""
    return 4 ** np.ceil(np.log(np.maximum(size, 2) / 2) / np.log(4) - 1e-9).astype(np.int64)


def block_keys(token: np.ndarray, begin: np.ndarray):
    """(key, set, rank, limit) of the non-empty blocks of all sets in the bands they emit for.

    ``rank`` is the key's place in the global order within set and band; the
    first ``limit`` are emitted. Sets with too few blocks add shingles.
    """
    size = np.diff(begin)
    largest = size + (4 * size // 3)
    limit = largest // 7 + 1
    out = []
    own, other = band(size), band(4 * size // 3)
    for turn, (blocks, members) in enumerate(((own, size > 0), (other, (size > 0) & (own != other)))):
        members = np.flatnonzero(members)
        if not len(members):
            continue
        at = rows.ragged(begin[members], size[members])
        owner = np.repeat(members, size[members])
        part = (words.mix(token[at] + _U(31)) % blocks[owner].astype(np.uint64)).astype(np.int64)
        base = np.zeros(len(size), np.int64)
        base[members] = np.cumsum(blocks[members]) - blocks[members]
        order = np.argsort(base[owner] + part, kind="stable")
        place = (base[owner] + part)[order]
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        value = np.bitwise_xor.reduceat(words.mix(token[at][order] + _U(37)), new)
        owner, part = owner[order][new], part[order][new]
        key = words.mix(value + words.mix((part << 8 | np.log2(blocks[owner]).astype(np.int64)).astype(np.uint64)))
        out.append((key, owner, limit[owner]))
        if turn == 0:
            poor = np.flatnonzero((np.bincount(owner, minlength=len(size)) < limit) & (size > 0))
            at = rows.ragged(begin[poor], size[poor])
            who = np.repeat(poor, size[poor])
            out.append((words.mix(token[at] + _U(41)), who, (size - -(-3 * size // 4) + 1)[who]))
    keys, owners, limits, ranks = [], [], [], []
    for key, owner, most in out:
        order = np.argsort(key)
        order = order[np.argsort(owner[order].astype(np.uint16 if len(size) < 1 << 16 else np.int64), kind="stable")]
        key, owner, most = key[order], owner[order], most[order]
        head = np.searchsorted(owner, owner)
        keys.append(key.astype(np.int64))
        owners.append(owner)
        limits.append(most)
        ranks.append(np.arange(len(key)) - head)
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (keys, owners, ranks, limits))


def describe(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, with n_shingles, the set's name ``s``, its bit sketch and the text's hash ``t``."""
    rows.ship(df.sparkSession)
    df = df.withColumn("t", F.xxhash64(text))
    kept = [c for c in df.columns if c not in (text, "n_shingles", "s", "sketch")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, text, rows.SMALL_SLICE):
                token, begin = shingle_sets(*rows.raw_text(part.column(text)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [
                        pa.array(np.diff(begin)), pa.array(fingerprints(token, begin)),
                        pa.array(bit_sketches(token, begin), pa.binary())], [*kept, "n_shingles", "s", "sketch"])

    return df.mapInArrow(run, rows.extended(df, kept, "n_shingles bigint, s bigint, sketch binary"))


def _each_set(df: DataFrame, make, schema: str, wanted=None) -> DataFrame:
    """What ``make(token, begin, names)`` gives for the sets of the texts, each set once a task.

    Texts that the task has had, and those whose hash is not in the bitmap
    ``wanted`` (a broadcast one), are left out before they are cut into words.
    """
    rows.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's documents
        known: set[int] = set()
        for batch in batches:
            hashed = batch.column("t").to_numpy()
            new = np.zeros(len(hashed), bool)
            new[np.unique(hashed, return_index=True)[1]] = True
            if wanted is not None:
                new &= _in_mask(wanted.value, hashed)
            new &= np.array([t not in known for t in hashed.tolist()], bool)
            known.update(hashed[new].tolist())
            batch = batch.filter(pa.array(new, pa.bool_()))
            for part in rows.slices(batch, "text", rows.SMALL_SLICE):
                token, begin = shingle_sets(*rows.raw_text(part.column("text")))
                names = fingerprints(token, begin)
                fresh = []
                for k, name in enumerate(names.tolist()):
                    if name and name not in seen:
                        seen.add(name)
                        fresh.append(k)
                fresh = np.array(fresh, np.int64)
                size = np.diff(begin)[fresh]
                token = token[rows.ragged(begin[fresh], size)]
                yield make(token, np.concatenate([[0], np.cumsum(size)]), names[fresh])

    return df.select("text", F.xxhash64("text").alias("t")).mapInArrow(run, schema)


def _named(key: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Rows (key, s) of blocks, by the first bits of their 64-bit names."""
    short = (key.astype(np.uint64) >> _U(64 - NAME_BITS)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(short), pa.array(names)], ["key", "s"])


def _emit(token, begin, names):
    key, owner, rank, limit = block_keys(token, begin)
    first = rank < limit
    return _named(key[first], names[owner[first]])


def _shared(emitted: DataFrame) -> DataFrame:
    """(key, head, s) of the blocks that more than one set emits, from a stream sorted by key.

    ``head`` is the block's smallest set. A task holds one batch and the last
    block so far. A block of HELD_ROWS rows or more is given out in parts: its
    head is the smallest set of the first part, and a set that several tasks
    emitted may come again in a later part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last block, which may go on
        size, given = 0, None  # their number, and (key, head) of a block of which a part has been given out

        def blocks(key, s):
            nonlocal given
            order = np.lexsort((s, key))
            key, s = key[order], s[order]
            new = np.append(True, key[1:] != key[:-1])
            twin = np.append(False, ~new[1:] & (s[1:] == s[:-1]))  # the same set from several tasks
            group = np.cumsum(new) - 1
            heads, many = s[new], np.bincount(group, ~twin) > 1
            if given is not None and given[0] == key[0]:
                heads[0], many[0] = given[1], True
            give = many[group] & ~twin
            given = (key[-1], heads[-1])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[give], heads[group[give]], s[give])],
                                              ["key", "head", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, s = batch.column("key").to_numpy(), batch.column("s").to_numpy()
            begin = int(np.searchsorted(key, key[-1]))  # of the batch's last block
            if begin or (held and held[0][0][0] != key[0]):  # what is held is whole with the batch's first rows
                yield blocks(*(np.concatenate(x) for x in zip(*held, (key[:begin], s[:begin]))))
                held, size = [], 0
            held.append((key[begin:], s[begin:]))
            size += len(key) - begin
            if size >= HELD_ROWS:
                part = [np.concatenate(x) for x in zip(*held)]
                if given is not None and given[0] == key[-1] or (part[1] != part[1][0]).any():
                    yield blocks(*part)
                    held, size = [], 0
                else:  # one set so far: one row tells as much
                    held, size = [(part[0][:1], part[1][:1])], 1
        if held:
            yield blocks(*(np.concatenate(x) for x in zip(*held)))

    return emitted.mapInArrow(run, "key bigint, head bigint, s bigint")


def _sorted(df: DataFrame) -> DataFrame:
    """Rows dealt and sorted by key: sorting spills, so a crowded key needs no memory. One number is sorted by its digits."""
    return df.repartition("key").sortWithinPartitions("key")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link: 100 * intersection >= 75 * union, exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy() for c in ("ta", "tb"))  # no copies
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(OF * both >= LINK * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good, pa.bool_())),
                                              batch.column("b").filter(pa.array(good, pa.bool_()))], ["a", "b"])

    def side(c: str) -> DataFrame:  # shingles of other sets are not moved
        named = sets.join(pairs.select(F.col(c).alias("s")).distinct(), "s", "left_semi")
        return named.select(F.col("s").alias(c), F.col("tokens").alias(f"t{c}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def pruned(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bit sketches allow to link; sketches are moved only where the sizes do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("xa", "xb", "na", "nb")]
            good = pa.array([near_enough(*x) for x in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    side = lambda c, name, out: sizes.select(F.col("s").alias(c), F.col(name).alias(out + c))
    near = (pairs.select("a", "b").join(side("a", "n", "n"), "a").join(side("b", "n", "n"), "b")
            .filter(OF * F.least("na", "nb") >= LINK * F.greatest("na", "nb")).distinct())
    return (near.join(side("a", "sketch", "x"), "a").join(side("b", "sketch", "x"), "b")
            .mapInArrow(run, "a bigint, b bigint"))


def _merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """(s, c) with the components that the links join put together."""
    named = lambda c, out: label.select(F.col("s").alias(c), F.col("c").alias(out))
    joined = (links.join(named("a", "user1"), "a").join(named("b", "user2"), "b")
              .filter("user1 <> user2").select(F.least("user1", "user2").alias("user1"),
                                               F.greatest("user1", "user2").alias("user2")).distinct())
    joined = stage(joined, "jaccard-links")
    if joined.isEmpty():
        return label
    root = graph.components(joined).select(F.col("useruuid").alias("c"), F.col("component").alias("root"))
    return stage(label.join(root, "c", "left").select("s", F.coalesce("root", "c").alias("c")), "jaccard-labels")


def _open_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in blocks of at most FULL_BLOCK sets, sizes permitting.

    ``members`` has key, s, c, n and ``many``, the sets of the block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        recent: list = [None] * RECENT  # two sets share many blocks

        def pairs():
            found = set()
            for i, x in enumerate(held):
                for y in held[:i]:
                    if x[2] != y[2] and OF * min(x[3], y[3]) >= LINK * max(x[3], y[3]):
                        pair = (min(x[1], y[1]), max(x[1], y[1]))
                        place = hash(pair) % RECENT
                        if recent[place] != pair:
                            recent[place] = pair
                            found.add(pair)
            return found

        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "s", "c", "n"))):
                if held and held[0][0] != row[0]:
                    found |= pairs()
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = pairs()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    small = members.filter(F.col("many") <= FULL_BLOCK).select("key", "s", "c", "n")
    return _sorted(small).mapInArrow(run, "a bigint, b bigint").distinct()


def close_pairs(name: np.ndarray, c: np.ndarray, n: np.ndarray, sketch: list[bytes],
                first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sets of different components that sizes and sketches allow to link.

    Where ``first`` marks some sets, a pair has one that is marked and one
    that isn't; with all of them marked any two sets are a pair.
    """
    out = [np.zeros((2, 0), np.int64)]
    width = np.array([len(x) // 8 for x in sketch], np.int64)
    inner = bool(first.all())
    words_of = {w: np.frombuffer(b"".join(sketch[k] for k in np.flatnonzero(width == w)), np.uint64).reshape(-1, w)
                for w in np.unique(width).tolist()}
    for w, low in words_of.items():
        left = np.flatnonzero(width == w)
        # sizes that may link differ by a third at most, so a sketch is as long as the other or twice that
        for v in (w, 2 * w):
            if v not in words_of:
                continue
            right = np.flatnonzero(width == v)
            high = words_of[v] if v == w else words_of[v][:, :w] ^ words_of[v][:, w:]
            step = max(1, COMPARED_WORDS // (w * len(right)))
            for at in range(0, len(left), step):
                i, j = left[at:at + step, None], right[None, :]
                fit = (c[i] != c[j]) & (OF * np.minimum(n[i], n[j]) >= LINK * np.maximum(n[i], n[j]))
                if not inner:
                    fit &= first[i] != first[j]
                if v == w:
                    fit &= name[i] < name[j] if inner else first[i]
                x, y = np.nonzero(fit)
                apart = np.zeros(len(x), np.int64)
                for k in range(0, len(x), COMPARED_WORDS // w + 1):
                    part = slice(k, k + COMPARED_WORDS // w + 1)
                    apart[part] = np.bitwise_count(low[at + x[part]] ^ high[y[part]]).sum(1, dtype=np.int64)
                a, b = left[at + x], right[y]
                good = apart <= (n[a] + n[b]) // 7
                out.append(np.stack([a[good], b[good]]))
    return tuple(np.concatenate(out, axis=1))


def met_before(lower: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the ascending lists at the places ``a`` and ``b`` have a value in common."""
    size = lower.value_lengths().to_numpy().astype(np.int64)
    found = np.zeros(len(a), bool)
    if not size.sum():
        return found
    values, code = np.unique(lower.flatten().to_numpy(), return_inverse=True)
    held = np.repeat(np.arange(len(size)), size) * len(values) + code  # ascending
    begin, step = np.cumsum(size) - size, max(1, COMPARED_WORDS // int(size.max()))
    for at in range(0, len(a), step):
        x, y = a[at:at + step], b[at:at + step]
        asked = np.repeat(y, size[x]) * len(values) + code[rows.ragged(begin[x], size[x])]
        hit = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
        found[at:at + step] = np.bincount(np.repeat(np.arange(len(x)), size[x]), hit, len(x)) > 0
    return found


def _unsettled(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(key, s, c, many) of the blocks that hold more than one component."""
    members = shared.join(label, "s")
    open_keys = (members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"),
                                            F.count("*").alias("many"))
                 .filter("low <> high").select("key", "many"))
    return members.select("key", "s", "c").join(open_keys, "key")


def _mask(values: DataFrame) -> np.ndarray:
    """A bitmap with the hashes of the values of the only column, a 64-bit number, sized by their count."""
    name = values.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * values.count()).bit_length()))
    place = F.col(name).bitwiseAND((1 << bits) - 1)
    found = (values.select((place / 64).cast("int").alias("w"), F.expr(
        f"shiftleft(1L, cast(`{name}` & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())  # at most 2 ** MOST_BITS / 64 rows
    mask = np.zeros(1 << bits - 6, np.int64)
    mask[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return mask


def _in_mask(mask: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & 64 * len(mask) - 1
    return (mask[place >> 6] >> (place & 63) & 1).astype(bool)


def _texts_of(names: DataFrame, described: DataFrame):
    """A bitmap, broadcast, of the hashes of the texts whose sets are named."""
    texts = stage(described.join(names, "s", "left_semi").select("t").distinct(), "jaccard-texts")
    return names.sparkSession.sparkContext.broadcast(_mask(texts))


class Sets:
    """Shingles of the sets that were candidates so far, in the shared folder."""

    def __init__(self, docs: DataFrame, described: DataFrame):
        self.docs, self.described, self.parts, self.names = docs, described, [], None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The staged pairs (a, b) whose sets link; sets that aren't held yet are made from the texts."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
        if self.names is not None:
            wanted = wanted.join(self.names, "s", "left_anti")
        wanted = stage(wanted, "jaccard-names")
        if not wanted.isEmpty():
            def make(token, begin, names):
                return pa.RecordBatch.from_arrays([pa.array(names), rows.list_array(token.astype(np.int64), begin)], ["s", "tokens"])

            texts = _texts_of(wanted, self.described)
            self.parts.append(stage(_each_set(self.docs, make, "s bigint, tokens array<bigint>", texts), "jaccard-sets"))
            self.names = wanted if self.names is None else stage(self.names.unionByName(wanted), "jaccard-names")
        held = self.parts[0]
        for part in self.parts[1:]:
            held = held.unionByName(part)
        return verified(pairs, held).distinct()  # a set may come from several tasks


def _linked(label: DataFrame, pairs: DataFrame, sets: Sets) -> DataFrame:
    """The labels once the pairs' true links are merged."""
    pairs = stage(pairs, "jaccard-pairs")
    return label if pairs.isEmpty() else _merge(label, sets.verified(pairs))


def components(described: DataFrame, docs: DataFrame) -> DataFrame:
    """(s, c): each set that has a link, and the smallest name of the sets that links reach from it.

    ``described`` is what ``describe`` gives, ``docs`` the texts it was made of.
    """
    sizes = stage(described.filter("n_shingles > 0").groupBy("s").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "jaccard-sizes")
    sets = Sets(docs, described)
    shared = stage(_shared(_sorted(_each_set(docs, _emit, "key bigint, s bigint"))), "jaccard-shared")
    label = stage(shared.select("s").distinct().select("s", F.col("s").alias("c")), "jaccard-labels")

    # first pass: to the heads of some blocks, for each set the one it shares most with and the smallest
    voted = (shared.filter((F.col("key") % FIRST_PASS == 0) & (F.col("head") != F.col("s")))
             .groupBy("head", "s").count()
             .groupBy("s").agg(F.max(F.struct("count", "head")).alias("top"),
                               F.min(F.struct("head", "count")).alias("low"))
             .select("s", F.explode(F.array_distinct(F.array("top.head", "low.head"))).alias("a"))
             .select("a", F.col("s").alias("b")))
    label = _linked(label, pruned(voted, sizes), sets)

    label, crowded = _settled(shared, label, sizes, sets)
    if crowded is not None:
        label, crowded = _settled(stage(_again(crowded, docs, described), "jaccard-shared"), label, sizes, sets)
    if crowded is not None:
        label = _linked(label, _all_pairs(crowded, sizes), sets)
    return label


def _settled(shared: DataFrame, label: DataFrame, sizes: DataFrame, sets: Sets):
    """Labels after all links inside blocks of few sets, and the crowded blocks that stay open (or None)."""
    members = stage(_unsettled(shared.select("key", "s"), label), "jaccard-open")
    if members.isEmpty():
        return label, None
    # blocks of few sets pair by pair, the others to two of their sets
    crowded = members.filter(F.col("many") > FULL_BLOCK)
    heads = crowded.groupBy("key").agg(F.min("s").alias("a"), F.max("s").alias("z"))
    tried = crowded.join(heads, "key").select(F.explode(F.array("a", "z")).alias("a"), F.col("s").alias("b"))
    pairs = _open_pairs(members.join(sizes.select("s", "n"), "s")).unionByName(
        tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b"))
    label = _linked(label, pruned(pairs, sizes), sets)
    crowded = stage(_unsettled(crowded.select("key", "s"), label), "jaccard-crowded")
    return label, None if crowded.isEmpty() else crowded


def _again(crowded: DataFrame, docs: DataFrame, described: DataFrame) -> DataFrame:
    """(key, head, s): what the sets of crowded blocks share by their rarer shingles.

    A pair with a set of no crowded block has been found. Among the others
    the first shingles decide, in an order that puts those of more than
    FULL_BLOCK of these sets last: of n shingles any two linked sets share one
    of the first n - ceil(0.75 n) + 1. Which sets, and which shingles are
    frequent, is told by bitmaps; that those name a few more does no harm, as
    the order is the same for all.
    """
    context = docs.sparkSession.sparkContext
    named = _texts_of(crowded.select("s").distinct(), described)

    def chosen(token, begin, names):
        return words.mix(token + _U(41)).astype(np.int64), names, np.diff(begin)

    def repeated(token, begin, names):
        # a slice of texts has hundreds of sets: what only one of them has is not frequent
        key, times = np.unique(chosen(token, begin, names)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key[times > 1]), pa.array(times[times > 1])], ["key", "n"])

    counted = _each_set(docs, repeated, "key bigint, n bigint", named).groupBy("key").agg(F.sum("n").alias("n"))
    counted = stage(counted.filter(F.col("n") > FULL_BLOCK).select("key"), "jaccard-frequent")
    frequent = context.broadcast(_mask(counted))

    def first(token, begin, names):
        key, names, size = chosen(token, begin, names)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((key, _in_mask(frequent.value, key), owner))
        place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
        kept = order[place < (size - -(-3 * size // 4) + 1)[owner]]
        return _named(key[kept], names[owner[kept]])

    return _shared(_sorted(_each_set(docs, first, "key bigint, s bigint", named)))


def _all_pairs(crowded: DataFrame, sizes: DataFrame, cell_sets: int = CELL_SETS) -> DataFrame:
    """Pairs of different components in blocks that stay crowded, sketches permitting: sets of hardly anything else.

    Members are dealt to cells of about ``cell_sets`` sets; each pair of cells of a block is one group, whose
    sketches are compared as arrays. Two sets may share many of these blocks; the first of them gives the pair.
    Blocks go by 32 bits of a hash here, as their names are most of what is moved; those of one hash are one block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the group so far

        def pairs():
            group = pa.Table.from_batches(held)
            name, c, n, cell = (group.column(x).to_numpy() for x in ("s", "c", "n", "cell"))
            a, b = close_pairs(name, c, n, group.column("sketch").to_pylist(), cell == cell.min())
            new = ~met_before(pa.concat_arrays(group.column("lower").chunks), a, b)
            a, b = name[a[new]], name[b[new]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            begin = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
            for at, end in zip(begin, [*begin[1:], len(key)]):
                if held and key[at] != last:
                    yield pairs()
                    held = []
                last = key[at]
                held.append(batch.slice(at, end - at))
        if held:
            yield pairs()

    crowded = crowded.select(F.hash("key").alias("key"), "s", "c").distinct()
    crowded = stage(crowded.join(crowded.groupBy("key").agg(F.count("*").alias("many")), "key"), "jaccard-crowded")
    blocks = crowded.groupBy("s").agg(F.sort_array(F.collect_set("key")).alias("blocks"))
    member = crowded.join(sizes.join(blocks, "s"), "s").withColumn(
        "lower", F.filter("blocks", lambda block: block < F.col("key"))).withColumn("cells", F.ceil(F.col("many") / cell_sets).cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64("s"), F.col("cells")).cast("int"))
    spread = member.select("key", "s", "c", "n", "sketch", "lower", "cell",
                           F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    grouped = spread.select(F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other")).alias("key"),
                            "s", "c", "n", "sketch", "lower", "cell")
    return _sorted(grouped).mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every document.

    ``component_id`` is the smallest key that links reach. Texts without words
    (null and empty too) link with nothing. Repeated rows are kept and link to
    themselves; a null key is the component only of documents that link to no
    other. An empty table gives no rows.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    described = stage(describe(source), "jaccard-documents")
    label = components(described, source)
    named = described.select("id", "n_shingles", "s").join(label, "s", "left").withColumn(
        "c", F.when(F.col("s") != 0, F.coalesce("c", "s")))
    smallest = named.filter("c is not null").groupBy("c").agg(F.min("id").alias("low"))
    return (named.join(smallest, "c", "left")
            .select(F.col("id").alias(key), "n_shingles", F.coalesce("low", "id").alias("component_id")))
