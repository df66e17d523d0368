"""Packing token sequences by non-negative least squares on the length histogram.

Documents longer than a window give full windows and a tail. The tails'
lengths, in steps of ``UNIT`` tokens, form a histogram. All combinations of
three lengths that fill a window exactly, and those of one length repeated and
one more, are the columns of a least squares problem with non-negative repeat counts; the counts are rounded and
the tails dealt to them. What is left over is packed greedily: laid end to end
and cut at the window's edge.

Only the histogram and the plan, whose sizes depend on the window alone, reach
the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiescope.llm import rows
from tiescope.session import stage

WINDOW = 4096
UNIT = 8
#: Rows of one group when rows are numbered in groups.
GROUP_ROWS = 50_000
#: Members at most of a combination that repeats one length.
DEPTH = 32


def combinations(units: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and their multiplicities of the combinations that fill ``units``.

    All a <= b <= c, and k times a with one b for k up to DEPTH. Length 0
    stands for no member.
    """
    lengths, times = [], []
    for a in range(units // 3 + 1):
        b = np.arange(a, (units - a) // 2 + 1)
        lengths.append(np.stack([np.full(len(b), a), b, units - a - b], 1))
        times.append(np.ones((len(b), 3), np.int64))
    for k in range(3, DEPTH + 1):
        a = np.arange(1, units // k + 1)
        lengths.append(np.stack([a, units - k * a, np.zeros_like(a)], 1))
        times.append(np.tile([k, 1, 1], (len(a), 1)))
    return np.concatenate(lengths), np.concatenate(times)


def solve(histogram: np.ndarray, columns: np.ndarray, times: np.ndarray, limit: int = 2000) -> np.ndarray:
    """Repeat counts x >= 0 of the columns, near to histogram = A x (active set method).

    ``histogram[k]`` is the number of tails of k units; entry 0 is ignored.
    """
    scale = max(1.0, float(histogram.max(initial=0)))
    target = np.append(histogram[1:] / scale, 0.0)  # place -1 takes the absent members
    x = np.zeros(len(columns))
    active: list[int] = []
    rest = target.copy()
    norms = np.sqrt((times * times * (columns > 0)).sum(1))
    matrix = np.zeros((0, len(target)))
    for _ in range(limit):
        rest[-1] = 0
        slope = (rest[columns - 1] * times).sum(1) / norms
        slope[active] = -1
        best = int(slope.argmax())
        if slope[best] < 1e-6:
            break
        active.append(best)
        column = np.bincount((columns[best] - 1) % len(target), times[best], len(target))
        column[-1] = 0
        matrix = np.concatenate([matrix, column[None]])
        while True:
            gram = matrix @ matrix.T + 1e-9 * np.eye(len(active))
            wanted = np.linalg.solve(gram, matrix @ target)
            if wanted.min() > 0:
                break
            now = x[active]
            low = wanted <= 0
            step = (now[low] / np.maximum(now[low] - wanted[low], 1e-15)).min()
            now = now + step * (wanted - now)
            stay = now > 1e-12
            x[active] = np.where(stay, now, 0)
            active = [c for c, s in zip(active, stay) if s]
            matrix = matrix[stay]
            if not active:
                wanted = np.zeros(0)
                break
        x[active] = wanted
        rest = target - wanted @ matrix
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(units, first rank, ranks, first sequence, slot) of the tails that whole combinations take."""
    columns, times = combinations(len(histogram) - 1)
    counts = solve(histogram, columns, times)
    used = np.zeros(len(histogram), np.int64)
    free = histogram.astype(np.int64).copy()
    out, sequence = [], 0
    for c in np.argsort(-counts, kind="stable"):
        if counts[c] < 0.5:
            break
        members = [int(u) for u, m in zip(columns[c], times[c]) for _ in range(m) if u]
        n = min([int(round(counts[c]))] + [int(free[u]) // members.count(u) for u in members])
        if n <= 0:
            continue
        for slot, u in enumerate(members):
            out.append((u, int(used[u]), n, sequence, slot))
            used[u] += n
            free[u] -= n
        sequence += n
    return out


def _numbered(df: DataFrame, by: list[str], amount: F.Column, total: int, name: str) -> DataFrame:
    """Running sum of ``amount`` before each row, within ``by``, over any number of rows.

    Rows are dealt to groups of about GROUP_ROWS by their hash, so that no
    task gets all rows of a frequent key; then the sums of the groups before
    are added. The order is by group and row.
    """
    dealt = df.withColumn("_amount", amount).withColumn(
        "_group", F.pmod(F.xxhash64("row"), F.lit(1 + total // GROUP_ROWS)))
    sums = dealt.groupBy(*by, "_group").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, "_group").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_inner", F.coalesce(F.sum("_amount").over(inner), F.lit(0)))
            .join(sums, [*by, "_group"]).withColumn(name, F.col("_inner") + F.col("_before"))
            .drop("_amount", "_group", "_inner", "_before"))


def pack(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of documents with ``row`` (unique) and ``n`` tokens.

    Each token of a document lies in exactly one piece, pieces lie gapless
    from offset 0 in sequences of at most ``window`` tokens. Documents with
    n = 0 give no piece; an empty table gives no rows.
    """
    rows.ship(lengths.sparkSession)
    if window % UNIT:
        raise ValueError(f"the window must be a multiple of {UNIT}")
    lengths = lengths.select("row", F.col("n").cast("long").alias("n"))
    full = lengths.filter(F.col("n") >= window).select(
        "row", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {window} - 1"))).alias("k"))
    tails = (lengths.withColumn("length", F.col("n") % window).filter("length > 0")
             .withColumn("units", F.ceil(F.col("length") / UNIT).cast("int"))
             .select("row", "units", "length", (F.col("n") - F.col("length")).alias("start")))
    counted = tails.groupBy("units").count().toPandas()  # window / UNIT rows at most
    histogram = np.zeros(window // UNIT + 1, np.int64)
    histogram[counted["units"]] = counted["count"]
    taken = sorted(plan(histogram))
    starts = np.array([(u << 40) + r for u, r, *_ in taken], np.int64)  # ranks of one length follow each other

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, slots = (np.array([t[k] for t in taken], np.int64) for k in (2, 3, 4))
        units_of = np.array([t[0] for t in taken], np.int64)
        for batch in batches:
            units, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("units", "rank"))
            sequence, slot = np.full(len(units), -1), np.full(len(units), -1)
            if len(starts):
                at = np.searchsorted(starts, (units << 40) + rank, "right") - 1
                begun = starts[np.maximum(at, 0)] & (1 << 40) - 1
                good = (at >= 0) & (units_of[np.maximum(at, 0)] == units) & (rank - begun < sizes[np.maximum(at, 0)])
                sequence = np.where(good, first[at] + rank - begun, -1)
                slot = np.where(good, slots[at], -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "start", "length")] + [pa.array(sequence), pa.array(slot)],
                ["row", "start", "length", "sequence", "slot"])

    ranked = _numbered(tails, ["units"], F.lit(1).cast("long"), int(histogram.sum()), "rank")
    dealt = stage(ranked.select("row", "start", "length", "units", "rank").mapInArrow(
        deal, "row bigint, start bigint, length bigint, sequence bigint, slot bigint"), "packing-dealt")
    before = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.filter("sequence >= 0").select(
        "row", "start", "length", (F.col("sequence") * 3 + 1).alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    loose = _numbered(dealt.filter("sequence < 0").withColumn("one", F.lit(1)), ["one"], F.col("length"),
                      int(histogram.sum()), "at")
    edge = F.expr(f"(at div {window} + 1) * {window}")
    cut = loose.withColumn("head", F.least(F.col("length"), edge - F.col("at")))
    pieces = F.array(F.struct(F.col("start"), F.col("head").alias("length"), F.col("at")),
                     F.struct((F.col("start") + F.col("head")).alias("start"),
                              (F.col("length") - F.col("head")).alias("length"),
                              (F.col("at") + F.col("head")).alias("at")))
    rest = (cut.select("row", F.explode(pieces).alias("p")).select("row", "p.*").filter("length > 0")
            .select("row", "start", "length", F.expr(f"(at div {window}) * 3 + 2").alias("sequence_id"),
                    F.expr(f"at % {window}").alias("offset")))
    count = lengths.agg(F.coalesce(F.sum(F.expr(f"n div {window}")), F.lit(0)).alias("n")).first().n
    numbered = _numbered(full.withColumn("row", F.struct("row", "k")).withColumn("one", F.lit(1)), ["one"],
                         F.lit(1).cast("long"), int(count), "number")
    windows = numbered.select("row.row", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                              (F.col("number") * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return windows.unionByName(whole).unionByName(rest)


def checksums(pieces: DataFrame, tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` with the checksum of each piece's ids and the further columns of ``tokens``.

    ``tokens`` (a written table) has ``row``, ``ids``, ``sums`` (the checksum of
    every ``window`` ids, see ``wordids.tokenize``) and any further columns. A
    piece that is one of these windows, whole, has its checksum there; only for
    documents that were cut elsewhere, one in a sequence at most, are the ids
    themselves looked up.
    """
    rows.ship(tokens.sparkSession)
    made = {"start", "length", "sequence_id", "offset", "ids_crc32", "_whole", "_sum"}
    kept = [c for c in tokens.columns if c not in ("row", "ids", "sums", *made)]
    known = tokens.select("row", *kept, "sums", F.size("ids").alias("_whole"))
    plain = (F.col("start") % window == 0) & (F.col("length") == F.least(F.lit(window), F.col("_whole") - F.col("start")))
    joined = pieces.join(known, "row")
    told = [*kept, "start", "length", "sequence_id", "offset"]
    whole = joined.filter(plain).select(*told, F.get("sums", (F.col("start") / window).cast("int")).alias("ids_crc32"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("part")
            data, begin = ids.flatten().to_numpy(), np.cumsum([0] + ids.value_lengths().to_pylist()).tolist()
            sums = [zlib.crc32(data[a:b].astype("<u4").tobytes()) for a, b in zip(begin, begin[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in told] + [pa.array(sums, pa.int64())], [*told, "ids_crc32"])

    # written, so that its size is known before the ids of all documents would be moved
    cut = stage(joined.filter(~plain).select("row", *told), "packing-cut")
    part = F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    own = cut.join(tokens.select("row", "ids"), "row").select(*told, part.alias("part"))
    return whole.unionByName(own.mapInArrow(run, rows.extended(own, told, "ids_crc32 bigint")))
