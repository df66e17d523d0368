"""Repeated passages by a sparse suffix array.

Suffixes are kept at minimiser positions only: of every WINDOW runs of
GRAM words the one with the smallest hash. Where two documents share LEAST
words, both keep a suffix at the same place of the passage, whose first HEAD
words lie inside it. The suffixes are sorted by those words; neighbours with
equal heads are candidates. Each candidate is extended to the left and to the
right over the words of both texts and is a repeat from LEAST words on.

Suffixes with equal heads are ordered by document: each is compared with the
first of them, so copies of one passage meet in one document. Runs of LEAST
words around a head that go beyond that match may stand in other documents of
the group: they are emitted by hash, and each is compared with the first
document that has the same. So every shared run of LEAST words is found.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiescope.llm import rows, words
from tiescope.session import stage

LEAST = 50
GRAM = 5
WINDOW = 16
HEAD = LEAST - WINDOW + 1
#: Bits, as a power of two, of the filter for the documents whose texts are moved: eight for each within these
#: limits. It only saves work; beyond 2 ** 24 documents more and more others pass.
LEAST_BITS, MOST_BITS = 16, 27
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def run_hashes(hashed: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on."""
    powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(hashed), _BASE, np.uint64)))
    inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(hashed), _INVERSE, np.uint64)))
    sums = np.append(np.uint64(0), np.cumsum(hashed * powers[:-1]))
    return words.mix((sums[at + size] - sums[at]) * inverse[at])


def suffix_heads(hashed: np.ndarray, row: np.ndarray):
    """(hash of the first HEAD words, row, word) of the suffixes at minimisers."""
    none = np.zeros(0, np.int64)
    gram, first = words.windows(hashed, row, GRAM)
    n = len(gram) - WINDOW + 1
    if n <= 0:
        return none.astype(np.uint64), none, none
    # the place in the low bits: of equal runs the first counts
    best = gram & np.uint64(0xFFFFFFFFFF000000) | (np.arange(len(gram)) & 0xFFFFFF).astype(np.uint64)
    span = 1
    while span < WINDOW:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    start = np.flatnonzero(row[first[:n]] == row[first[WINDOW - 1:]])
    place = (best[start] & np.uint64(0xFFFFFF)).astype(np.int64)
    place += start & ~0xFFFFFF
    place[place < start] += 1 << 24
    chosen = np.zeros(len(gram), bool)
    chosen[place] = True
    at = first[chosen]
    end = np.searchsorted(row, row, "right")
    at = at[at + HEAD <= end[at]]
    return run_hashes(hashed, at, HEAD), row[at], at


def _suffixes(docs: DataFrame) -> DataFrame:
    """(key, ord, row, pos) of all kept suffixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, "text", rows.SMALL_SLICE):
                data, offsets = rows.raw_text(part.column("text"))
                starts, ends, row = words.spans(data, offsets)
                key, owner, at = suffix_heads(words.hashes(data, starts, ends, lower=False), row)
                begin = np.searchsorted(row, owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), part.column("ord").take(pa.array(owner)),
                     part.column("row").take(pa.array(owner)), pa.array((at - begin).astype(np.int32))],
                    ["key", "ord", "row", "pos"])

    return docs.select("ord", "row", "text").mapInArrow(run, "key bigint, ord bigint, row bigint, pos int")


def _candidates(suffixes: DataFrame) -> DataFrame:
    """(key, ox, x, px, y, py): suffixes with an equal head and the first of them.

    Further suffixes of the first document come with itself as ``y``. Rows come
    sorted; a task holds a batch, the first row of the open key and the last row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, order, row, pos = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "ord", "row", "pos"))
            if open_key is not None:
                key, order, row, pos = (np.append(a, b) for a, b in zip(open_key[2], (key, order, row, pos)))
            new = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            first_row, first_pos = row[begin], pos[begin]
            if open_key is not None:
                first_row[0], first_pos[0] = open_key[0], open_key[1]
            y, py = first_row[group], first_pos[group]
            yield pa.RecordBatch.from_arrays([pa.array(c[~new]) for c in (key, order, row, pos, y, py)],
                                             ["key", "ox", "x", "px", "y", "py"])
            open_key = (y[-1], py[-1], (key[-1:], order[-1:], row[-1:], pos[-1:]))

    ordered = suffixes.repartition("key").sortWithinPartitions("key", "ord", "row", "pos")
    return ordered.mapInArrow(run, "key bigint, ox bigint, x bigint, px bigint, y bigint, py bigint")


def matches(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start in a, start in b, words, first anchor) of the longest equal runs through the anchors.

    An anchor inside a run on its own diagonal adds nothing; short runs are given too.
    """
    found = []
    diagonal, end = None, -1
    differ = np.zeros(0, np.int64)
    for shift, pa_, pb in sorted((p - q, p, q) for p, q in anchors):
        if shift != diagonal:
            diagonal, end = shift, -1
            low, high = max(0, shift), min(len(a), len(b) + shift)
            differ = np.flatnonzero(a[low:high] != b[low - shift:high - shift]) + low
        if pa_ < end:
            continue
        k = int(np.searchsorted(differ, pa_))
        start = int(differ[k - 1]) + 1 if k else max(0, shift)
        end = int(differ[k]) if k < len(differ) else min(len(a), len(b) + shift)
        if end > pa_:  # else the heads' hashes agree and the words don't
            found.append((start, start - shift, end - start, pa_))
    return found


def open_runs(n: int, anchors: list[tuple[int, int]], found: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Starts of the runs of LEAST words around the anchors' heads that go beyond the anchors' matches.

    ``n`` is the number of words of the text, ``found`` what ``matches`` gives.
    """
    held = defaultdict(list)
    for start, other, size, _ in found:
        held[start - other].append((start, start + size))
    place, low, high = [], [], []
    for p, q in anchors:
        spans = held.get(p - q, [])
        k = bisect_right(spans, (p, n + 1)) - 1
        start, end = spans[k] if k >= 0 and p < spans[k][1] else (p, p)
        place.append(p), low.append(start), high.append(end)
    place, low, high = (np.array(c, np.int64)[:, None] for c in (place, low, high))
    starts = place - np.arange(LEAST - HEAD + 1)
    return np.unique(starts[(starts >= 0) & (starts + LEAST <= n) & ((starts < low) | (starts + LEAST > high))])


def _extended(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(x, ox, y, sx, sy, size, run) for the pairs (x, ox, px, y, py) of candidates.

    Their matches, short ones too, with a null ``run``; and the hash ``run`` of
    every open run of LEAST words from ``sx`` on, with null y, sy and size.
    """
    grouped = pairs.groupBy("x", "y").agg(  # a document's own suffixes
        F.first("ox").alias("ox"), F.collect_list(F.struct("px", "py")).alias("anchors"))
    names = ["x", "ox", "y", "sx", "sy", "size", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, ("tx", "ty"), rows.SMALL_SLICE):
                yield extended(part)

    def hashes_of(texts: pa.Array) -> list[np.ndarray]:
        data, offsets = rows.raw_text(texts)
        starts, ends, row = words.spans(data, offsets)
        return np.split(words.hashes(data, starts, ends, lower=False), np.searchsorted(row, np.arange(1, len(texts))))

    def extended(part: pa.RecordBatch) -> pa.RecordBatch:
        x, ox, y = (part.column(c).to_pylist() for c in ("x", "ox", "y"))
        # a first document stands beside many others, row after row: its words are hashed once
        firsts = np.flatnonzero([k == 0 or y[k] != y[k - 1] for k in range(len(y))])
        second = hashes_of(part.column("ty").take(pa.array(firsts)))
        of = np.searchsorted(firsts, np.arange(len(y)), "right") - 1
        out = []
        for k, (own, places) in enumerate(zip(hashes_of(part.column("tx")), part.column("anchors").to_pylist())):
            anchors = [(p["px"], p["py"]) for p in places]
            found = matches(own, second[of[k]], anchors) if x[k] != y[k] else []
            out += [(x[k], ox[k], y[k], *match[:3], None) for match in found]
            at = open_runs(len(own), anchors, found)
            if len(at):
                values, first = np.unique(run_hashes(own, at, LEAST).astype(np.int64), return_index=True)
                out += [(x[k], ox[k], None, p, None, None, v) for p, v in zip(at[first].tolist(), values.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(7)], names)

    text = docs.select("row", "text")
    return (grouped.join(text.select(F.col("row").alias("x"), F.col("text").alias("tx")), "x")
            .join(text.select(F.col("row").alias("y"), F.col("text").alias("ty")), "y")
            .mapInArrow(run, ", ".join(f"{name} bigint" for name in names)))


def _parted(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents whose row is wanted, with few others, and the rest."""
    wanted = stage(wanted, "suffix-wanted")
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * wanted.count()).bit_length()))
    cell = f"pmod(xxhash64(row), {1 << bits})"
    words_set = (wanted.select(F.expr(f"cast({cell} div 64 as int)").alias("w"),
                               F.expr(f"shiftleft(1L, cast({cell} % 64 as int))").alias("b"))
                 .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())  # at most 2 ** MOST_BITS / 64 rows
    mask = np.zeros(1 << bits - 6, np.int64)
    mask[words_set.column("w").to_numpy()] = words_set.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(mask)
    columns = docs.columns

    def part(bit: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("cell").to_numpy()
                good = (shared.value[at >> 6] >> (at & 63) & 1) == bit
                yield batch.select(columns).filter(pa.array(good))

        return docs.withColumn("cell", F.expr(cell)).mapInArrow(run, docs.schema)

    return part(1), part(0)


def numbered(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with a fixed row number ``row``, their order ``ord`` and ``text``; written once."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"),
                             F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1)).alias("ord"),
                             F.col(text).alias("text")), "suffix-documents")


def repeats(docs: DataFrame) -> DataFrame:
    """(row, start, size, other, removed) of the passages that documents share.

    ``docs`` is what ``numbered`` gives. A passage is LEAST words at least
    that stand in two documents; ``start`` and ``size`` count words. The
    occurrence in the later document (by key, null last, then row) is
    ``removed`` and ``other`` is the row it was found in; the earlier one is
    listed too, with itself as other. Repeats inside one document don't count.
    Null and empty texts, and tables without repeats, give no rows.
    """
    rows.ship(docs.sparkSession)
    found = stage(_candidates(_suffixes(docs)), "suffix-candidates")
    shared = found.filter("x <> y")
    own = found.filter("x = y").join(shared.select("key").distinct(), "key", "left_semi")
    part = stage(_parted(docs, shared.select(F.explode(F.array("x", "y")).alias("row")).distinct())[0]
                 .select("row", "text"), "suffix-texts")
    first = stage(_extended(shared.unionByName(own).drop("key"), part), "suffix-matches")
    # runs that the first document of the head does not have, or not at this place
    runs = first.filter("run is not null").select("run", "ox", "x", F.col("sx").alias("px"))
    heads = (runs.groupBy("run").agg(F.min(F.struct("ox", "x", "px")).alias("head"), F.min("x").alias("low"),
                                     F.max("x").alias("high")).filter("low <> high").select("run", "head"))
    again = runs.join(heads, "run").filter("x <> head.x").select(
        "x", "ox", "px", F.col("head.x").alias("y"), F.col("head.px").alias("py"))
    second = stage(_extended(again, part).filter("run is null"), "suffix-matches")
    both = first.filter("run is null").unionByName(second).filter(F.col("size") >= LEAST)
    cut = both.select(F.col("x").alias("row"), F.col("sx").alias("start"), "size", F.col("y").alias("other"),
                      F.lit(True).alias("removed"))
    left = both.select(F.col("y").alias("row"), F.col("sy").alias("start"), "size", F.col("y").alias("other"),
                       F.lit(False).alias("removed"))
    return cut.unionByName(left).distinct()


def remove(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (with ``row``) without the removed passages; a text without any is as it was and is not moved.

    ``docs`` is read twice, so give a stored table.
    """
    spans = stage(found.filter("removed").groupBy("row")
                  .agg(F.collect_set(F.struct("start", "size")).alias("_spans")), "suffix-spans")  # a document's own passages
    touched, others = _parted(docs, spans.select("row"))
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, spans_of = batch.column(text), batch.column("_spans").to_pylist()
            for k, own in enumerate(spans_of):
                if not own:
                    out.append(texts[k].as_py())
                    continue
                data, offsets = rows.raw_text(texts.slice(k, 1))
                starts = np.append(words.spans(data, offsets)[0], len(data))
                gone = np.zeros(len(data), bool)
                for span in own:
                    gone[starts[span["start"]]:starts[span["start"] + span["size"]]] = True
                out.append(data[~gone].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.string())], [*kept, text])

    joined = touched.select(*kept, text).join(spans, "row", "left")
    ordered = rows.extended(docs, kept, f"`{text}` string")
    return joined.mapInArrow(run, ordered).select(*docs.columns).unionByName(others)
