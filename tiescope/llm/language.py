"""Language by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 letters
of lower-cased words, a space on either side of a word), most frequent first.
A document's own list is compared with each profile by the out-of-place
distance: how far each n-gram's rank is from its rank there, at most the
profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiescope.llm import rows
from tiescope.session import stage

PROFILE = 300
#: Languages whose profiles are sent to the tasks, some 10 MB; more are joined as a table, with the same results.
SENT_LANGUAGES = 2000
#: Sums of (row, language) made at once.
CELLS = 4_000_000
UNKNOWN = "und"
_folded = np.full(0x110000, -1, np.int32)  # lower-case letter of a code point, 32 for what is no letter


def _letters(points: np.ndarray) -> np.ndarray:
    found = _folded[points]
    if (found < 0).any():
        for point in np.unique(points[found < 0]):
            char = chr(point)
            _folded[point] = ord(char.lower()[0]) if char.isalpha() else 32
        found = _folded[points]
    return found


def grams(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """Distinct (group, n-gram) with counts, ordered by group and n-gram.

    ``group`` is a small number for each row. An n-gram is a 64-bit code of
    its code points; shorter ones come first.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    sizes = np.diff(heads)
    row = np.repeat(np.arange(len(sizes)), sizes + 2)
    line = np.full(len(points) + 2 * len(sizes), 32, np.int32)
    line[np.arange(len(points)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = _letters(points)
    kept = np.ones(len(line), bool)
    kept[1:] = (line[1:] != 32) | (line[:-1] != 32) | (row[1:] != row[:-1])
    line, row = line[kept], row[kept]
    present = np.zeros(0x110000, bool)
    present[line] = True
    alphabet = np.flatnonzero(present)
    m = len(alphabet)
    base = m + m * m + m ** 3
    total = base * (int(group.max(initial=0)) + 1)
    if total >= 1 << 62:  # a great many different letters
        return _wide_grams(line, row, group)
    kind = np.int32 if total < 1 << 31 else np.int64  # narrow keys sort faster
    number = np.zeros(0x110000, kind)
    number[alphabet] = np.arange(m)
    small = number[line]
    letter, same = line != 32, row[1:] == row[:-1]
    one = small[letter]
    good = same & (letter[1:] | letter[:-1])
    two = m + (small[:-1] * m + small[1:])[good]
    good3 = same[1:] & same[:-1] & letter[1:-1] if len(line) > 2 else np.zeros(0, bool)
    three = (m + m * m + (small[:-2] * m + small[1:-1]) * m + small[2:])[good3] if len(line) > 2 else small[:0]
    owner = group.astype(kind)[row]
    keys = np.concatenate([owner[letter] * base + one, owner[:-1][good] * base + two,
                           owner[:-2][good3] * base + three if len(line) > 2 else small[:0]])
    if total <= 4 * len(keys):  # few groups: a table of all possible n-grams
        table = np.bincount(keys, minlength=1)
        found = np.flatnonzero(table)
        counts = table[found]
    else:
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(keys)))
        found = keys[at]
    which, gram = np.divmod(found.astype(np.int64), base)
    a = alphabet.astype(np.int64)
    is2, is3 = (gram >= m) & (gram < m + m * m), gram >= m + m * m
    g2, g3 = np.where(is2, gram - m, 0), np.where(is3, gram - m - m * m, 0)
    code = np.where(is3, a[g3 // (m * m)] << 42 | a[g3 // m % m] << 21 | a[g3 % m],
                    np.where(is2, a[g2 // m] << 21 | a[g2 % m], a[np.where(is2 | is3, 0, gram)]))
    return which, code, counts


def _wide_grams(line: np.ndarray, row: np.ndarray, group: np.ndarray):
    """The same by sorting groups and codes, for any number of letters."""
    points = line.astype(np.int64)
    letter, same = points != 32, row[1:] == row[:-1]
    good = same & (letter[1:] | letter[:-1])
    good3 = same[1:] & same[:-1] & letter[1:-1]
    code = np.concatenate([points[letter], (points[:-1] << 21 | points[1:])[good],
                           (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[good3]])
    owner = group.astype(np.int64)[np.concatenate([row[letter], row[:-1][good], row[:-2][good3]])]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))
    return owner[new], code[new], np.diff(np.append(new, len(code)))


def _by_count(row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Order by row, then the larger count, then the place given."""
    size, most = len(row), int(counts.max(initial=0))
    if (int(row.max(initial=0)) + 1) * (most + 1) * max(size, 1) >= 1 << 62:
        return np.lexsort((-counts, row))
    keys = (row * (most + 1) + (most - counts)) * size + np.arange(size)
    keys.sort()
    return keys % max(size, 1)


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, rank from 0, gram) of every language, from all rows with a text and a language."""
    rows.ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, "text"):
                coded = part.column("lang").dictionary_encode()
                which, code, counts = grams(*rows.raw_text(part.column("text")), coded.indices.to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(which)), pa.array(code), pa.array(counts.astype(np.int64))],
                    ["lang", "gram", "n"])

    used = (labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
            .filter(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    counted = used.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
            .select("lang", (F.col("rank") - 1).alias("rank"), "gram"))


def _leading(texts: pa.Array, size: int):
    """(row, gram, rank) of the ``size`` most frequent n-grams of each text, ordered by row and rank."""
    row, code, counts = grams(*rows.raw_text(texts), np.arange(len(texts)))
    order = _by_count(row, counts)
    row, code = row[order], code[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(texts)))[row]
    top = rank < size
    return row[top], code[top], rank[top]


def predict(df: DataFrame, profile: DataFrame, text: str = "text", size: int = PROFILE,
            sent: int = SENT_LANGUAGES) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` of every whole text.

    The language with the smallest distance, ties to the first name; the score
    is one less the distance as a share of the largest. Texts without a letter
    (null and empty too), and all if there is no profile, give 'und' and 0.
    Repeated rows are predicted alike; other columns stay, but for ones named
    like the new ones. Up to ``sent`` languages go to the tasks, more are joined.
    """
    rows.ship(df.sparkSession)
    if profile.select("lang").distinct().count() > sent:
        return _predict_joined(df, profile, text, size)
    found = profile.toArrow()  # ``size`` rows for each of ``sent`` languages at most
    names = sorted({*found.column("lang").to_pylist()})
    place = {name: k for k, name in enumerate(names)}
    order = np.argsort(found.column("gram").to_numpy(), kind="stable")
    gram = found.column("gram").to_numpy()[order].astype(np.int64)
    known, first = np.unique(gram, return_index=True)
    of = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)[order]
    shared = df.sparkSession.sparkContext.broadcast(
        (names, known, np.append(first, len(gram)), of, found.column("rank").to_numpy()[order].astype(np.int64)))
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CELLS // max(1, len(shared.value[0])))
        for batch in batches:
            for slice_ in rows.slices(batch, text):
                for k in range(0, slice_.num_rows, most):
                    yield named(slice_.slice(k, most))

    def named(part: pa.RecordBatch) -> pa.RecordBatch:
        names, known, first, of, ranks = shared.value
        n = part.num_rows
        best, score = np.full(n, -1), np.zeros(n)
        if names:
            row, code, rank = _leading(part.column(text), size)
            has = np.bincount(row, minlength=n)
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            here = known[at] == code
            at, row, rank = at[here], row[here], rank[here]
            times = first[at + 1] - first[at]
            entry = rows.ragged(first[at], times)
            # what an n-gram in the profile saves of the largest distance
            saved = size - abs(ranks[entry] - np.repeat(rank, times))
            cell = np.repeat(row, times) * len(names) + of[entry]
            saved = np.bincount(cell, saved, n * len(names)).reshape(n, -1)
            best = np.where(has > 0, saved.argmax(1), -1)
            away = has * size - saved.max(1)
            score = np.where(has > 0, 1 - away / np.maximum(has * size, 1), 0.0)
        told = pa.array([names[k] if k >= 0 else UNKNOWN for k in best.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [told, pa.array(score)],
                                          [*kept, "lang_pred", "score"])

    return df.mapInArrow(run, rows.extended(df, kept, "lang_pred string, score double"))


def _predict_joined(df: DataFrame, profile: DataFrame, text: str, size: int) -> DataFrame:
    """``predict`` with the profiles as a table that the documents' n-grams are joined with."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    numbered = stage(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.col(f"`{text}`").alias("_text"))
                     .withColumn("_row", F.monotonically_increasing_id()), "language-documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, "_text"):
                row, code, rank = _leading(part.column("_text"), size)
                yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(row)), pa.array(code), pa.array(rank)],
                                                 ["_row", "gram", "place"])

    own = stage(numbered.select("_row", "_text").mapInArrow(run, "_row bigint, gram bigint, place bigint"), "language-grams")
    has = own.groupBy("_row").agg(F.count("*").alias("has"))
    saved = (own.join(profile, "gram").groupBy("_row", "lang")
             .agg(F.sum(size - F.abs(F.col("place") - F.col("rank"))).alias("saved"))
             .groupBy("_row").agg(F.min(F.struct((-F.col("saved")).alias("less"), "lang")).alias("best")))
    first = profile.agg(F.min("lang").alias("first"))
    whole = F.col("has") * size
    score = 1 - (whole + F.coalesce("best.less", F.lit(0))) / whole
    named = (has.join(saved, "_row", "left").withColumn("first", first.scalar())
             .select("_row", F.coalesce("best.lang", "first").alias("lang_pred"), score.alias("score")))
    return numbered.join(named, "_row", "left").select(
        *[F.col("_doc").getField(c).alias(c) for c in kept], F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
