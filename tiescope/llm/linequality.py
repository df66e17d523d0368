"""Document quality from labelled line sequences.

A linear-chain conditional random field marks each line with a word as
content or boilerplate; Viterbi decoding finds the likeliest marking of a
document, and the share of its words that stand in content lines decides.

Only documents are labelled, so the marks of their lines are hidden in training.
The scores of the lines are learned by expectation and maximisation: a line's
mark is expected from its own score and from what the document's label says of
its lines, LABEL_ODDS for or against content; a kind of line that stands mostly
in documents of one label ends with its mark, in documents of the other label
too. The scores of the steps from mark to mark then follow from how often two
marks are expected to follow each other (piecewise training of the chain).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiescope.llm import rows, words

#: Labelled documents, about, that a model is fitted on, drawn by hash of their id.
FIT_DOCUMENTS = 6_000
#: A document is kept if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
#: Added to every line's score of content: a good document lost costs more than a bad one kept.
CONTENT_ODDS = 1.0
#: Log odds of content that a document's label gives each of its lines in training.
LABEL_ODDS = 1.0
#: Rounds in which the steps from mark to mark are learned.
STEP_ROUNDS = 2
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Symbols that are counted.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("one", "symbols", "capitals", "exclamations", "digits", "duplicate", "same_word", "repeated",
            "short", "bars")


@dataclass
class Model:
    """Scores of content over boilerplate, and of each step from one mark to the next."""

    weights: np.ndarray  # one for each of FEATURES
    steps: np.ndarray  # 2 x 2: from, to; 0 boilerplate, 1 content
    first: np.ndarray  # 2


def measures(data: np.ndarray, offsets: np.ndarray):
    """Base counts of each row, and (row, words, features) of each line with a word."""
    n = len(offsets) - 1
    starts, ends, row = words.spans(data, offsets)
    hashed = words.hashes(data, starts, ends, lower=False)
    count = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    symbols = count(table[data])
    points = count((data & 0xC0) != 0x80)
    base = {"n_words": np.bincount(row, minlength=n), "n_symbols": np.diff(symbols[offsets]),
            "word_chars": np.bincount(row, points[ends] - points[starts], n).astype(np.int64)}
    # words in windows of three that are found twice or more
    window, at = words.windows(hashed, row, 3)
    _, place, times = np.unique(words.mix(window + row[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    at = at[times[place] > 1]
    repeated = np.zeros(len(starts), bool)
    for k in range(3):
        repeated[at + k] = True
    base["n_repeat_words"] = np.bincount(row[repeated], minlength=n)
    # lines
    breaks = count(data == 10)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(breaks) > 0) | (np.diff(row) > 0)
    head = np.flatnonzero(new)
    line_row, line = row[head], np.cumsum(new) - 1
    newlines = np.flatnonzero(data == 10)
    # whole lines, from the break or text start before to the break or text end behind
    where = np.searchsorted(newlines, starts[head])
    begin = np.maximum(offsets[line_row], np.append(newlines, len(data))[where - 1] + 1 if len(newlines) else 0)
    if len(newlines):
        begin = np.where(where > 0, begin, offsets[line_row])
    end = np.minimum(offsets[line_row + 1], np.append(newlines, len(data))[where])
    # the first line of each text and content is no duplicate
    line_hash = words.mix(words.hashes(data, begin, end, lower=False) + line_row.astype(np.uint64))
    _, earliest, again = np.unique(line_hash, return_index=True, return_inverse=True)
    duplicate = earliest[again] != np.arange(len(head))
    base["n_dup_lines"] = np.bincount(line_row[duplicate], minlength=n)
    size = np.bincount(line, minlength=len(head))
    inside = lambda marks: np.diff(count(marks)[np.stack([begin, end], 1)], axis=1)[:, 0]
    lower, upper = inside((data >= 97) & (data <= 122)), inside((data >= 65) & (data <= 90))
    same = np.zeros(len(starts), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & ~new[1:]
    features = np.stack([
        np.ones(len(head)), np.minimum(1, (symbols[end] - symbols[begin]) / np.maximum(size, 1)),
        upper / np.maximum(1, upper + lower), np.minimum(1, inside(data == 33) / np.maximum(size, 1)),
        inside((data >= 48) & (data <= 57)) / np.maximum(1, end - begin), duplicate,
        np.bincount(line, same, len(head)) / np.maximum(size, 1),
        np.bincount(line, repeated, len(head)) / np.maximum(size, 1), size <= 3,
        np.minimum(1, inside(data == 124) / np.maximum(size, 1))], 1)
    return base, (line_row, size, features)


def _lanes(lengths: np.ndarray):
    """Sequences by decreasing length, and for each step how many are still going."""
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    return order, live


def viterbi(model: Model, scores: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Likeliest mark (1 content) of every line; sequences lie one after the other in ``scores``."""
    order, live = _lanes(lengths)
    best = np.zeros((len(lengths), 2))
    back = np.zeros((len(scores), 2), np.int8)
    for step, n in enumerate(live):
        at = begin[order[:n]] + step
        if step == 0:
            best[:n] = model.first
        else:
            ways = best[:n, :, None] + model.steps
            back[at] = ways.argmax(1)
            best[:n] = ways.max(1)
        best[:n, 1] += scores[at]
    marks = np.zeros(len(scores), np.int8)
    mark = best.argmax(1)
    size = lengths[order]
    for step in range(len(live) - 1, -1, -1):
        n = live[step]
        at = begin[order[:n]] + step
        # sequences that end here start from their best last mark
        marks[at] = np.where(size[:n] == step + 1, mark[:n], marks[at])
        if step:
            marks[at - 1] = back[at, marks[at]]
    return marks


def _expected(model: Model, scores, begin, lengths):
    """Chance of content for every line, and expected counts of steps and first marks."""
    order, live = _lanes(lengths)
    ahead, behind = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    for step, n in enumerate(live):
        at = begin[order[:n]] + step
        ahead[at] = model.first if step == 0 else np.logaddexp.reduce(ahead[at - 1][:, :, None] + model.steps, axis=1)
        ahead[at, 1] += scores[at]
    steps = np.zeros((2, 2))
    total = np.zeros(len(lengths))
    final = begin + lengths - 1
    total = np.logaddexp.reduce(ahead[final], axis=1)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for step in range(len(live) - 1, 0, -1):
        at = begin[order[:live[step]]] + step
        after = behind[at].copy()
        after[:, 1] += scores[at]
        ways = model.steps + after[:, None, :]
        behind[at - 1] = np.logaddexp.reduce(ways, axis=2)
        steps += np.exp(ahead[at - 1][:, :, None] + ways - total[owner[at]][:, None, None]).sum(0)
    marginal = np.exp(ahead + behind - total[owner][:, None])
    return marginal[:, 1], steps, marginal[begin].sum(0)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
        max_documents: int = FIT_DOCUMENTS, rounds: int = 200) -> Model:
    """Model from documents with ``label`` 1 (good) or 0; others are skipped.

    Repeated rows count as often as they stand there; null and empty texts
    have no line and tell nothing. Without rows of both classes every line is
    content.
    """
    rows.ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, "text", rows.SMALL_SLICE):
                _, (row, _, features) = measures(*rows.raw_text(part.column("text")))
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]) * len(FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), rows.list_array(features.ravel().astype(np.float32), at)],
                    ["label", "features"])

    drawn = rows.drawn(labelled.filter(F.col(label).isin(0, 1)), key, max_documents).select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sample = drawn.mapInArrow(run, "label int, features array<float>").filter("size(features) > 0").toArrow()
    y = sample.column("label").to_numpy()
    model = Model(np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2))
    if not len(y) or y.min() == y.max():
        model.weights[0] = 1.0
        return model
    column = sample.column("features").combine_chunks()
    lengths = column.value_lengths().to_numpy().astype(np.int64) // len(FEATURES)
    features = column.flatten().to_numpy().astype(np.float64).reshape(-1, len(FEATURES))
    begin = np.cumsum(lengths) - lengths
    value = np.repeat(y, lengths)
    # both classes weigh the same
    weight = np.where(value == 1, 0.5 / np.maximum(1, (value == 1).sum()), 0.5 / np.maximum(1, (value == 0).sum()))
    push = np.where(value == 1, LABEL_ODDS, -LABEL_ODDS)
    w, first, second = (np.zeros(len(FEATURES)) for _ in range(3))
    for step in range(1, rounds + 1):
        scores = features @ w
        # a line's chance by itself, and with what the document's label says
        grad = features.T @ (weight * (_chance(scores) - _chance(scores + push))) + 1e-6 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        w = w - 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    model = Model(w, np.zeros((2, 2)), np.zeros(2))
    groups = [np.flatnonzero(y == label_) for label_ in (0, 1)]
    for _ in range(STEP_ROUNDS):
        scores, pairs = features @ w + push, np.zeros((2, 2))
        for members in groups:
            at = rows.ragged(begin[members], lengths[members])
            inner = np.cumsum(lengths[members]) - lengths[members]
            pairs += _expected(model, scores[at], inner, lengths[members])[1] * weight[begin[members[0]]]
        pairs = (pairs + 1e-6) / (pairs + 1e-6).sum()
        # how much more often two marks follow each other than by chance
        model.steps = np.log(pairs / pairs.sum(1)[:, None] / pairs.sum(0))
    model.weights[0] += CONTENT_ODDS
    return model


def _chance(scores: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))



ADDED = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
         "base_failed boolean, content_share double, kept boolean")


def judge(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with the base counts, the content share and the verdict ``kept`` of every whole text.

    Null and empty texts, and texts without a word, fail the base rules with
    all counts 0 (symbols are counted in any case). Repeated rows are judged
    alike. Columns with the names of ADDED are replaced.
    """
    rows.ship(df.sparkSession)
    names = [x.split()[0] for x in ADDED.split(", ")]
    kept = [c for c in df.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, text, rows.SMALL_SLICE):
                n = part.num_rows
                base, (row, size, features) = measures(*rows.raw_text(part.column(text)))
                lengths = np.bincount(row, minlength=n)
                some = np.flatnonzero(lengths)
                begin = (np.cumsum(lengths) - lengths)[some]
                marks = viterbi(model, features @ model.weights, begin, lengths[some])
                share = np.bincount(row, size * marks, n) / np.maximum(1, base["n_words"])
                failed = (base["n_words"] < LEAST_WORDS) | (
                    100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
                found = base | {"base_failed": failed, "content_share": share,
                                "kept": ~failed & (share >= CONTENT_SHARE)}
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(found[x]) for x in names],
                                                 [*kept, *names])

    return df.mapInArrow(run, rows.extended(df, kept, ADDED))
