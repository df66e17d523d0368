"""Toxicity by multiple-instance learning with noisy-or.

A document is a bag of sentences. Each sentence has a logistic score from its
words; the document is toxic with 1 - prod(1 - score). Weights are trained
from document labels alone, so the sentence scores learn which sentences
carry the label, and locate them afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiescope.llm import rows, words

#: Hash space of the features: words, and beginnings of words of PREFIX bytes.
FEATURE_BITS = 18
PREFIX = 6
#: Labelled documents, about, that a model is fitted on, drawn by hash of their id.
FIT_DOCUMENTS = 6_000
#: Sentences with this score are reported.
OFFENDING = 0.5
#: A feature is used if so many documents have it, and if its share of toxic ones is so many
#: standard deviations above the share of all.
LEAST_DOCUMENTS, LEAST_Z = 5, 4.0
_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True


@dataclass
class Model:
    """Feature weights and the score of a sentence without known words."""

    weights: np.ndarray
    bias: float


def bags(data: np.ndarray, offsets: np.ndarray):
    """(features, sentence of each feature, row of each sentence, byte where each sentence begins).

    A sentence ends at a stop or a line end. Sentences without a word don't
    count. Two features for each word: itself and its first bytes.
    """
    starts, ends, row = words.spans(data, offsets, words.MARKS)
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(stops) > 0) | (np.diff(row) > 0)
    sentence = np.cumsum(new) - 1
    shift = np.uint64(65 - FEATURE_BITS)
    whole = (words.hashes(data, starts, ends) >> shift).astype(np.int64)
    begin = (words.hashes(data, starts, np.minimum(ends, starts + PREFIX)) >> shift).astype(np.int64)
    features = np.stack([whole, begin + (1 << FEATURE_BITS - 1)], 1).ravel()
    return features, np.repeat(sentence, 2), row[new], starts[new]


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
        max_documents: int = FIT_DOCUMENTS, rounds: int = 200) -> Model:
    """Weights from labelled documents: ``label`` is 1 for toxic, 0 else, others are skipped.

    With one class only, or no rows, all scores are that class's: 1 or 0.
    """
    rows.ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows.slices(batch, "text"):
                features, sentence, row, _ = bags(*rows.raw_text(part.column("text")))
                packed = np.unique(sentence << FEATURE_BITS | features)
                sentence, features = packed >> FEATURE_BITS, packed & (1 << FEATURE_BITS) - 1
                begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                at = np.searchsorted(sentence, begin)
                local = sentence - begin[row[sentence]] if len(sentence) else sentence
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), rows.list_array(features.astype(np.int32), at),
                     rows.list_array(local.astype(np.int32), at)], ["label", "features", "sentences"])

    drawn = rows.drawn(labelled.filter(F.col(label).isin(0, 1)), key, max_documents).select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sample = drawn.mapInArrow(run, "label int, features array<int>, sentences array<int>").toArrow()
    y = sample.column("label").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), 30.0 if len(y) and y[0] else -30.0)
    columns = [sample.column(c).combine_chunks() for c in ("features", "sentences")]
    sizes = columns[0].value_lengths().to_numpy()
    features = columns[0].flatten().to_numpy()
    document = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    kept = _telling(document, features, y)[features]
    features, document = features[kept], document[kept].astype(np.int64)
    # the sentences of the documents one after the other, those without a telling feature too
    sentences = columns[1].flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    many = np.where(sizes > 0, sentences[np.maximum(ends[1:] - 1, 0)] + 1, 0).astype(np.int64)
    sentence = sentences[kept] + (np.cumsum(many) - many)[document]
    owner = np.repeat(np.arange(len(y)), many)
    names, features = np.unique(features, return_inverse=True)
    weights, bias = _descend(features, sentence, owner, y, len(names), rounds)
    out = np.zeros(1 << FEATURE_BITS, np.float32)
    out[names] = weights
    return Model(out, float(bias))


def _telling(document, features, y):
    """Whether a feature is more frequent in toxic documents than chance explains.

    Without this the many words of single documents are learned by heart.
    """
    pairs = np.unique(document.astype(np.int64) << FEATURE_BITS | features)
    name = pairs & (1 << FEATURE_BITS) - 1
    n = np.bincount(name, minlength=1 << FEATURE_BITS)
    toxic = np.bincount(name, y[pairs >> FEATURE_BITS], minlength=1 << FEATURE_BITS)
    share = y.mean()
    z = (toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    return (n >= LEAST_DOCUMENTS) & (z >= LEAST_Z)


def _descend(features, sentence, owner, y, n, rounds):
    """Adam on the noisy-or likelihood, both classes weighing the same, with decay."""
    n_sentences = len(owner)
    balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, first, second = (np.zeros(n + 1) for _ in range(3))
    w[n] = -4.0
    for step in range(1, rounds + 1):
        z = w[n] + np.bincount(sentence, w[features], n_sentences)
        chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        odds = np.maximum(np.bincount(owner, np.logaddexp(0, z), len(y)), 1e-9)  # -log of "no sentence is toxic"
        slope = balance * np.where(y > 0, -1 / np.expm1(np.minimum(odds, 50)), 1.0)
        dz = slope[owner] * chance
        grad = np.append(np.bincount(features, dz[sentence], n), dz.sum())
        grad[:n] += 2e-6 * w[:n]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad ** 2
        w -= 0.15 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    return w[:n], w[n]


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``offending``, the sentences that carry it.

    Every whole text is read. A text without words (null and empty too) scores
    0 and has no sentences. ``offending`` lists (byte where the sentence
    begins, sentence score). Columns of these names are replaced.
    """
    rows.ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** FEATURE_BITS numbers
    kept = [c for c in df.columns if c not in ("score", "offending")]
    spot = pa.struct([("start", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value.weights, shared.value.bias
        for batch in batches:
            for part in rows.slices(batch, text):
                data, offsets = rows.raw_text(part.column(text))
                features, sentence, row, begin = bags(data, offsets)
                packed = np.unique(sentence << FEATURE_BITS | features)
                sums = np.bincount(packed >> FEATURE_BITS, weights[packed & (1 << FEATURE_BITS) - 1], len(row))
                z = bias + sums
                total = -np.expm1(-np.bincount(row, np.logaddexp(0, z), part.num_rows))
                chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                bad = np.flatnonzero(chance >= OFFENDING)
                at = np.concatenate([[0], np.cumsum(np.bincount(row[bad], minlength=part.num_rows))])
                spots = pa.StructArray.from_arrays([pa.array(begin[bad] - offsets[row[bad]]), pa.array(chance[bad])],
                                                   fields=list(spot))
                found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spots)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(total), found],
                                                 [*kept, "score", "offending"])

    return df.mapInArrow(run, rows.extended(
        df, kept, "score double, offending array<struct<start: bigint, score: double>>"))
