"""Quality classifier: ordinal regression (cumulative links) on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds
cut the score into grades. A document gets the probability of each grade or
better, and the expected grade.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselight.llm.words import Memo, batch_rows

# Grades: 0 toxic, 1 poor, 2 good.
GRADES = 3
BITS = 18
# Labelled documents learned from: a bounded sample, spread by a hash of the id.
SAMPLE = 10_000
LEAST_DOCUMENTS = 5  # a feature must occur in, to have a weight
STEPS = 250
RATE = 0.05
PENALTY = 1e-3
KEEP_FROM = 0.5

_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_index = Memo(lambda feature: xxhash.xxh32_intdigest(feature.encode("utf-8", "replace")) >> (32 - BITS))


def _shape(pieces: list[str], words: list[str]) -> list[str]:
    """Coarse measures of the whole text as features of their own."""
    n = max(1, len(words))
    distinct = len(set(words)) / n
    upper = sum(p.isupper() for p in pieces if len(p) > 1) / max(1, len(pieces))
    marks = sum(not p.isalnum() for p in pieces) / max(1, len(pieces))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    return [
        f"\0length={n.bit_length()}", f"\0distinct={round(10 * distinct)}", f"\0upper={round(5 * upper)}",
        f"\0marks={round(10 * marks)}", f"\0pairs={round(10 * pairs)}",
    ]


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: pieces, ends of words in capitals, measures."""
    if not text:
        return np.array([_index["\0empty"]], np.int32)
    pieces = _PIECE.findall(text)
    words = text.lower().split()
    found = {_index[p] for p in set(map(str.lower, set(pieces)))}
    found.update(_index[s] for s in _shape(pieces, words))
    return np.fromiter(sorted(found), np.int32, len(found))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights and thresholds; ``tails(score)[k]`` is the chance of grade ``k + 1`` or better."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, found: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[found].sum() - self.thresholds)


def fit(documents: list[np.ndarray], grades: np.ndarray, grades_n: int = GRADES) -> Model:
    """Full-batch gradient steps (Adam) on the likelihood of the grades.

    Thresholds are the first one and positive gaps, so they stay in order.
    """
    weights = np.zeros(1 << BITS, np.float32)
    if not len(documents):
        return Model(weights, np.zeros(grades_n - 1))
    flat = np.concatenate(documents)
    rows = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    often = np.bincount(flat, minlength=1 << BITS) >= min(LEAST_DOCUMENTS, len(documents))
    keep = often[flat]
    used, columns = np.unique(flat[keep], return_inverse=True)
    rows, n = rows[keep], len(documents)
    w = np.zeros(len(used))
    # The first threshold and the logs of the gaps above it.
    t = np.r_[-2.0, np.zeros(grades_n - 2)]
    state = [np.zeros(len(w) + len(t)) for _ in range(2)]
    for step in range(1, STEPS + 1):
        cuts = np.cumsum(np.r_[t[0], np.exp(t[1:])])
        score = np.bincount(rows, w[columns], n)
        above = np.c_[np.ones(n), _sigmoid(score[:, None] - cuts), np.zeros(n)]
        slope = above * (1 - above)
        at = np.arange(n)
        chance = np.maximum(above[at, grades] - above[at, grades + 1], 1e-9)
        by_score = -(slope[at, grades] - slope[at, grades + 1]) / chance / n
        by_cut = np.zeros(grades_n + 1)
        np.add.at(by_cut, grades, slope[at, grades] / chance / n)
        np.add.at(by_cut, grades + 1, -slope[at, grades + 1] / chance / n)
        by_cut = by_cut[1:-1]
        later = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.r_[
            np.bincount(columns, by_score[rows], len(w)) + PENALTY * w, later[0], later[1:] * np.exp(t[1:])
        ]
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
    weights[used] = w
    return Model(weights, np.cumsum(np.r_[t[0], np.exp(t[1:])]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of (doc_id, quality, toxic): the worst of repeated ratings."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    return rated.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(documents: DataFrame, ratings: DataFrame, *, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` rated documents; only their features reach the driver.

    Ratings without a document, or outside the sample, are not learned from.
    Rows that repeat a doc_id count as often as they occur, within the bound.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def describe(batches):
        for batch in batch_rows(batches):
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))],
                names=["doc_id", "grade", "found"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The sample is bounded, so it may be sent to every task.
    learned = (
        rows.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "grade", "text")
        .mapInArrow(describe, "doc_id long, grade int, found array<int>")
        .orderBy("doc_id", "grade", "found")
        .limit(sample)
        .toArrow()
    )
    found = learned.column("found").combine_chunks()
    values, ends = found.values.to_numpy(), found.offsets.to_numpy()
    each = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return fit(each, learned.column("grade").to_numpy().astype(np.int64))


def grade(documents: DataFrame, model: Model, *, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, expected_grade, p_1 and p_2 (chance of that grade or better) and kept.

    A document is kept if a good grade is at least as likely as ``keep_from``.
    Null and empty texts are judged by the feature for emptiness; repeated rows
    are judged each; other columns are not read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{k + 1}" for k in range(len(model.thresholds))]

    def judge(batches):
        for batch in batch_rows(batches):
            tails = [sent.value.tails(features(t)) for t in batch.column("text").to_pylist()]
            table = np.array(tails).reshape(batch.num_rows, len(names))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(table.sum(axis=1))]
                + [pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(names))]
                + [pa.array(table[:, -1] >= keep_from)],
                names=["doc_id", "expected_grade", *names, "kept"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = ", ".join(f"{n} double" for n in ["expected_grade", *names])
    return rows.mapInArrow(judge, f"doc_id long, {columns}, kept boolean")


def select(documents: DataFrame, model: Model, *, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that are kept, with their columns; texts are read and judged once."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batch_rows(batches):
            good = [
                bool(sent.value.tails(features(t))[-1] >= keep_from) for t in batch.column("text").to_pylist()
            ]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
