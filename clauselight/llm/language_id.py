"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselight.llm.words import batch_rows

PROFILE = 400
UNKNOWN = "und"
# Distinct n-grams a task gathers before it hands them on.
_GRAMS_HELD = 200_000
_SPACE = 0x20
# Three code points of 21 bits make one 64-bit number.
_BITS = 21


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three characters as numbers, and how often each occurs.

    Letters are lower-cased; every word stands between spaces, and no n-gram
    spans two words or is a space alone.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    # One space after each word and one before the first.
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    codes = np.where(letter, codes, _SPACE)[kept].astype(np.int64)
    letter = letter[kept]
    pairs = (codes[:-1] << _BITS) | codes[1:]
    triples = (pairs[:-1] << _BITS) | codes[2:]
    if not letter.any():
        pairs = triples = codes[:0]
    else:
        triples = triples[letter[1:-1]]
    grams = np.sort(np.concatenate([codes[letter], pairs, triples]))
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)])
    return grams[first], np.diff(np.append(first, len(grams)))


def _ranked(text: str) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code points; none without letters."""
    grams, counts = _gram_counts(text)
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def profiles(labelled: DataFrame) -> DataFrame:
    """(lang, gram, place): the most frequent n-grams per language of (lang, text)."""

    def count(batches):
        def handed_on():
            rows = [(lang, gram, n) for lang, grams in held.items() for gram, n in grams.items()]
            held.clear()
            return pa.record_batch(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
                names=["lang", "gram", "n"],
            )

        held: dict[str, Counter] = {}
        for batch in batch_rows(batches, 1 << 20):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text or "")
            for lang, own in texts.items():
                grams, counts = _gram_counts(" ".join(own))
                held.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), counts.tolist())))
            if sum(map(len, held.values())) >= _GRAMS_HELD:
                yield handed_on()
        if held:
            yield handed_on()

    counts = (
        labelled.filter(F.col("lang").isNotNull())
        .select(F.col("lang").cast("string").alias("lang"), "text")
        .mapInArrow(count, "lang string, gram long, n long")
    )
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = totals.withColumn("place", F.row_number().over(by_count))
    return ranked.filter(F.col("place") <= PROFILE).select("lang", "gram", "place")


class Classifier:
    """Distances of a document's ranking to each language's."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.places = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.places[number[lang], np.searchsorted(self.grams, gram)] = place - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        ranked = _ranked(text or "")
        if not self.langs or not len(ranked):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, ranked)
        at[at == len(self.grams)] = len(self.grams) - 1
        at = np.where(self.grams[at] == ranked, at, len(self.grams))
        theirs = self.places[:, at]
        off = np.where(theirs >= 0, np.abs(theirs - np.arange(len(ranked))), PROFILE)
        distance = off.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(ranked)))


def identify(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score (1 for the profile itself, 0 for nothing in common).

    Profiles are learned from all of ``labelled`` (lang, text), rows without a
    language left out. ``lang_pred`` is 'und', with score 0, for a text that is
    null or has no letter, and for every text if nothing could be learned. Equal
    distances go to the first language in order. Repeated rows are predicted
    each; other columns are not read. The driver and each task hold at most 400
    n-grams per distinct language, a label set fixed by the data's annotation.
    """
    learned = profiles(labelled).collect()
    model = documents.sparkSession.sparkContext.broadcast(
        Classifier([(r["lang"], r["gram"], r["place"]) for r in learned])
    )

    def predict(batches):
        for batch in batch_rows(batches):
            found = [model.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")
