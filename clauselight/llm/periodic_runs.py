"""Periodic runs of words by enumerating maximal pairs on the LCP-interval tree.

Two occurrences of the same words, at i and i + p, form a maximal pair of length l
if neither a word before nor one after can be added. If l >= 3 p, the l + p words
from i on are a whole run of period p: it can't be extended, so nothing has to be
compared afterwards. Of equal stretches the least p is the run's period.

The suffixes of all texts of a slice are sorted at once. Bottom-up over the
tree's intervals, each holds its positions in lists by the word to the left;
where two intervals meet, positions from lists of different left words are
maximal pairs, and only those a third of the common prefix apart or nearer are
looked up. Suffixes that can't be so near to another one never enter the tree.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselight.llm.decontamination import suffix_array
from clauselight.llm.words import batch_rows, utf8

# A run has at least so many periods and words.
EXPONENT = 4
LEAST_WORDS = 6
# Texts sorted together, in bytes; a longer text is sorted alone.
SLICE_BYTES = 2 << 20

FOUND_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
)


def _least_prefix() -> int:
    """The shortest common prefix of a pair that is a run."""
    return min(max((EXPONENT - 1) * p, LEAST_WORDS - p) for p in range(1, LEAST_WORDS + 1))


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first..last]`` for each pair of places."""
    levels = [values]
    width = 1
    while 2 * width <= len(values):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    size = last - first + 1
    level = np.frexp(size)[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(levels[k][first[own]], levels[k][last[own] - (1 << int(k)) + 1])
    return out


def _prefixes(text: list[int], order: np.ndarray, ranks: np.ndarray, least: int) -> list[int]:
    """Common prefix of each of the ``ranks`` with the rank before it, known to be ``least``.

    Position by position: the next one's prefix is at most one word shorter.
    """
    at, before = order[ranks], order[ranks - 1]
    by_place = np.argsort(at)
    out, last, h = [0] * len(ranks), -2, 0
    for r, i, j in zip(by_place.tolist(), at[by_place].tolist(), before[by_place].tolist()):
        h = max(h - 1, least) if i == last + 1 else least
        while text[i + h] == text[j + h]:
            h += 1
        out[r], last = h, i
    return out


def _pairs(places: list[int], prefixes: list[int], left: list[int]):
    """(i, p, l) of the near maximal pairs of suffixes in order, with prefixes between neighbours."""

    def meet(one: dict, other: dict, length: int):
        """Pairs between two intervals below one of prefix ``length``; both become one."""
        if sum(map(len, one.values())) < sum(map(len, other.values())):
            one, other = other, one
        reach = length // (EXPONENT - 1)
        for word, new in other.items():
            for other_word, held in one.items():
                if word != other_word:
                    few, many = (new, held) if len(new) < len(held) else (held, new)
                    for i in few:
                        for j in many[bisect_left(many, i - reach) : bisect_right(many, i + reach)]:
                            if length + abs(i - j) >= LEAST_WORDS:
                                found.append((min(i, j), abs(i - j), length))
        for word, new in other.items():
            if held := one.get(word):
                for i in new:
                    insort(held, i)
            else:
                one[word] = new
        return one

    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, dict]] = []  # open intervals: prefix, lists by left word
    for i, length in zip(places, [*prefixes, 0]):
        # ``length`` is the prefix with the next suffix: deeper intervals end here.
        held = {left[i]: [i]}
        while stack and stack[-1][0] > length:
            depth, lists = stack.pop()
            held = meet(lists, held, depth)
        if stack and stack[-1][0] == length:
            stack[-1] = length, meet(stack[-1][1], held, length)
        elif length:
            stack.append((length, held))
    return found


def maximal_pairs(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, period, common length) of the pairs of a text that are runs.

    Texts may follow each other if they share no symbol.
    """
    least = _least_prefix()
    none = np.zeros((0, 3), np.int64)
    n = len(symbols)
    if n <= least:
        return none
    text = np.r_[symbols, -1]
    order = suffix_array(np.r_[symbols + 1, 0])
    # Neighbours that share their first words.
    shared = np.zeros(n + 1, bool)
    a, b = order[1:], order[:-1]
    alike = np.flatnonzero(np.maximum(a, b) + least <= n) + 1
    for k in range(least):
        alike = alike[text[order[alike] + k] == text[order[alike - 1] + k]]
    shared[alike] = True
    if not len(alike):
        return none
    words = text.tolist()
    prefix = np.zeros(n + 1, np.int64)
    prefix[alike] = _prefixes(words, order, alike, least)

    # Suffixes with some shared prefix, in groups; within a group only those near another one stay.
    ranks = np.flatnonzero(shared | np.r_[shared[1:], False])
    first = ~shared[ranks]
    group = np.cumsum(first) - 1
    longest = np.maximum.reduceat(prefix[ranks], np.flatnonzero(first))
    place = order[ranks]
    by = np.lexsort((place, group))
    far = np.r_[True, (np.diff(place[by]) > longest[group[by[1:]]] // (EXPONENT - 1)) | (np.diff(group[by]) != 0)]
    cluster = np.empty(len(ranks), np.int64)
    cluster[by] = np.cumsum(far) - 1
    size = np.bincount(cluster)
    stay = np.flatnonzero(size[cluster] > 1)
    if not len(stay):
        return none
    stay = stay[np.argsort(cluster[stay], kind="stable")]
    cluster, ranks = cluster[stay], ranks[stay]
    same = np.flatnonzero(cluster[1:] == cluster[:-1])
    between = np.zeros(len(ranks), np.int64)
    between[same] = _range_minima(prefix, ranks[same] + 1, ranks[same + 1])
    places = order[ranks]
    left = [-1, *words]  # the word before position i is at i
    found = []
    ends = np.flatnonzero(np.r_[cluster[1:] != cluster[:-1], True]) + 1
    places, between = places.tolist(), between.tolist()
    for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
        found += _pairs(places[s:e], between[s : e - 1], left)
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text its runs as rows (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols, known = [], 0
    for words in texts:
        number = dict(zip(dict.fromkeys(words), count(known)))
        symbols.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        known += len(number)
    found = maximal_pairs(np.concatenate(symbols)) if texts else np.zeros((0, 3), np.int64)
    start, period, length = found[:, 0], found[:, 1], found[:, 1] + found[:, 2]
    # The least period of a stretch comes first and stays.
    by = np.lexsort((period, length, start))
    start, period, length = start[by], period[by], length[by]
    new = np.r_[True, (np.diff(start) != 0) | (np.diff(length) != 0)][: len(start)]
    start, period, length = start[new], period[new], length[new]
    by = np.lexsort((period, start))
    rows = np.stack([start, length, period], axis=1)[by]
    base = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(rows[:, 0], base)
    parts = np.split(rows, cuts[1:]) if texts else []
    return [part - np.array([b, 0, 0]) for part, b in zip(parts, base)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed of every row of ``documents`` (doc_id, text).

    Words lie between white space. A run is a stretch of words of smallest period q
    that holds at least four periods and six words and that no neighbouring word
    extends; ``runs`` lists start, length and period by start, then period. ``collapsed`` is the
    text with each run cut down to its first period, as UTF-8, its words joined by one space.
    Null and empty texts have no words; rows that repeat are each returned; other
    columns are not read; no rows give no rows. A very long text is handled whole, in one task.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches):
        for batch in batch_rows(batches, SLICE_BYTES):
            texts = [(t or b"").split() for t in batch.column("text").to_pylist()]
            runs = runs_of(texts)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array([collapsed(t, r) for t, r in zip(texts, runs)], pa.binary()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return rows.mapInArrow(search, FOUND_SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksums and the run of the greatest exponent of each row of ``find``.

    Without a run its start, length, period and exponent are null.
    """
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(better(b, r), r).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
