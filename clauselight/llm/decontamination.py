"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents within a task. Its words become symbols of the
benchmark's vocabulary; any other word ends every match, and so does a run of
vocabulary words shorter than the shortest window: both become one separator.
On the shard's Burrows-Wheeler transform, held in a wavelet matrix, all windows
are searched backwards at once; sampled suffix positions locate the occurrences.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clauselight.llm.words import batch_rows
from clauselight.session import new_path

WINDOW = 10
# Items reach the tasks in blocks of this much text.
BLOCK_BYTES = 32 << 20
_SAMPLE = 8
_END, _SEPARATOR, _FIRST_WORD = 0, 1, 2
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# A-Z lower-cased; bytes that are no part of a word become spaces.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; only ties are sorted again, on twice the length each time."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        key[: max(0, n - i)] |= text[i:]
    tied = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    key = key[tied]
    fresh = np.r_[True, key[1:] != key[:-1]]
    order = tied.copy()
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[tied] = starts
    again = ~(fresh & np.r_[fresh[1:], True])
    tied, held = tied[again], starts[again]
    while len(tied):
        nxt = rank[np.minimum(tied + width, n)]
        by = np.argsort(held * (n + 1) + nxt + 1, kind="stable")
        tied, held, nxt = tied[by], held[by], nxt[by]
        group = np.r_[True, held[1:] != held[:-1]]
        fresh = group | np.r_[True, nxt[1:] != nxt[:-1]]
        at = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(group, at, 0))
        order[held + at - first] = tied
        held = held + np.maximum.accumulate(np.where(fresh, at, 0)) - first
        rank[tied] = held
        again = ~(fresh & np.r_[fresh[1:], True])
        tied, held = tied[again], held[again]
        width *= 2
    return order


class FMIndex:
    """Search in a text of small integers that ends with the only 0."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.n_symbols = int(text.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=self.n_symbols))]
        self.levels = []
        held = self.bwt
        for bit in range((self.n_symbols - 1).bit_length() - 1, -1, -1):
            ones = (held >> bit) & 1
            count = np.zeros(len(held) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            zeros = len(held) - int(count[-1])
            self.levels.append((bit, count, zeros))
            held = np.concatenate([held[ones == 0], held[ones == 1]])
        marked = order % _SAMPLE == 0
        self.marks = np.r_[0, np.cumsum(marked)]
        self.marked, self.samples = marked, order[marked]

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the transform."""
        start = np.zeros_like(at)
        for bit, count, zeros in self.levels:
            one = (symbols >> bit) & 1 == 1
            at = np.where(one, zeros + count[at], at - count[at])
            start = np.where(one, zeros + count[start], start - count[start])
        return at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that start with each pattern, as ranges."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for i in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[live, i]
            known = symbols < self.n_symbols
            high[live[~known]] = low[live[~known]]
            live, symbols = live[known], symbols[known]
            low[live] = self.before[symbols] + self.rank(symbols, low[live])
            high[live] = self.before[symbols] + self.rank(symbols, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a sampled suffix."""
        found = np.empty(len(rows), np.int64)
        todo, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked[rows]
            found[todo[hit]] = self.samples[self.marks[rows[hit]]] + steps
            todo, rows, steps = todo[~hit], rows[~hit], steps + 1
            symbols = self.bwt[rows]
            rows = self.before[symbols] + self.rank(symbols, rows)
        return found


class Block:
    """The windows of some items: distinct, by length, each with its items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple, set[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + _FIRST_WORD) for w in words(text)]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1 if ids else 0):
                known = owners.setdefault(tuple(ids[i : i + width]), set())
                if name is not None:  # else its words are hits of no item
                    known.add(number[name])
        self.lengths = {}
        for width in sorted({len(w) for w in owners}):
            some = [w for w in owners if len(w) == width]
            lists = [sorted(owners[w]) for w in some]
            ends = np.cumsum([len(x) for x in lists])
            self.lengths[width] = np.array(some, np.int64), ends, np.concatenate(lists).astype(np.int64)
        self.shortest = min(self.lengths, default=0)

    def find(self, documents: list[list[bytes]], sizes: np.ndarray):
        """Hit words (one flag each, over all documents) and (document, item) pairs."""
        total = int(sizes.sum())
        hit = np.zeros(total + 1, np.int64)
        none = np.zeros((0, 2), np.int64)
        if not self.lengths or not total:
            return hit[:total] > 0, none
        get = self.vocabulary.get
        symbols = np.fromiter(
            (s for d in documents for s in map(get, d, repeat(_SEPARATOR))), np.int64, total
        )
        document = np.repeat(np.arange(len(sizes)), sizes)
        known = symbols != _SEPARATOR
        starts = known & ~(np.r_[False, known[:-1]] & np.r_[False, document[1:] == document[:-1]])
        run = np.cumsum(starts) - 1
        enough = np.bincount(run[known], minlength=1) >= self.shortest
        keep = known & enough[np.maximum(run, 0)]
        if not keep.any():
            return hit[:total] > 0, none
        where, runs = np.flatnonzero(keep), run[keep]
        breaks = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
        text = np.insert(symbols[where], breaks, _SEPARATOR)
        places = np.insert(where, breaks, -1)
        index = FMIndex(np.r_[text, _END])
        pairs = [none]
        for width, (patterns, ends, owners) in self.lengths.items():
            low, high = index.search(patterns)
            n = high - low
            if not n.any():
                continue
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
            at = places[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + width, -1)
            met = np.unique(document[at] * len(patterns) + which)
            docs, which = met // len(patterns), met % len(patterns)
            begins = np.r_[0, ends[:-1]]
            m = ends[which] - begins[which]
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            pairs.append(np.stack([np.repeat(docs, m), owners[np.repeat(begins[which], m) + nth]], 1))
        return np.cumsum(hit[:total]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """The items in blocks of bounded size, at least one; the driver holds one at a time."""
    rows = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")
    ).filter("text IS NOT NULL")
    held, size, given = [], 0, False
    for row in rows.toLocalIterator():
        held.append((row["item_id"], bytes(row["text"])))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield Block(held, window)
            held, size, given = [], 0, True
    if held or not given:
        yield Block(held, window)


class _Columns:
    """Names for what passes hand on, other than the caller's columns."""

    def __init__(self, given: list[str]):
        free = (f"_leak{i}" for i in count() if f"_leak{i}" not in given)
        self.bytes, self.hits, self.items = next(free), next(free), next(free)


def _scan(batches, block: Block, names: _Columns):
    """Slices with the texts, word counts, hit flags and item names of their documents so far."""
    for batch in batch_rows(batches):
        texts = batch.column(names.bytes).to_pylist()
        split = [words(t) for t in texts]
        sizes = np.array([len(d) for d in split], np.int64)
        hit, pairs = block.find(split, sizes)
        found = [set() for _ in texts]
        for doc, item in pairs.tolist():
            found[doc].add(block.names[item])
        if names.hits in batch.schema.names:
            for at, spans in zip(np.cumsum(sizes) - sizes, batch.column(names.hits).to_pylist()):
                for span in spans:
                    hit[at + span["start"] : at + span["end"]] = True
            for known, more in zip(found, batch.column(names.items).to_pylist()):
                known.update(more)
        yield batch, texts, sizes, hit, found


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _span_lists(sizes: np.ndarray, hit: np.ndarray) -> list[list[dict]]:
    ends = np.cumsum(sizes)
    return [[{"start": s, "end": e} for s, e in _spans(hit[a:b])] for a, b in zip(ends - sizes, ends)]


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, names: _Columns, finish, schema) -> DataFrame:
    """``finish`` over the slices of ``_scan``, when all blocks have been searched.

    One block is sent to the tasks at a time. If there are several, what was found in
    earlier ones travels with the documents, which are written between the passes.
    """
    context = rows.sparkSession.sparkContext
    between = f"{names.hits} array<struct<start:long,end:long>>, {names.items} array<string>"

    def hand_on(sent):
        def run(batches):
            for batch, _, sizes, hit, found in _scan(batches, sent.value, names):
                kept = [c for c in batch.schema.names if c not in (names.hits, names.items)]
                columns = [pa.array(_span_lists(sizes, hit), _SPANS), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.record_batch(
                    [*(batch.column(c) for c in kept), *columns], names=[*kept, names.hits, names.items]
                )

        return run

    blocks = _blocks(benchmark, window)
    block = next(blocks)
    plain = rows.schema
    for following in blocks:
        sent = context.broadcast(block)
        state = StructType([*plain.fields, *StructType.fromDDL(between).fields])
        rows = _stored(rows.mapInArrow(hand_on(sent), state), "leaks-so-far")
        sent.unpersist()
        block = following
    sent = context.broadcast(block)
    return rows.mapInArrow(lambda batches: map(finish, _scan(batches, sent.value, names)), schema)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words: overlapping and touching occurrences are one."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


FOUND_SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string,"
    " contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
)


def find_leaks(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Benchmark windows in every document, as word counts, items and merged word spans.

    A window is ``window`` words in a row of an item, or a shorter item whole.
    Null and empty texts have no words; items without words are not searched; what
    only items without an id hold is hit, but no item is counted or listed for it.
    Repeated rows are searched each for itself. Items with equal ids count once. No
    documents give no rows.
    """
    def report(scanned):
        batch, _, sizes, hit, found = scanned
        items, spans = [sorted(x) for x in found], _span_lists(sizes, hit)
        n_hit = [sum(s["end"] - s["start"] for s in own) for own in spans]
        return pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(sizes),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([n > 0 for n in n_hit], pa.bool_()),
                pa.array(items, pa.list_(pa.string())),
                pa.array(spans, _SPANS),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                   "contaminated", "items", "spans"],
        )

    names = _Columns(["doc_id"])
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias(names.bytes)
    )
    return _searched(rows, benchmark, window, names, report, FOUND_SCHEMA)


def _without(text: bytes, flags: np.ndarray) -> bytes:
    """The text without its hit words and what lies between them."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, at = [], 0
    for first, end in _spans(flags):
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def remove_leaks(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The documents with every benchmark occurrence cut out of the text.

    Texts without a hit stay as they are, null included; other columns too.
    """
    names = _Columns(documents.columns)

    def remove(scanned):
        batch, texts, sizes, hit, _ = scanned
        ends = np.cumsum(sizes)
        cut = [
            _without(t, hit[a:b]) if hit[a:b].any() else t
            for t, a, b in zip(texts, ends - sizes, ends)
        ]
        columns = [
            pa.array(cut, pa.binary()) if name == names.bytes else batch.column(name) for name in plain
        ]
        return pa.record_batch(columns, names=plain)

    rows = documents.withColumn(names.bytes, F.col("text").cast("binary")).drop("text")
    plain = rows.columns
    found = _searched(rows, benchmark, window, names, remove, rows.schema)
    return found.withColumn("text", F.col(names.bytes).cast("string")).select(*documents.columns)
