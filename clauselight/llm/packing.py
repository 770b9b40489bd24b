"""Mixture-controlled packing: deficit round-robin over source queues.

Every window of ``window`` tokens takes from each source queue its share of the
target mixture. Shares are whole tokens; what a queue is owed beyond them is its
deficit, which later windows pay. A queue's quota in a run of windows follows from
what is due before and after it, so any window's share, and any queue
position's window, follow by arithmetic: deficits carry over from window to window
and from task to task without a pass in order over the data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselight.llm.tokens import DEFAULT_TOKENIZER, encoder
from clauselight.llm.words import batch_rows
from clauselight.session import new_path

WINDOW = 2048
WINDOWS_PER_ROUND = 64
END_ID = 1
# Sources with a queue of their own; the smaller ones share one, so that the
# totals read by the driver stay bounded.
MAX_QUEUES = 1024
REST = "\0rest"

IDS_SCHEMA = "doc_id long, queue string, part int, at long, n long, ids binary"
PIECES_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, queue string, ids binary"
)


@dataclass
class Phase:
    """Windows with the same shares.

    ``parts[s]`` is the whole number that stands for the weight of queue ``s``.
    At tick ``t`` the queue is due ``(t * parts[s] + ahead[s]) // sum(parts)``
    tokens; windows take tokens in the order they are due, those of one tick by
    queue. ``ahead`` spreads the first tokens of equal queues over the ticks.
    ``taken`` and ``first`` say how many tokens and windows came before the phase.
    """

    parts: np.ndarray
    tokens: int
    taken: np.ndarray
    first: int
    window: int

    def __post_init__(self):
        self.parts = np.asarray(self.parts, np.int64)
        self.total = int(self.parts.sum())
        self.share = self.parts / self.total
        ahead = [self.total * (i * 40503 % 65536) // 65536 for i in range(len(self.parts))]
        self.ahead = np.array(ahead, np.int64)
        self.end = self.taken + self.due(np.array([self.tokens]))[0]

    def _at(self, ticks: np.ndarray) -> np.ndarray:
        """What queues are due at each tick, exactly.

        The quotient is estimated in doubles; the remainder of the estimate, taken modulo
        2 ** 64, is small and sets it right (the total is below 2 ** 61).
        """
        t = ticks[:, None]
        guess = np.floor(t * self.share).astype(np.int64)
        with np.errstate(over="ignore"):
            rest = t * self.parts + self.ahead - guess * self.total
        return guess + rest // self.total

    def due(self, n: np.ndarray) -> np.ndarray:
        """Tokens of every queue among the first ``n`` of the phase, one row for each ``n``."""
        n = np.asarray(n, np.int64)
        low, high = np.maximum(0, n - len(self.parts)), n + len(self.parts)
        while (low < high).any():
            middle = (low + high) // 2
            enough = self._at(middle).sum(axis=1) >= n
            high, low = np.where(enough, middle, high), np.where(enough, low, middle + 1)
        counts = self._at(np.maximum(low - 1, 0))
        # Of the tick that completes n, queues in order as long as tokens are wanted.
        later = self._at(low) > counts
        more = n - counts.sum(axis=1)
        counts += later & (np.cumsum(later, axis=1) <= more[:, None])
        return np.where(n[:, None] > 0, counts, 0)

    def before(self, first: int, last: int) -> np.ndarray:
        """Tokens of every queue before the windows ``first`` to ``last`` of the phase."""
        k = np.arange(first, last + 1)
        return self.due(np.minimum(k * self.window, self.tokens))

    def window_of(self, queue: int, at: int) -> int:
        """The window that holds the queue's token ``at`` of the phase."""
        part, ahead = int(self.parts[queue]), int(self.ahead[queue])
        tick = -(-((at + 1) * self.total - ahead) // part)
        # Tokens due before the tick, and those of the tick before this queue's.
        earlier, then = self._at(np.array([max(0, tick - 1), tick]))
        if tick == 0:
            earlier = np.zeros_like(then)
        return int(earlier.sum() + (then - earlier)[:queue].sum()) // self.window

    @property
    def counts(self) -> np.ndarray:
        """Tokens of every queue in the first windows."""
        n = min(-(-self.tokens // self.window), WINDOWS_PER_ROUND)
        return np.diff(self.before(0, n), axis=0)


def _whole_shares(weights: np.ndarray, total: int, most: np.ndarray) -> np.ndarray:
    """Whole tokens that sum to ``total`` near the weights, at most ``most`` each."""
    shares = np.zeros(len(weights), np.int64)
    total = min(total, int(most.sum()))
    while (left := total - int(shares.sum())) > 0:
        room = np.where(shares < most, weights, 0.0)
        if not room.any():  # only queues without a weight are left
            room = (shares < most).astype(float)
        exact = room / room.sum() * left
        step = np.minimum(np.floor(exact).astype(np.int64), most - shares)
        if not step.any():
            order = np.argsort(-exact, kind="stable")
            order = order[(shares < most)[order]][:left]
            step[order] = 1
        shares += step
    return shares


def _parts(weights: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whole numbers in the proportion of the weights of queues that have tokens left."""
    live = np.where(left > 0, weights, 0.0)
    if not live.any():  # only queues without a weight are left
        live = left.astype(float)
    if (live == left).all():
        return left.copy()
    parts = np.rint(live * (2.0**60 / live.sum())).astype(np.int64)
    return np.where(live > 0, np.maximum(1, parts), 0)


def schedule(
    totals: np.ndarray, weights: np.ndarray, window: int = WINDOW
) -> list[Phase]:
    """Phases that use up queues of ``totals`` tokens.

    A phase lasts until a queue is used up or, in whole windows, until just
    before; in the latter case the next ones share that last window. Queues that
    run out in one window end in it, so there are at most two phases per queue.
    """
    phases, taken, first = [], np.zeros(len(totals), np.int64), 0
    while (left := totals - taken).any():
        parts = _parts(weights, left)
        size = int(left.sum())
        phase, most = None, -(-size // window)
        share = parts / parts.sum()
        # The first queue to run out does so about here; quotas are within tokens of it.
        full = np.min(left[parts > 0] / share[parts > 0])
        k = int(min(most, full // window + 2))
        while k > 0:
            phase = Phase(parts, min(k * window, size), taken, first, window)
            if (phase.end <= totals).all():
                break
            over = int(((phase.end - totals) / np.maximum(share, 1e-300)).max() // window)
            k -= max(1, min(over - 2, k))
        if k > 0:
            phases.append(phase)
            taken, first = phase.end, first + k
            continue
        # Some queue can't fill its share of the next window: it gives what it has.
        n = min(window, size)
        shares = _whole_shares(parts.astype(float), n, left)
        phase = Phase(shares, n, taken, first, window)
        phases.append(phase)
        taken, first = phase.end, first + 1
    return phases


# Windows whose shares are worked out together.
BLOCK_WINDOWS = 256


def cut(phases: list[Phase], queue: int, at: np.ndarray, n: np.ndarray):
    """Pieces of documents of ``n`` tokens at the queue's positions ``at``, which ascend.

    Arrays (document, start in it, length, window, place in the window).
    """
    pieces, ends = [], [int(p.end[queue]) for p in phases]
    position, last = (int(at[0]), int(at[-1] + n[-1])) if len(at) else (0, 0)
    while position < last:
        i = bisect_right(ends, position)
        p = phases[i]
        k = p.window_of(queue, position - int(p.taken[queue]))
        windows = min(BLOCK_WINDOWS, -(-p.tokens // p.window) - k)
        before = p.before(k, k + windows)
        edges = p.taken[queue] + before[:, queue]
        # Where the queue's tokens begin in each window.
        places = np.diff(before[:, :queue].sum(axis=1))
        end = min(last, int(edges[-1]))
        # Documents that overlap this block, and the windows that each one meets.
        a, b = np.searchsorted(at + n, position, "right"), np.searchsorted(at, end)
        begin, stop = np.maximum(at[a:b], position), np.minimum(at[a:b] + n[a:b], end)
        first = np.searchsorted(edges, begin, "right") - 1
        m = np.searchsorted(edges, stop - 1, "right") - first
        which = np.repeat(np.arange(b - a), m)
        w = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m) + first[which]
        s, e = np.maximum(begin[which], edges[w]), np.minimum(stop[which], edges[w + 1])
        real = e > s  # a window may take nothing of a small queue
        which, w, s, e = which[real], w[real], s[real], e[real]
        pieces.append((a + which, s - at[a + which], e - s, p.first + k + w, places[w] + s - edges[w]))
        position = end
    if not pieces:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*pieces))


def _encoded(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Ids of each document, with its place among the rows of its queue in the task."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part, ahead = TaskContext.get().partitionId(), {}
        ids_of = encoder(tokenizer).encode
        for batch in batch_rows(batches):
            ids = [ids_of(text) + end for text in batch.column("text").to_pylist()]
            places = []
            for queue, b in zip(batch.column("queue").to_pylist(), ids):
                places.append(ahead.get(queue, 0))
                ahead[queue] = places[-1] + len(b) // 4
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("queue"),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(places, pa.int64()),
                    pa.array([len(b) // 4 for b in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "queue", "part", "at", "n", "ids"],
            )

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"),
        "text",
    ).mapInArrow(encode, IDS_SCHEMA)


def pack(
    documents: DataFrame,
    *,
    weights: Mapping[str, float] | None = None,
    tokenizer: str = DEFAULT_TOKENIZER,
    end_id: int = END_ID,
    window: int = WINDOW,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents (doc_id, text, source) in windows of the target mixture.

    ``weights`` are target proportions by source; a source without one is taken
    when the others are used up. By default each source has its share of all
    tokens, so that every window mirrors the corpus. Windows are full but for
    the last, and every token lies in exactly one piece.

    A null source is the source ''; a null or empty text is the end id alone;
    rows that repeat are packed as often as they occur; no rows give no pieces.
    Other columns are not read.
    """
    spark = documents.sparkSession
    path = new_path(spark, "packing-ids")
    _encoded(documents, tokenizer, end_id).write.parquet(path)
    encoded = spark.read.schema(IDS_SCHEMA).parquet(path)

    sizes = encoded.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    totals = sizes.groupBy("queue").agg(F.sum("n").alias("total"))
    largest = totals.orderBy(F.desc("total"), "queue").limit(MAX_QUEUES).collect()
    named = sorted(row["queue"] for row in largest)
    all_tokens = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    by_queue = {row["queue"]: row["total"] for row in largest}
    rest = all_tokens - sum(by_queue.values())
    queues = [*named, REST] if rest else named
    tokens = np.array([by_queue.get(q, rest) for q in queues], np.int64)
    shares = tokens if weights is None else [float(weights.get(q, 0.0)) for q in queues]
    if rest and weights is not None:
        small = totals.filter(F.col("queue").isin(list(weights)) & ~F.col("queue").isin(named)).collect()
        shares[-1] = sum(float(weights[row["queue"]]) for row in small)
    phases = schedule(tokens, np.asarray(shares, float), window)
    number = {q: i for i, q in enumerate(queues)}

    # Runs of the shared queue, one for a source in a task, follow each other in mixed order.
    own = F.col("queue").isin(named) if rest else F.lit(True)
    lane = F.when(own, F.col("queue")).otherwise(F.lit(REST))
    before = (
        Window.partitionBy("lane")
        .orderBy(F.when(F.col("lane") == REST, F.xxhash64("part", "queue")), "part", "queue")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = sizes.withColumn("lane", lane).select(
        "part", "queue", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )

    # As a table its size is known: ids are not shuffled to meet a small one.
    bases_path = new_path(spark, "packing-bases")
    bases.write.parquet(bases_path)
    bases = spark.read.schema(bases.schema).parquet(bases_path)

    def pieces(batches):
        for batch in batch_rows(batches):
            at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
            ids = batch.column("ids").to_pylist()
            lanes = batch.column("lane").dictionary_encode()
            codes = lanes.indices.to_numpy()
            for code, lane in enumerate(lanes.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                own = own[np.argsort(at[own], kind="stable")]
                which, start, length, window, place = cut(phases, number[lane], at[own], n[own])
                row = own[which]
                texts = [ids[r][a : a + m] for r, a, m in zip(row.tolist(), (4 * start).tolist(), (4 * length).tolist())]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(np.fromiter(map(zlib.crc32, texts), np.int64, len(texts))),
                        pa.array(n[row]),
                        pa.array(window),
                        pa.array(place),
                        pa.array([lane] * len(row), pa.string()),
                        pa.array(texts if with_ids else [None] * len(row), pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                           "sequence_id", "offset", "queue", "ids"],
                )

    placed = encoded.join(bases, ["part", "queue"]).select(
        "doc_id", "lane", (F.col("base") + F.col("at")).alias("at"), "n", "ids"
    )
    return placed.mapInArrow(pieces, PIECES_SCHEMA)
