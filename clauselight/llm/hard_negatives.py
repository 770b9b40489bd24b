"""Hard negatives by threshold joins over an inverted index with norm bounds.

A shard of rows is indexed by dimension. With P(x, j) the length of the first
j + 1 components of x, no pair can reach a score of t through components whose
P(x, j) is below t / |q| alone; those are omitted. Postings are sorted by P, so
what a threshold omits is the tail of each list, and one index serves every
threshold. Lists are read from the last dimension to the first into partial
scores; rows whose partial score and remaining norms can't reach the threshold
are dropped, and the rest completed from their first components.

Thresholds start high and are lowered only for windows that are not yet full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselight.llm.vectors import NOWHERE, Shape, met, shape, stored, usable, whole

# Anchors that travel together.
CHUNK_ANCHORS = 256
# Dimensions read between two looks at the remaining norms.
STEP = 8
# Below this share of live rows it is cheaper to complete them than to read on.
FEW = 0.1
# Slack for rounding in norms; it only ever keeps more rows.
_SLACK = 1e-9
#: Thresholds for positives, as shares of the greatest score that the norms allow.
POSITIVE_LEVELS = (0.6, 0.3, 0.0)
#: Thresholds for negatives, as shares of the positive's score; the last is the window's own end.
NEGATIVE_LEVELS = (90, 80)

SHARD_SCHEMA = "shard long, bucket int, low long, high long, ids array<long>, labels array<long>, data binary"
CHUNK_SCHEMA = (
    "chunk long, label long, anchors array<long>, own array<long>, data binary,"
    " windows array<array<struct<top:long,least:long>>>"
)
FOUND_SCHEMA = "anchor long, top long, id long, score long"


class Index:
    """Posting lists of a shard, each sorted by the norm of the components up to it."""

    def __init__(self, form: Shape, ids, labels, data: bytes):
        self.ids, self.labels = np.asarray(ids, np.int64), np.asarray(labels, np.int64)
        forward = form.read(data)
        # Dimensions that most rows have come first: their long lists are omitted first.
        self.order = np.argsort(-np.count_nonzero(forward, axis=0), kind="stable")
        self.forward = np.ascontiguousarray(forward[:, self.order])
        squares = np.cumsum(np.square(self.forward, dtype=np.float64), axis=1)
        self.norms = np.c_[np.zeros(len(forward)), np.sqrt(squares)]  # column j: of the first j
        self.lists = []
        for j in range(form.dims):
            rows = np.flatnonzero(self.forward[:, j])
            rows = rows[np.argsort(-self.norms[rows, j + 1], kind="stable")]
            self.lists.append((-self.norms[rows, j + 1], rows, self.forward[rows, j]))

    def _hope(self, partial, unread, lengths):
        """What rows may score at most: the partial score and the norms of what is unread."""
        rest = lengths[unread] * self.norms[np.arange(len(unread)), unread]
        return partial + rest * (1 + _SLACK)

    def reach(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score with the query is at least ``least``, and their scores."""
        query = query[self.order]
        dims = len(query)
        lengths = np.r_[0.0, np.sqrt(np.cumsum(np.square(query, dtype=np.float64)))]
        below = np.nextafter(least, -np.inf) - abs(least) * _SLACK
        cut = below / lengths[-1] * (1 - _SLACK) if lengths[-1] and least > 0 else 0.0
        partial = np.zeros(len(self.ids), self.forward.dtype)
        unread = np.full(len(self.ids), dims)  # components before this one are not in the partial score
        few = FEW * len(self.ids)
        for j in range(dims - 1, -1, -1):
            if query[j]:  # else nothing to add
                norms, rows, values = self.lists[j]
                n = np.searchsorted(norms, -cut, "right")
                partial[rows[:n]] += query[j] * values[:n]
                unread[rows[:n]] = j
            if j and j % STEP == 0 and np.count_nonzero(self._hope(partial, unread, lengths) >= below) < few:
                break
        rows = np.flatnonzero(self._hope(partial, unread, lengths) >= below)
        rest = np.where(np.arange(dims) < unread[rows, None], self.forward[rows], 0)
        scores = (partial[rows] + rest @ query).astype(np.int64)
        good = scores >= least
        return rows[good], scores[good]


def _shards(form: Shape):
    """Shards of a task's rows, which come sorted by label."""

    def build(batches):
        part, key = TaskContext.get().partitionId(), 0
        ids, labels = np.zeros(0, np.int64), np.zeros(0, np.int64)
        data = np.zeros((0, form.dims), form.stored)
        for batch in [*batches, None]:
            if batch is not None:
                ids = np.r_[ids, batch.column("id").to_numpy()]
                labels = np.r_[labels, batch.column("label").to_numpy()]
                data = np.concatenate([data, form.matrix(batch.column("vec"))])
            while len(ids) and (batch is None or len(ids) > form.shard_rows):
                n = min(form.shard_rows, len(ids))
                longs = pa.list_(pa.int64())
                columns = [
                    pa.array([(part << 32) + key], pa.int64()),
                    pa.array([part % form.partitions], pa.int32()),
                    pa.array([labels[:n].min()]), pa.array([labels[:n].max()]),
                    pa.array([ids[:n]], longs), pa.array([labels[:n]], longs),
                    pa.array([data[:n].tobytes()], pa.binary()),
                ]
                yield pa.record_batch(columns, names=["shard", "bucket", "low", "high", "ids", "labels", "data"])
                key += 1
                ids, labels, data = ids[n:], labels[n:], data[n:]

    return build


def _chunks(form: Shape):
    """Anchors of one label together, up to a number."""

    def build(batches):
        part, key = TaskContext.get().partitionId(), 0
        for batch in batches:
            labels = batch.column("label").to_numpy()
            data = form.matrix(batch.column("vec"))
            ends = np.flatnonzero(np.r_[labels[1:] != labels[:-1], True]) + 1
            out = []
            for first, end in zip(np.r_[0, ends[:-1]], ends):
                for a in range(first, end, CHUNK_ANCHORS):
                    b = min(end, a + CHUNK_ANCHORS)
                    own = [batch.column(c)[a:b].to_pylist() for c in ("anchor", "id", "windows")]
                    out.append(((part << 32) + key, labels[a], *own[:2], data[a:b].tobytes(), own[2]))
                    key += 1
            longs, window = pa.list_(pa.int64()), pa.struct([("top", pa.int64()), ("least", pa.int64())])
            kinds = [pa.int64(), pa.int64(), longs, longs, pa.binary(), pa.list_(pa.list_(window))]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch(columns, names=["chunk", "label", "anchors", "own", "data", "windows"])

    return build


class Rows:
    """The rows to be searched, indexed in shards of about one label each."""

    def __init__(self, rows: DataFrame):
        """``rows``: id, label, vec."""
        self.form = shape(rows)
        self.shards = stored(
            rows.repartitionByRange(self.form.partitions, "label", "id")
            .sortWithinPartitions("label", "id").mapInArrow(_shards(self.form), SHARD_SCHEMA),
            "shards",
        )
        self.tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def within(self, anchors: DataFrame, windows: DataFrame, same: bool, n: int) -> DataFrame:
        """anchor, top, id, score: the first ``n`` rows of each window.

        ``windows`` (anchor, top, least) are score ranges, both ends included;
        ``same`` says whether rows must share the anchor's label or must not.
        """
        form = self.form
        ranges = windows.groupBy("anchor").agg(F.collect_set(F.struct("top", "least")).alias("windows"))
        chunks = stored(
            anchors.join(ranges, "anchor").repartitionByRange(self.form.partitions, "label", "anchor")
            .sortWithinPartitions("label", "anchor").select("anchor", "id", "label", "vec", "windows")
            .mapInArrow(_chunks(form), CHUNK_SCHEMA),
            "anchors",
        )

        def search(batches):
            held = None, None
            for batch in batches:
                out = [[] for _ in range(4)]
                for row in batch.to_pylist():
                    if held[0] != row["shard"]:
                        held = row["shard"], Index(form, row["ids"], row["labels"], row["rows"])
                    index = held[1]
                    of_label = (index.labels == row["label"]) == same
                    queries = form.read(row["data"])
                    for anchor, own, query, asked in zip(row["anchors"], row["own"], queries, row["windows"]):
                        rows, scores = index.reach(query, min(w["least"] for w in asked))
                        fit = of_label[rows] & (index.ids[rows] != own)
                        ids, scores = index.ids[rows[fit]], scores[fit]
                        order = np.lexsort((ids, -scores))
                        ids, scores = ids[order], scores[order]
                        for w in asked:
                            first = np.searchsorted(-scores, -w["top"])
                            end = min(first + n, np.searchsorted(-scores, -w["least"], "right"))
                            m = max(0, int(end - first))
                            for column, values in zip(
                                out, ([anchor] * m, [w["top"]] * m, ids[first:end], scores[first:end])
                            ):
                                column.extend(values)
                columns = [pa.array(c, pa.int64()) for c in out]
                yield pa.record_batch(columns, names=["anchor", "top", "id", "score"])

        numbers = F.explode(F.sequence(F.lit(0), F.lit(form.partitions - 1)))
        labels = self.shards.select("shard", "bucket", "low", "high")
        if same:
            possible = F.col("label").between(F.col("low"), F.col("high"))
        else:
            possible = ~((F.col("label") == F.col("low")) & (F.col("label") == F.col("high")))
        pairs = chunks.select("chunk", "label", numbers.alias("bucket")).join(labels, "bucket")
        pairs = pairs.filter(possible).select("chunk", "shard")
        shards = self.shards.select("shard", "ids", "labels", F.col("data").alias("rows"))
        found = met(pairs, chunks, shards, self.tasks).mapInArrow(search, FOUND_SCHEMA)
        ranked = Window.partitionBy("anchor", "top").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)

    def fill(self, anchors, windows, levels, least: Callable[[object], Column], same: bool, n: int):
        """``within`` for windows (anchor, top), lowering ``least(level)`` until each has ``n`` rows."""
        full = None
        for level in levels:
            asked = windows.withColumn("least", least(level))
            found = stored(self.within(anchors, asked, same, n), "windows")
            if level == levels[-1]:
                return found if full is None else full.unionByName(found)
            done = stored(found.filter(F.col("rank") == n).select("anchor", "top"), "full")
            ready = found.join(done, ["anchor", "top"], "left_semi")
            full = ready if full is None else full.unionByName(ready)
            windows = windows.join(done, ["anchor", "top"], "left_anti")


def mine(
    rows: DataFrame,
    is_anchor: Column | str,
    *,
    positives: int = 5,
    negatives: int = 5,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """Hard negatives: for each anchor and positive, rows of other labels that score nearly as high.

    Components count as ``floor(256 * x)``, scores are their inner products and must
    fit a signed 64-bit number. An anchor's positives are its first ``positives``
    other rows of its label, its negatives with score s for a positive of score p
    the first ``negatives`` rows of another label with 80 p <= 100 s <= 100 p; higher scores
    come first, ties by smaller id. A positive with a negative score has no such
    row, so positives are searched down to a score of 0.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Rows without an id or a label, null vectors and vectors with a
    null or non-finite component take no part. Shorter vectors end in zeros. Rows
    equal in id, label and vector count once; one id with several vectors or labels is
    several rows, each an anchor of its own. Other columns are not read.
    """
    wanted = is_anchor if isinstance(is_anchor, Column) else F.expr(is_anchor)
    ready = stored(
        rows.filter(usable(vector) & F.col(id).isNotNull() & F.col(label).isNotNull())
        .select(
            F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
            whole(vector).alias("vec"), F.coalesce(wanted, F.lit(False)).alias("asks"),
        )
        .distinct(),
        "vectors",
    )
    index = Rows(ready)
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    anchors = stored(
        ready.filter("asks")
        .select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "vec", F.sqrt(square).alias("norm")),
        "anchors",
    )

    # Nothing scores more than the norms allow: one open window an anchor.
    highest = F.ceil(F.col("norm") * index.form.norm * (1 + _SLACK))
    near = index.fill(
        anchors,
        anchors.select("anchor", F.lit(NOWHERE).alias("top"), highest.alias("highest")),
        POSITIVE_LEVELS,
        lambda share: F.ceil(F.col("highest") * share),
        True,
        positives,
    ).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("top"))
    near = stored(near, "positives")
    # The least whole score with 100 s >= level * p.
    hard = index.fill(
        anchors,
        near.select("anchor", "top").distinct(),
        NEGATIVE_LEVELS,
        lambda level: F.expr(f"({level} * top + 99) div 100"),
        False,
        negatives,
    )
    found = near.join(hard, ["anchor", "top"]).join(anchors.select("anchor", F.col("id").alias("own")), "anchor")
    return found.select(
        F.col("own").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
        F.col("top").alias("positive_score"), F.col("score").alias("negative_score"),
    )
