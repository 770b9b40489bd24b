"""Exact top-k search by block-at-a-time pruning.

Vectors are sorted by their nearest pivot, so that ranges of them are alike, and
cut into blocks. A block keeps, for each term (dimension), the greatest and the
least weight in it. The sum of a query's weights times these maxima bounds every
score of the block. A query takes blocks in the order of their bounds, scores
them through the block's forward index, and stops at the first bound that can't
change its k best.

A query first searches the shard in which it would lie itself. The kth score
found there prunes whole shards, by their maxima alone, before any forward index
is sent to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselight.llm.vectors import NOWHERE, Shape, met, shape, stored, usable, whole

BLOCK_ROWS = 64
# Blocks scored between two looks at the kth score.
STEP = 8
# Pivots are fitted on so many rows at most; they decide where a row lies, never whether it is found.
PIVOT_SAMPLE = 1024
PIVOTS = 64
# Queries that travel together.
CHUNK_QUERIES = 512

_NONE = np.iinfo(np.int64).min

BUILT_SCHEMA = (
    "key long, bucket int, ids array<long>, data binary, tops binary, bottoms binary,"
    " firsts array<long>, queries array<long>, wanted binary, best_ids array<long>, best_scores array<long>"
)
FOUND_SCHEMA = "chunk long, place int, query_id long, vec_id long, score long"


def _pivots(rows: DataFrame, form: Shape) -> np.ndarray:
    """Centres of a bounded sample, by a few rounds of spherical k-means."""
    sample = rows.select("vec").orderBy(F.xxhash64("id", "vec")).limit(PIVOT_SAMPLE).collect()
    points = np.zeros((len(sample), form.dims))
    for i, row in enumerate(sample):
        points[i, : len(row["vec"])] = row["vec"]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centres = points[:PIVOTS]
    for _ in range(5 if len(points) > PIVOTS else 0):
        nearest = (points @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own := nearest == c).any():
                mean = points[own].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres if len(centres) else np.zeros((1, form.dims))


class Blocks:
    """A shard: blocks with their term maxima, minima, least ids and forward index."""

    def __init__(self, form: Shape, ids, forward, tops, bottoms, firsts):
        self.ids = np.asarray(ids, np.int64)
        self.tops, self.bottoms = form.read(tops), form.read(bottoms)
        self.firsts = np.asarray(firsts, np.int64)
        self.forward = forward

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ self.tops.T + np.minimum(queries, 0) @ self.bottoms.T

    def search(self, queries, own, k, score, last):
        """For each query, up to k rows better than its kth one (``score``, ``last``) so far."""
        bounds = self.bounds(queries)
        within = np.arange(BLOCK_ROWS)
        for i, query in enumerate(queries):
            least, tie = score[i], last[i]
            best, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
            order = np.lexsort((self.firsts, -bounds[i]))
            at = 0
            while at < len(order):
                some = order[at : at + STEP]
                hopes = bounds[i, some]
                some = some[(hopes > least) | (hopes == least) & (self.firsts[some] < tie)]
                if not len(some):
                    break  # no later block has a greater bound, nor an equal one and a smaller id
                rows = (some[:, None] * BLOCK_ROWS + within).ravel()
                rows = rows[rows < len(self.ids)]
                scores = (self.forward[rows] @ query).astype(np.int64)
                ids = self.ids[rows]
                good = ((scores > least) | (scores == least) & (ids < tie)) & (ids != own[i])
                if good.any():
                    best, names = np.r_[best, scores[good]], np.r_[names, ids[good]]
                    keep = np.lexsort((names, -best))[:k]
                    best, names = best[keep], names[keep]
                    if len(best) == k:
                        least, tie = best[-1], names[-1]
                at += STEP
            yield names, best


def _build(form: Shape, k: int):
    """Shards of a task's sorted rows, and chunks of the queries among them."""

    def shard(key, part, ids, data, queries, wanted):
        starts = np.arange(0, len(ids), BLOCK_ROWS)
        tops = np.maximum.reduceat(data, starts) if len(ids) else data
        bottoms = np.minimum.reduceat(data, starts) if len(ids) else data
        firsts = np.minimum.reduceat(ids, starts) if len(ids) else ids
        blocks = Blocks(form, ids, data.astype(form.exact), tops.tobytes(), bottoms.tobytes(), firsts)
        n = len(queries)
        found = blocks.search(
            wanted.astype(form.exact), queries, k, np.full(n, _NONE), np.full(n, NOWHERE)
        )
        best_ids, best = np.full((n, k), NOWHERE), np.full((n, k), _NONE)
        for i, (names, scores) in enumerate(found):
            best_ids[i, : len(names)], best[i, : len(names)] = names, scores
        lists = [ids, firsts, queries, best_ids.ravel(), best.ravel()]
        ids_, firsts_, queries_, best_ids_, best_ = (pa.array([x], pa.list_(pa.int64())) for x in lists)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (data, tops, bottoms, wanted)]
        columns = [pa.array([key], pa.int64()), pa.array([part % form.partitions], pa.int32()), ids_, *blobs[:3],
                   firsts_, queries_, blobs[3], best_ids_, best_]
        return pa.record_batch(columns, names=[c.split()[0] for c in BUILT_SCHEMA.split(", ")])

    def build(batches):
        part, key = TaskContext.get().partitionId(), 0
        none = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, form.dims), form.stored)
        ids, asks, data = none
        for batch in [*batches, None]:
            if batch is not None:
                ids = np.r_[ids, batch.column("id").to_numpy()]
                asks = np.r_[asks, batch.column("asks").to_numpy(zero_copy_only=False)]
                data = np.concatenate([data, form.matrix(batch.column("vec"))])
            while len(ids) and (batch is None or len(ids) > form.shard_rows):
                n = form.shard_rows
                n = min(n, int(np.searchsorted(np.cumsum(asks[:n]), CHUNK_QUERIES, "right")) or 1)
                q = asks[:n]
                yield shard((part << 32) + key, part, ids[:n][~q], data[:n][~q], ids[:n][q], data[:n][q])
                key += 1
                ids, asks, data = ids[n:], asks[n:], data[n:]

    return build


def _chunk(row, k):
    best = np.asarray(row["best_scores"], np.int64).reshape(-1, k)
    names = np.asarray(row["best_ids"], np.int64).reshape(-1, k)
    return np.asarray(row["queries"], np.int64), best, names


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of the highest inner product.

    Components count as ``floor(256 * x)``; a score must fit a signed 64-bit
    number. Ties go to the smaller id; a query is no candidate of its own id. All
    candidates are returned where there are fewer than k; a query without any has
    no row. Null vectors, vectors with a null or non-finite component and rows
    without an id take no part. Shorter vectors end in zeros, an empty one is all
    zeros. Rows equal in id and vector count once; one id with several vectors is
    several candidates, or several queries, each ranked on its own. Other columns
    are not read.
    """
    def ready(rows, asks):
        own = F.col(id).cast("long").alias("id")
        return (
            rows.filter(usable(vector) & F.col(id).isNotNull())
            .select(own, whole(vector).alias("vec")).distinct()
            .withColumn("asks", F.lit(asks))
        )

    rows = stored(ready(candidates, False).unionByName(ready(queries, True)), "vectors")
    form = shape(rows)
    pivots = _pivots(rows, form)

    def coded(batches):
        for batch in batches:
            nearest = (form.matrix(batch.column("vec")) @ pivots.T).argmax(axis=1)
            yield batch.append_column("code", pa.array(nearest, pa.int32()))

    built = stored(
        rows.mapInArrow(coded, "id long, vec array<long>, asks boolean, code int")
        .repartitionByRange(form.partitions, "code", "id")
        .sortWithinPartitions("code", "id", "asks")
        .mapInArrow(_build(form, k), BUILT_SCHEMA),
        "blocks",
    )
    shards = built.filter(F.size("ids") > 0).select(
        F.col("key").alias("shard"), "bucket", "ids", "data", "tops", "bottoms", "firsts"
    )
    chunks = built.filter(F.size("queries") > 0).select(
        F.col("key").alias("chunk"), "queries", "wanted", "best_ids", "best_scores"
    )

    def hopeful(batches):
        """Pairs in which some block of the shard can change some query's k best."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                _, best, names = _chunk(row, k)
                blocks = Blocks(form, [], None, row["tops"], row["bottoms"], row["firsts"])
                bounds = blocks.bounds(form.read(row["wanted"]))
                least, tie = best[:, -1:], names[:, -1:]
                if ((bounds > least) | (bounds == least) & (blocks.firsts < tie)).any():
                    out.append((row["chunk"], row["shard"]))
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(2)]
            yield pa.record_batch(columns, names=["chunk", "shard"])

    numbers = F.explode(F.sequence(F.lit(0), F.lit(form.partitions - 1)))
    maxima = shards.select("shard", "bucket", "tops", "bottoms", "firsts")
    pairs = (
        chunks.withColumn("bucket", numbers).join(maxima, "bucket")
        .filter("chunk <> shard").mapInArrow(hopeful, "chunk long, shard long")
    )

    def search(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for row in batch.to_pylist():
                own, best, names = _chunk(row, k)
                forward = form.read(row["data"])
                blocks = Blocks(form, row["ids"], forward, row["tops"], row["bottoms"], row["firsts"])
                found = blocks.search(form.read(row["wanted"]), own, k, best[:, -1], names[:, -1])
                for i, (ids, scores) in enumerate(found):
                    n = len(ids)
                    for column, values in zip(out, ([row["chunk"]] * n, [i] * n, [own[i]] * n, ids, scores)):
                        column.extend(values)
            yield _rows(out)

    def first(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for row in batch.to_pylist():
                own, best, names = _chunk(row, k)
                place, nth = np.nonzero(names != NOWHERE)
                columns = ([row["chunk"]] * len(place), place, own[place], names[place, nth], best[place, nth])
                for column, values in zip(out, columns):
                    column.extend(values)
            yield _rows(out)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    elsewhere = met(stored(pairs, "hopeful"), chunks, shards, tasks).mapInArrow(search, FOUND_SCHEMA)
    found = elsewhere.unionByName(chunks.mapInArrow(first, FOUND_SCHEMA))
    ranked = Window.partitionBy("chunk", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _rows(out: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["chunk", "place", "query_id", "vec_id", "score"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=names)
