import random
from math import floor

import numpy as np
import pytest
from clauselight.llm import block_pruning, checks, hard_negatives, vectors
from clauselight.llm.queries import QUERIES
from compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, score long, id string"


def odd_rows(n=260, dims=9, seed=3):
    """Ties, copies, rows that take no part, short vectors, a hot vector and a hot label."""
    r = random.Random(seed)
    hot = [float(np.float32(r.uniform(-1, 1))) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else [float(np.float32(r.choice([0, 0, 0.5, -0.25, r.uniform(-1, 1)]))) for _ in range(dims)]
        rows.append((i, v[: r.choice([dims, dims, dims, 3])], r.choice([1, 1, 2, -3]), 7, "x"))
    rows += [rows[0], rows[50], (50, [1.0] * dims, 1, 0, ""), (200, [], 2, 0, ""), (300, [0.0] * dims, 1, 0, "")]
    rows += [(400, None, 1, 0, ""), (401, [1.0, None], 1, 0, ""), (402, [1.0, float("nan")], 1, 0, "")]
    rows += [(403, [float("inf")], 1, 0, ""), (None, hot, 1, 0, ""), (100, hot, None, 0, "")]
    return rows


def usable(rows):
    seen = {}
    for i, v, label, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            seen[i, label, tuple(floor(256 * x) for x in v)] = None
    return list(seen)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("shard_bytes", [1 << 20, 64 * 9 * 2])
def test_top_k_agrees_with_every_score(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(vectors, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(block_pruning, "CHUNK_QUERIES", 3)
    rows = odd_rows()
    table = spark.createDataFrame(rows, SCHEMA)
    got = block_pruning.top_k(table, table.filter("vec_id % 50 = 0"), k=5).collect()
    every = {(i, v) for i, _, v in usable(rows)}
    want = []
    for q, v in every:
        if q % 50 == 0:
            best = sorted(((-dot(v, w), i) for i, w in every if i != q))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_with_few_or_no_candidates(spark):
    table = spark.createDataFrame(odd_rows()[:3], SCHEMA)
    got = block_pruning.top_k(table, table, k=5).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(i, n) for i in range(3) for n in (1, 2)]
    none = table.filter("false")
    assert block_pruning.top_k(none, table).count() == 0
    assert block_pruning.top_k(table, none).count() == 0
    assert block_pruning.top_k(none, none).count() == 0


def test_blocks_that_cannot_change_the_best_are_not_scored():
    form = vectors.Shape(256, 2, "<i2", "f8", 400.0, 64)
    data = np.r_[np.tile([[200, 0]], (64, 1)), np.tile([[0, 200]], (192, 1))].astype("<i2")
    starts = np.arange(0, 256, 64)
    tops, bottoms = np.maximum.reduceat(data, starts), np.minimum.reduceat(data, starts)

    class Counted:
        def __init__(self):
            self.rows = 0

        def __getitem__(self, rows):
            self.rows += len(rows)
            return data[rows].astype("f8")

    forward = Counted()
    blocks = block_pruning.Blocks(form, np.arange(256), forward, tops.tobytes(), bottoms.tobytes(), starts)
    query = np.array([[100.0, 1.0]])
    [(ids, scores)] = blocks.search(query, [999], 5, [20_000], [5])
    assert ids.tolist() == [0, 1, 2, 3, 4] and set(scores) == {20_000}
    assert forward.rows == 64


def mined(rows):
    every, want = usable(rows), []
    every = [x for x in every if x[1] is not None]
    for anchor, label, v in every:
        if anchor % 10 == 0:
            scored = sorted((-dot(v, w), i, other == label) for i, other, w in every if i != anchor)
            for p, i, _ in [x for x in scored if x[2]][:5]:
                hard = [x for x in scored if not x[2] and -80 * p <= -100 * x[0] <= -100 * p][:5]
                want += [(anchor, i, n, j, -p, -s) for n, (s, j, _) in enumerate(hard, 1)]
    return sorted(want)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 64 * 9 * 2])
def test_hard_negatives_agree_with_every_score(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(vectors, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(hard_negatives, "CHUNK_ANCHORS", 4)
    rows = odd_rows()
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), "vec_id % 10 = 0").collect()
    assert sorted(map(tuple, got)) == mined(rows)


def test_hard_negatives_without_rows_or_other_labels(spark):
    table = spark.createDataFrame(odd_rows(), SCHEMA)
    assert hard_negatives.mine(table.filter("false"), "vec_id % 10 = 0").count() == 0
    assert hard_negatives.mine(table.filter("label = 1"), "vec_id % 10 = 0").count() == 0
    assert hard_negatives.mine(table, "vec_id < 0").count() == 0


def test_a_threshold_omits_postings_and_loses_no_row():
    r = np.random.default_rng(5)
    data = r.integers(-60, 60, (400, 24)).astype("<i2")
    form = vectors.Shape(400, 24, "<i2", "f8", 400.0, 64)
    index = hard_negatives.Index(form, np.arange(400), np.zeros(400), data.tobytes())
    for query in data[:20].astype("f8"):
        scores = data.astype(np.int64) @ query.astype(np.int64)
        for least in (-100, 0, 1, 5_000, 20_000, int(scores.max()), int(scores.max()) + 1):
            rows, got = index.reach(query, least)
            assert rows.tolist() == np.flatnonzero(scores >= least).tolist()
            assert (got == scores[rows]).all()
    cut = 0.5 * np.linalg.norm(data[0])
    kept = sum(int(np.searchsorted(norms, -cut, "right")) for norms, _, _ in index.lists)
    assert kept < 0.9 * np.count_nonzero(data)


@pytest.mark.parametrize("name, sql", [("op11_block_pruned_top_k", checks.OP11), ("op13_l2ap_hard_negatives", checks.OP13)])
def test_queries_agree_with_sql(spark, name, sql):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), sql) is None
