import hashlib
import random
import zlib

import numpy as np
from clauselight.llm import periodic_runs
from clauselight.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period: stretches of equal words that far apart, without those of a smaller one."""
    found = set()
    n = len(words)
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.r_[False, ids[q:] == ids[:-q], False]
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + q
            if length >= max(6, 4 * q) and not any((start, length, p) in found for p in range(1, q)):
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(text):
    words = (text or "").encode().split()
    runs = plain_runs(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def texts(seed):
    r = random.Random(seed)
    for _ in range(150):
        k = r.choice([1, 2, 2, 3, 6])
        words = [str(r.randrange(k)) for _ in range(r.choice([0, 1, 5, 6, 7, 25, 70]))]
        for _ in range(r.randint(0, 3)):
            at, unit = r.randint(0, len(words)), [str(r.randrange(k)) for _ in range(r.randint(1, 6))]
            words[at:at] = (unit * 30)[: r.randint(1, 40)]
        yield r.choice([" ", "\n", " \t "]).join(words)


def test_runs_agree_with_every_period(spark):
    rows = [(i, t, 3, [1]) for i, t in enumerate([*texts(1), *texts(2), None, "", " \t\n", "é é é é é é", "a b " * 7])]
    rows += [(0, "b " * 9, 3, [1]), (0, "b " * 9, 3, [1]), (None, "a b " * 5, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, start long, runs array<int>").repartition(3)
    got = periodic_runs.digest(periodic_runs.find(table)).collect()
    want = [(i, *plain_row(t)) for i, t, *_ in rows]
    key = lambda x: [str(v) for v in x]
    assert sorted([tuple(r[c] for c in ["doc_id", *FIELDS]) for r in got], key=key) == sorted(want, key=key)


def test_long_and_unfavourable_texts():
    """Deep chains, many copies of one periodic phrase, Fibonacci words: all of them in little time."""
    a, b = ["a"], ["a", "b"]
    while len(b) < 30_000:
        a, b = b, b + a
    chorus = [w for i in range(3000) for w in [f"x{i}", *["na"] * 7]]
    cases = [["a"] * 60_000, b, chorus, ["a", "b", "c"] * 10_000 + ["d"]]
    encoded = [[w.encode() for w in c] for c in cases]
    one, fibonacci, chorus_runs, triple = periodic_runs.runs_of(encoded)
    assert one.tolist() == [[0, 60_000, 1]] and triple.tolist() == [[0, 30_000, 3]]
    assert chorus_runs.tolist() == [[8 * i + 1, 7, 1] for i in range(3000)]
    assert len(fibonacci) == 0  # no power above 2 + golden ratio
    small = periodic_runs.runs_of([encoded[1][:500] + encoded[0][:9] + encoded[1][:200]])[0]
    assert [tuple(r) for r in small.tolist()] == plain_runs(encoded[1][:500] + encoded[0][:9] + encoded[1][:200])


def test_no_documents(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digest(periodic_runs.find(table)).count() == 0


def test_query_agrees_with_every_period(spark):
    got = {r.doc_id: r for r in QUERIES["op12_maximal_pair_runs"](spark, SF_DIR).collect()}
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(documents)
    for d in documents:
        words = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            start = g % n
            p = 1 + (n - start) // (3 + g % 8)
            words = [words[i] if i < start else words[start + (i - start) % p] for i in range(n)]
        assert tuple(got[d.doc_id][c] for c in FIELDS) == plain_row(b" ".join(words).decode())
