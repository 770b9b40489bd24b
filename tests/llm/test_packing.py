import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from clauselight.llm import packing, tokens


def documents(spark, n=60):
    rows = [(i, f"text {i} " * (i % 17), None if i % 11 == 0 else f"s{i % 3}", 0) for i in range(n)]
    rows += [(n, "x " * 9000, "s1", 0), (n, "x " * 9000, "s1", 0), (n + 1, None, "s2", 0), (n + 2, "", "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, sequence_id long")


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 1.0}, {"other": 1.0}])
def test_every_id_lies_in_one_piece(spark, weights):
    docs = documents(spark)
    pieces = packing.pack(docs, weights=weights).collect()
    encode = tokens.encoder(tokens.DEFAULT_TOKENIZER).encode
    end = np.array([1], "<u4").tobytes()
    want = sorted((r.doc_id, encode(r.text) + end) for r in docs.collect())
    by_window, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_window[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
        assert len(p.ids) == 4 * p.length and p.ids_crc32 == zlib.crc32(p.ids)
    total = sum(len(b) // 4 for _, b in want)
    assert sorted(by_window) == list(range(-(-total // 2048)))
    for window, spans in by_window.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == (2048 if window < len(by_window) - 1 else total - 2048 * window)
    for doc, ids in {d: b for d, b in want}.items():
        copies = sum(d == doc for d, _ in want)
        got = sorted(by_doc[doc], key=lambda p: p.start)
        assert sum(p.length for p in got) == copies * len(ids) // 4
        for p in got:
            assert p.ids == ids[4 * p.start : 4 * (p.start + p.length)]
            assert p.doc_tokens == len(ids) // 4


def test_windows_hold_the_target_mixture():
    totals = np.array([700_000, 200_000, 100_000, 3])
    phases = packing.schedule(totals, totals.astype(float))
    assert (phases[-1].end == totals).all() and len(phases) <= 2 * len(totals)
    for counts in phases[0].counts:
        assert np.abs(counts - 2048 * totals / totals.sum()).max() < 2


def test_sources_below_a_token_a_round_enter_the_mixture():
    totals = np.array([10_000_000_000, *[50_000] * 20])
    phases = packing.schedule(totals, totals.astype(float))
    assert len(phases) <= 2 * len(totals) and (phases[-1].end == totals).all()
    n_windows = -(-int(totals.sum()) // 2048)
    for queue in (1, 20):
        tenth, last = packing.cut(phases, queue, np.array([5_000, 49_999]), np.array([1, 1]))[3].tolist()
        assert abs(tenth / n_windows - 0.1) < 0.01 and last > 0.99 * n_windows
    # No quota departs from the target by more than a few tokens, in any run of windows.
    p = phases[0]
    for k in (1, 1000, n_windows // 2):
        due = min(k * 2048, p.tokens) * (totals / totals.sum())
        assert np.abs(p.before(k, k)[0] - due)[1:].max() <= 1 and abs(p.before(k, k)[0, 0] - due[0]) <= len(totals)


def test_quotas_are_exact_for_large_numbers():
    r = np.random.default_rng(1)
    parts = np.r_[r.integers(1, 1 << 40, 40), 0, 1 << 58]
    phase = packing.Phase(parts, 1 << 44, np.zeros(len(parts), np.int64), 0, 2048)
    for n in (1, 2047, 2048, 12_345_678_901, 1 << 44):
        [got] = phase.due(np.array([n]))
        tick = 0 if n == 0 else n
        plain = lambda t: [(t * int(p) + int(a)) // phase.total for p, a in zip(parts, phase.ahead)]
        while sum(plain(tick)) >= n:
            tick -= 1
        while sum(plain(tick)) < n:
            tick += 1
        want, more = plain(tick - 1), n - sum(plain(tick - 1))
        for i, later in enumerate(plain(tick)):
            if more and later > want[i]:
                want[i], more = want[i] + 1, more - 1
        assert got.tolist() == want


def test_many_weighted_sources_are_scheduled_soon():
    r = np.random.default_rng(2)
    totals, weights = r.integers(1_000, 10_000_000, 1024), r.random(1024)
    began = time.perf_counter()
    phases = packing.schedule(totals, weights)
    assert time.perf_counter() - began < 10 and (phases[-1].end == totals).all()


def test_shares_follow_weights_until_a_queue_is_used_up():
    totals = np.array([1_000_000, 1_000_000, 50_000])
    phases = packing.schedule(totals, np.array([1.0, 3.0, 0.0]))
    first = phases[0].counts
    assert np.abs(first[:, 0] - 512).max() <= 1 and (first[:, 2] == 0).all()
    assert (phases[-1].end == totals).all()


def test_small_sources_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    docs = documents(spark)
    pieces = packing.pack(docs).collect()
    assert len({p.queue for p in pieces}) == 3
    places = [(p.sequence_id, p.offset) for p in pieces]
    assert len(set(places)) == len(places)
    assert sum(p.length for p in pieces) == sum(
        len(tokens.encoder(tokens.DEFAULT_TOKENIZER).encode(r.text)) // 4 + 1 for r in docs.collect()
    )


def test_weights_of_small_sources_add_up(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 1)
    rows = [(i, "word " * 400, "big" if i < 80 else f"small{i % 4}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"big": 1.0, **{f"small{i}": 0.25 for i in range(4)}, "absent": 9.0}
    first = [p for p in packing.pack(docs, weights=weights).collect() if p.sequence_id == 0]
    assert abs(sum(p.length for p in first if p.queue != "big") - 1024) <= 2


def test_no_documents(spark):
    assert packing.pack(documents(spark).filter("false")).count() == 0
