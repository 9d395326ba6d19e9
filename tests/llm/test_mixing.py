import collections

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from leafmill.llm import mixing as M, tokens as K

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(K.VOCABULARY), reason="no vocabulary")


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 10**9))
def test_permutation(size, key):
    assert sorted(M.permute(np.arange(size), size, key)) == list(range(size))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 50))
def test_shards_share_out_every_slot(counts, slots):
    c = np.array(counts, np.int64)
    shards = -(-int(c.sum()) // slots)
    before = np.zeros(len(c), np.int64)
    for s in range(shards):
        here, ahead = M.shard_counts(c, s, shards, slots)
        assert (ahead == before).all() and here.sum() == min(slots, c.sum() - before.sum())
        before = before + here
    assert (before == c).all()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(0, 1000), st.floats(0.01, 1), st.integers(0, 4)), min_size=1), st.integers(0, 5000))
def test_quotas(spec, total):
    tokens, targets = {s: t for s, (t, _, _) in spec.items()}, {s: (w, r) for s, (_, w, r) in spec.items()}
    q, cap = M.quotas(tokens, targets, total), {s: t * r for s, (t, _, r) in spec.items()}
    assert all(-1e-6 <= q[s] <= cap[s] + 1e-6 for s in spec)
    assert abs(sum(q.values()) - min(total, sum(cap.values()))) < 1e-3
    free = [s for s in spec if q[s] < cap[s] - 1e-3]
    rates = [q[s] / targets[s][0] for s in free]
    assert not rates or max(rates) - min(rates) < 1e-3 * max(1, max(rates))
    assert all(q[s] / targets[s][0] <= min(rates) + 1e-3 for s in spec if rates and s not in free)  # full ones have less


def test_mix(spark):
    docs = [(i, f"word{i} and more text of document {i} " * 6, s, "x", 1) for i, s in enumerate(["big"] * 40 + ["small"] * 4 + ["other"] * 9)]
    docs += [(100, None, "big", "x", 1), (101, "", "small", "x", 1), (102, "left out", None, "x", 1)]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING, block STRING, slot INT")
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("none", 0.05, 4), ("nul", None, 4), (None, 0.05, 1), ("small", 0.1, 9)], "source STRING, target_share DOUBLE, max_repeats INT")
    m = M.mix(d, t, block=16, per_shard=20)
    rows = m.collect()
    enc = K.Encoder(K.serialise_model(K.read_ranks()))
    size = collections.Counter()
    for i, text, s, *_ in docs:
        size[s] += len(enc.encode(text))
    assert {r.source for r in rows} == {"big", "small"} and len({(r.shard, r.slot) for r in rows}) == len(rows) and max(r.slot for r in rows) < 20
    uses = collections.Counter((r.source, r.block) for r in rows)
    assert max(n for (s, _), n in uses.items() if s == "small") == min(n for (s, _), n in uses.items() if s == "small") == 3  # capped
    assert max(n for (s, _), n in uses.items() if s == "big") <= 2
    for s in ("big", "small"):  # the blocks of a source are its documents' tokens, each once
        blocks = {r.block: r for r in rows if r.source == s}
        if len(blocks) == -(-size[s] // 16):
            assert sum(len(r.ids) for r in blocks.values()) == size[s]
        assert all(len(r.ids) <= 16 for r in blocks.values())
    assert sum(len(r.ids) for r in rows) == pytest.approx(size["big"] + size["small"], abs=40)
    again = M.mix(d, t, block=16, per_shard=20).collect()
    assert sorted((r.shard, r.slot, r.source, r.block) for r in again) == sorted((r.shard, r.slot, r.source, r.block) for r in rows)
    rep = {r.source: r for r in M.report(m, t).collect()}
    assert rep["none"].mix_tokens == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9 and rep["small"].most_repeats == 3


def test_reachable_shares_are_met(spark):
    d = spark.createDataFrame([(i, f"some text {i} " * 20, "ab"[i % 2]) for i in range(80)], "doc_id BIGINT, text STRING, source STRING")
    t = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    rep = {r.source: r.actual_share for r in M.report(M.mix(d, t, block=16), t).collect()}
    assert abs(rep["a"] - 0.75) < 0.01


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id BIGINT, text STRING, source STRING")
    t = spark.createDataFrame([("a", 1.0, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    assert M.mix(d, t).count() == 0 and M.report(M.mix(d, t), t).head().mix_tokens == 0
    assert M.mix(d, t.limit(0)).count() == 0


def test_draws_beyond_the_generators_range(monkeypatch):
    rng = np.random.default_rng(5)
    want = rng.hypergeometric(300, 500, 120, 20_000)
    monkeypatch.setattr(M, "RANGE", 0)
    got = np.array([M._hypergeometric(rng, 300, 500, 120) for _ in range(20_000)])
    a, b = (np.bincount(x, minlength=130)[20:70] / len(x) for x in (got, want))
    assert abs(got.mean() - 45) < 0.2 and np.abs(np.cumsum(a) - np.cumsum(b)).max() < 0.02
    big = M._hypergeometric(rng, 3 * 10**11, 7 * 10**11, 5 * 10**11)
    assert abs(big - 1.5 * 10**11) < 6 * (10**12 * 0.3 * 0.7 / 4) ** 0.5
    assert [M._hypergeometric(rng, *x) for x in ((10, 0, 4), (0, 10, 4), (10, 5, 15))] == [4, 0, 10]


def test_texts_are_encoded_once_and_tokens_cross_once(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 500)
    d = spark.createDataFrame([(i, f"some text {i} " * 20, "ab"[i % 3 == 0]) for i in range(90)], "doc_id BIGINT, text STRING, source STRING")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    calls = []
    monkeypatch.setattr(M, "cut", lambda df, f=M.cut: calls.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    blocks, totals = M.packed(d, M.clean_targets(t), 16)
    assert sum(p.count("ArrowEvalPython") for p in calls) == 1
    rows = blocks.collect()
    assert "ArrowEvalPython" not in (plan := blocks._jdf.queryExecution().executedPlan().toString())
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(source") == 1
    have = {r.source: r for r in totals.collect()}
    for s in "ab":
        mine = sorted(r.block for r in rows if r.source == s)
        assert mine == list(range(have[s].blocks)) and sum(len(r.ids) for r in rows if r.source == s) == have[s].tokens
    assert sorted({i for r in rows for i in r.doc_ids}) == list(range(90)) and have["a"].blocks > -(-have["a"].tokens // 16)
