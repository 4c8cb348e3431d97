import os

import pytest

from tessella.llm import mixing, tokens
from tessella.llm.mixing import sainte_lague

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.bpe_path()), reason="no vocabulary files")


def restated(weights, blocks):
    won = [0] * len(weights)
    for _ in range(blocks):
        q = [w / (2 * n + 1) for w, n in zip(weights, won, strict=True)]
        won[q.index(max(q))] += 1
    return won


def test_apportionment():
    for w, n in (([5, 3, 1], 9), ([0.53, 0.24, 0.23], 100), ([1, 1, 1], 4)):
        assert sainte_lague(w, [10**9] * len(w), n) == restated(w, n)
    assert sainte_lague([5, 3, 1], [2, 10**9, 10**9], 9) == [2, 5, 2]  # the capped party's blocks go on by quotient
    assert sainte_lague([1, 0], [3, 5], 9) == [3, 0]
    assert sainte_lague([], [], 3) == []


def frames(spark, n=300, hot=600):
    docs = [(i, "a", f"alpha beta {i} " * (1 + i % 5), 0) for i in range(n)] + [(1000 + i, "hot", "x y z " * 9, 0) for i in range(hot)]
    docs += [(5000, None, "null source", 0), (5001, "other", "no target", 0), (5002, "a", None, 0), (5003, "a", "", 0), (5004, "b", "few words here " * 40, 0)]
    targets = [("a", 0.5, 2), ("hot", 0.3, 1), ("b", 0.1, 3), ("missing", 0.1, 5), ("a", None, None), (None, 0.5, 1)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string, quota long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 100)
    docs, targets = frames(spark)
    chosen, report = mixing.mixed(docs, targets)
    got, rep = chosen.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} <= {"a", "hot", "b"}
    assert all(r.repeats <= rep[r.source].max_repeats for r in got)
    assert rep["missing"].used_tokens == 0 and rep["missing"].docs == 0
    for s, want in (("a", 0.5 / 0.9), ("hot", 0.3 / 0.9), ("b", 0.1 / 0.9)):
        assert abs(rep[s].actual_share - want) < 0.02
        assert rep[s].used_tokens == sum(r.n_tokens * r.repeats for r in got if r.source == s)
    block = max(1, sum(r.quota_tokens for r in rep.values()) // mixing.BLOCKS)
    for r in rep.values():  # less than a block, and half a document a shard
        longest = max((x.n_tokens for x in got if x.source == r.source), default=0)
        assert abs(r.used_tokens - r.quota_tokens) <= block + (r.docs // 100 + 1) * longest / 2
        assert abs(r.deviation - (r.actual_share - r.wanted_share)) < 1e-12
    assert abs(sum(r.wanted_share for r in rep.values()) - 1) < 1e-9
    assert sorted(map(tuple, mixing.mixed(docs, targets)[0].collect())) == sorted(map(tuple, got))  # seeded
    other = {r.doc_id for r in mixing.mixed(docs, targets, seed=5)[0].collect()}
    assert other != {r.doc_id for r in got}


def test_caps_bind_for_a_large_total(spark):
    docs, targets = frames(spark, 20, 20)
    chosen, report = mixing.mixed(docs, targets, total_tokens=10**7)
    rep = {r.source: r for r in report.collect()}
    for s in ("a", "hot", "b"):
        assert rep[s].used_tokens >= 0.9 * rep[s].max_repeats * rep[s].available_tokens
        assert rep[s].most_repeats <= rep[s].max_repeats


def test_empty(spark):
    docs, targets = frames(spark)
    assert mixing.mixed(docs.limit(0), targets)[0].count() == 0
    chosen, report = mixing.mixed(docs, targets.limit(0))
    assert chosen.count() == 0 and report.count() == 0
