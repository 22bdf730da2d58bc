"""Mixtures: shares, repeats, the flight's invariants, sources that can't reach their share, and the defined cases."""

import numpy as np
import pandas as pd
import pytest

from shotlens.llm.mixing import Mixture, flight, land, plan_shares

DOCS = "doc_id bigint, text string, source string, unit string, key string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, extra string"


def corpus(spark, sizes, seed=0):
    g = np.random.default_rng(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "word " * int(g.integers(1, 60)), s, "u", "k", "t"))
            i += 1
    return spark.createDataFrame(rows, DOCS).repartition(6)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "e") for r in rows], TARGETS)


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_totals(seed):
    g = np.random.default_rng(seed)
    n = 500
    tokens, p = g.integers(1, 50, n).tolist(), float(g.uniform(0.05, 0.95))
    done, left = flight(list(range(n)), tokens, [p] * n, g.random(n).tolist())
    assert len(done) + len(left) == n and len(left) <= 3 and all(x in (0, 1) for _, x in done)
    moved = sum(tokens[i] * x for i, x in [*done, *left]), sum(x for _, x in [*done, *left])
    assert moved[0] == pytest.approx(p * sum(tokens), rel=1e-6) and moved[1] == pytest.approx(p * n, rel=1e-6)


def test_flight_is_fair():
    """Every document keeps its probability on average."""
    g, n, hits = np.random.default_rng(1), 12, np.zeros(12)
    tokens = [1, 2, 3, 5, 8, 8, 8, 9, 4, 4, 7, 30]
    for _ in range(4000):
        done, left = flight(list(range(n)), tokens, [0.3] * n, g.random(n).tolist())
        for i, x in [*done, *left]:
            hits[i] += x
    assert np.abs(hits / 4000 - 0.3).max() < 0.04


def test_land():
    assert land([10, 3], [0.5, 0.5]) in ([1, 0], [0, 1]) and land([], []) == []


def test_shares_and_repeats(spark):
    docs = corpus(spark, {"a": 900, "b": 300, "c": 60, "hot": 1500, "none": 40})
    m = Mixture(docs, targets(spark, [("a", 0.3, 1), ("b", 0.2, 1), ("c", 0.1, 4), ("hot", 0.4, 1), ("ghost", 0.0, 2)]))
    got = {r.source: r for r in m.shares().collect()}
    whole = sum(r.reached_tokens for r in got.values())
    for s, share in {"a": 0.3, "b": 0.2, "c": 0.1, "hot": 0.4}.items():
        assert got[s].can_be_met and abs(got[s].reached_tokens / whole - share) < 0.004
    used = m.used.toPandas()
    assert used.doc_id.is_unique and set(used.source) == {"a", "b", "c", "hot"} and used.repeats.min() >= 1
    cap = {"a": 1, "b": 1, "c": 4, "hot": 1}
    assert all(used[used.source == s].repeats.max() <= c for s, c in cap.items())
    again = Mixture(docs, targets(spark, [("a", 0.3, 1), ("b", 0.2, 1), ("c", 0.1, 4), ("hot", 0.4, 1)])).used.toPandas()
    assert abs(len(again) - len(used)) <= 8


def test_the_seed_fixes_the_sample(spark):
    docs, want = corpus(spark, {"a": 900, "b": 300}), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])
    draw = lambda df, **k: {(r.doc_id, r.repeats) for r in Mixture(df, want, group_docs=100, **k).used.collect()}
    one = draw(docs)
    assert one == draw(docs.repartition(7)) == draw(docs.repartition(2, "text").sortWithinPartitions("text"))
    other = draw(docs, seed=8)
    assert other != one and abs(len(other) - len(one)) <= 8


def test_targets_that_cannot_be_met(spark):
    docs = corpus(spark, {"a": 900, "tiny": 1})
    m = Mixture(docs, targets(spark, [("a", 0.5, 1), ("tiny", 0.4, 3), ("ghost", 0.1, 3)]))
    got = {r.source: r for r in m.shares().collect()}
    assert not got["tiny"].can_be_met and got["tiny"].most_repeats == 3  # all it may give
    assert got["tiny"].passed_over and got["a"].binds_total and not got["a"].passed_over
    assert not got["ghost"].can_be_met and got["ghost"].reached_tokens == 0 and got["a"].can_be_met
    p = plan_shares(pd.DataFrame({"source": ["a"], "share": [1.0], "cap": [2.0], "n_docs": [3.0], "n_tokens": [100.0]}), 150.0, 0.1)
    assert (p.whole[0], round(p.extra[0], 6)) == (1, 0.5)


def test_missing_values_and_empty(spark):
    rows = [(1, None, "a", "u", "k", "t"), (2, "", "a", "u", "k", "t"), (3, "one two", "a", "u", "k", "t"), (3, "one two", "a", "u", "k", "t"), (4, "x", None, "u", "k", "t"), (None, "y z", "a", "u", "k", "t"), (5, "q", "b", "u", "k", "t")]
    docs = spark.createDataFrame(rows, DOCS)
    m = Mixture(docs, targets(spark, [("a", 1.0, 2), ("a", 0.5, 1), (None, 0.3, 1), ("b", None, None)]))
    assert sorted((r.doc_id or 0, r.repeats) for r in m.used.collect()) == [(0, 2), (3, 2), (3, 2)]
    empty = Mixture(docs.where("false"), targets(spark, [("a", 1.0, 2)]))
    assert empty.used.count() == 0 and [r.reached_tokens for r in empty.shares().collect()] == [0] and not empty.shares().first().can_be_met
    assert Mixture(docs, targets(spark, [])).used.count() == 0
