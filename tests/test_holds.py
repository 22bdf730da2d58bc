"""Chains with hold times: known rates and levels, both ways of fitting, the profile's limits, and the defined cases."""

import numpy as np
import pytest

from shotlens.operators import holds as H

TRAJ = "run_id string, y array<double>, t double"


def simulated(run, rate, q, n, seed, times=(0.1, 0.8, 1.6, 2.4), sd=1.0):
    g, rows = np.random.default_rng(seed), []
    for i in range(n):
        t = times[i % len(times)]
        on, y = g.random() < 0.7, []
        for f in range(len(q) + 1):
            on = on and (f == 0 or g.random() < q[f - 1] * np.exp(-rate * t))
            y.append(float(g.normal(6 if on else 0, sd)) if g.random() > 0.03 else None)
        rows.append((run, y, float(t)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = simulated("slow", 0.1, [0.95, 0.9], 3000, 1) + simulated("fast", 0.9, [0.97], 2000, 2) + simulated("single", 0.3, [0.9], 600, 3, times=(1.0,))
    df = spark.createDataFrame(rows + [("slow", [1.0, 2.0, 3.0], None), ("slow", [1.0, 2.0, 3.0], float("nan")), ("none", [1.0, 2.0], None)], TRAJ).repartition(4).cache()
    return df, {r.run_id: r for r in H.fit_holds(df).collect()}


def test_recovery_and_profile(fitted):
    _, got = fitted
    assert set(got) == {"slow", "fast", "single"}
    for run, rate, q in (("slow", 0.1, [0.95, 0.9]), ("fast", 0.9, [0.97])):
        r = got[run]
        assert r.converged and r.lower < rate < r.upper and r.lower < r.rate < r.upper and r.rate == pytest.approx(rate, rel=0.25)
        assert r.levels == pytest.approx(q, abs=0.04) and r.mean1 == pytest.approx([6] * (len(q) + 1), abs=0.2) and r.start == pytest.approx(0.7, abs=0.04)
    assert got["slow"].n == 3000 and got["single"].rate is None and got["single"].lower is None
    assert got["single"].levels == pytest.approx([0.9 * np.exp(-0.3)], abs=0.05)  # level and rate can't be told apart at one hold time


def test_rounds_over_chunks_give_the_same(spark):
    df = spark.createDataFrame(simulated("fast", 0.9, [0.97], 500, 2), TRAJ).repartition(2)
    few = {"rounds": 8, "tolerance": 1e-3, "points": 5}
    a, b = H.fit_holds(df, **few).first(), H.fit_holds(df, in_task=100, chunk=200, **few).first()
    assert (a.log_likelihood, a.start, a.rate, *a.levels) == pytest.approx((b.log_likelihood, b.start, b.rate, *b.levels), rel=1e-5) and (a.rounds, a.n_converged) == (b.rounds, b.n_converged)
    assert (a.lower, a.upper) == pytest.approx((b.lower, b.upper), rel=1e-3)


def test_limits():
    rates = np.geomspace(0.01, 1, 41)
    ll = -50 * (np.log(rates) - np.log(0.1)) ** 2
    lower, upper = H.limits(rates[::-1], ll[::-1])
    half = np.sqrt(H.CUTOFF_95 / 50)
    assert np.log(lower / 0.1) == pytest.approx(-half, abs=0.02) and np.log(upper / 0.1) == pytest.approx(half, abs=0.02)
    assert H.limits(rates, -rates)[0] is None and H.limits(rates, rates)[1] is None


def test_empty(spark):
    assert H.fit_holds(spark.createDataFrame([], TRAJ)).count() == 0
    assert H.fit_holds(spark.createDataFrame([("r", [1.0], 1.0), ("s", [None, None], 1.0)], TRAJ)).count() == 0
