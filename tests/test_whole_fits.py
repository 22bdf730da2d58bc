"""Fits and intervals do the whole job: chains settle from several starts."""

import numpy as np
import pytest

from shotlens.operators import chains, mixture, resample, survival


def slow_chain_rows(n=600, seed=7):
    """Levels that overlap, so that a fit needs many rounds."""
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = g.random() < 0.6
        for f in range(3 + i % 2):
            s = s and (f == 0 or g.random() < 0.8)
            rows.append(("r" if i % 3 else "q", i, f, 0, float(g.normal(2.2 if s else 0, 1)) if g.random() > 0.03 else None))
    return rows


def test_e_step_against_forward_backward():
    g = np.random.default_rng(1)
    y = g.normal(1, 2, (3, 50))
    y[1, :5] = np.nan
    length = np.where(np.arange(50) % 4 == 0, 2, 3)
    y[2, length == 2] = np.nan
    fits = np.array([[-np.inf, 0, 0, p, 0.8, 0.7, 0.5, 0.1, 0.2, 0.5, *[-0.5] * 3, *[2.0] * 3, *[1.0] * 3, *[1.5] * 3] for p in (0.3, 0.6)])
    got = chains.expected(y, length, fits)
    for row, start in zip(got, (0.3, 0.6)):
        ll = first = 0.0
        sums = np.zeros((3, 10))
        for k in (2, 3):
            x = y[:k, length == k].T
            m = len(x)
            p = {"start": np.full(m, start), "stay": np.tile([0.8, 0.7][: k - 1], (m, 1)), "gain": np.tile([0.1, 0.2][: k - 1], (m, 1)), "mean0": np.full((m, k), -0.5), "mean1": np.full((m, k), 2.0), "sd0": np.full((m, k), 1.0), "sd1": np.full((m, k), 1.5)}
            own, post, pairs = chains.forward_backward(x, p)
            seen, z = ~np.isnan(x), np.nan_to_num(x)
            ll, first = ll + own.sum(), first + post[:, 0].sum()
            for t in range(k):
                w, v = post[:, t] * seen[:, t], (1 - post[:, t]) * seen[:, t]
                sums[t, :6] += [w.sum(), (w * z[:, t]).sum(), (w * z[:, t] ** 2).sum(), v.sum(), (v * z[:, t]).sum(), (v * z[:, t] ** 2).sum()]
                if t < k - 1:
                    sums[t, 6:] += pairs[:, t].sum(0)[[1, 1, 0, 0], [1, 0, 1, 0]]
        assert row[0] == pytest.approx(ll) and row[1] == pytest.approx(first) and np.allclose(row[2:].reshape(3, 10), sums)


def test_chains_settle(spark):
    df = spark.createDataFrame(slow_chain_rows(), "run_id string, shot_id int, frame_id int, site_id int, v double").repartition(3)
    traj = chains.trajectories(df, "v").cache()
    whole = {r.run_id: r for r in chains.baum_welch(traj).collect()}
    cut_short = {r.run_id: r for r in chains.baum_welch(traj, 12).collect()}
    one = {r.run_id: r for r in chains.baum_welch(traj, starts=1).collect()}
    assert set(whole) == {"q", "r"}
    for k, r in whole.items():
        assert r.converged and r.rounds > 12 and 1 <= r.n_converged <= 8 and not cut_short[k].converged
        assert r.log_likelihood > cut_short[k].log_likelihood and r.log_likelihood >= one[k].log_likelihood - 1e-3
    # another round from there gains next to nothing
    again = chains.smoothed(traj, spark.createDataFrame(list(whole.values()), chains.FITS)).groupBy("run_id").sum("log_likelihood").collect()
    assert {r[0]: r[1] for r in again} == pytest.approx({k: r.log_likelihood for k, r in whole.items()})


def test_large_runs_get_the_same_fits(spark):
    df = spark.createDataFrame(slow_chain_rows(300), "run_id string, shot_id int, frame_id int, site_id int, v double").repartition(3)
    traj = chains.trajectories(df, "v").cache()
    a = {r.run_id: r for r in chains.baum_welch(traj, 3, 3, 1e-5).collect()}
    b = {r.run_id: r for r in chains.baum_welch(traj, 3, 3, 1e-5, in_task=150).collect()}  # r is too large for a task, q isn't
    assert set(a) == set(b) == {"q", "r"}
    for k, r in a.items():
        assert (r.converged, r.rounds, r.best_start, r.n) == (b[k].converged, b[k].rounds, b[k].best_start, b[k].n)
        assert r.log_likelihood == pytest.approx(b[k].log_likelihood) and r.mean1 == pytest.approx(b[k].mean1, abs=1e-5)


def test_many_rates_are_those_of_single_fits():
    g = np.random.default_rng(3)
    t, j = np.tile([0.0, 0.5, 1.0, 3.0], 2), np.repeat(["a", "b"], 4)
    n = g.integers(0, 30, (12, 8)).astype(float)
    s = np.floor(n * np.clip(0.9 * np.exp(-g.uniform(0, 1, (12, 1)) * t) + g.normal(0, 0.05, (12, 8)), 0, 1))
    n[0, [1, 2, 3, 5, 6, 7]] = s[0, [1, 2, 3, 5, 6, 7]] = 0  # one value of t is left
    s[1] = n[1]  # nothing is lost: rate 0
    got = survival.fit_rates(s, n, t, j)
    assert np.isnan(got[0]) and got[1] == 0
    for i in range(1, 12):
        ok = n[i] > 0
        assert got[i] == pytest.approx(survival.fit_rate(s[i][ok], n[i][ok], t[ok], j[ok])["rate"], abs=2e-5)


def test_dark_intervals_have_the_drawn_replicates(spark, folder):
    from shotlens.plans import registry

    g = np.random.default_rng(6)
    rows = [("r", 100 * k + i, f"c{k}", float(k), j, int(g.binomial(20, 0.9 * np.exp(-0.2 * k))), 20) for k in range(1, 5) for i in range(9) for j in ("0->1", "1->2")]
    df = spark.createDataFrame(rows, "run_id string, shot_id int, condition_id string, t double, j string, successes bigint, trials bigint")
    by = ["run_id", "condition_id"]
    old = survival.bootstrap_rates(df, resample.draws(df, by, "shot_id", 20), "t", "j").first()
    new = survival.resampled_rates(df, by, "shot_id", "t", "j", 20).first()
    assert (old.n_replicates, old.n_fitted, old.rate) == (new.n_replicates, new.n_fitted, new.rate) and (new.lower, new.upper) == pytest.approx((old.lower, old.upper), abs=2e-5)
    assert {r.n_replicates for r in registry.queries()["dark_rate_intervals"](spark, folder).collect()} == {1000}


def test_mixtures_with_spikes_are_those_of_all_rows(spark):
    g = np.random.default_rng(8)
    v = np.r_[g.normal(0, 1, 1400), g.normal(6, 1.5, 600), g.uniform(200, 5000, 30)]  # spikes above 0.5 %
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double").repartition(3)
    q = np.sort(v)[[int(np.ceil(p * len(v))) - 1 for p in (0.005, 0.25, 0.75, 0.995)]]
    lo, a, b, hi = (float(x) for x in q)
    starts = [(a, b), (lo, hi), (a, hi), (lo, b), ((lo + a) / 2, (b + hi) / 2)]
    want = mixture.expectation_maximisation(v, np.ones(len(v)), starts, 0.02 * v.std())
    for exact in (mixture.EXACT, 0):
        r = mixture.fit_mixtures(df, ["k"], "v", exact=exact).first()
        assert (r.weight, r.mean0, r.mean1, r.sd0, r.sd1) == pytest.approx(want[:5], rel=0.01) and r.n == len(v)
