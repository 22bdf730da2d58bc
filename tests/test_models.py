"""Models against known truth and brute force: rates, levels, mixtures, chains, draws, gates."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlens.operators import chains, mixture, resample, survival


def cells(rate, q, t, n, seed=0):
    g = np.random.default_rng(seed)
    rows = [(j, x, n, int(g.binomial(n, v * np.exp(-rate * x)))) for j, v in q.items() for x in t]
    return [np.array(c) for c in zip(*rows)]


def test_rate_recovery():
    j, t, n, s = cells(0.18, {"0->1": 0.80, "1->2": 0.87, "2->3": 0.90}, np.linspace(0.1, 6, 11), 20_000)
    fit = survival.fit_rate(s.astype(float), n.astype(float), t.astype(float), j)
    assert fit["rate"] == pytest.approx(0.18, abs=0.01) and fit["levels"]["2->3"] == pytest.approx(0.90, abs=0.02) and not fit["at_edge"]


def test_rate_is_the_best_point():
    j, t, n, s = cells(0.4, {"a": 0.9}, np.linspace(0.1, 2, 6), 300, 3)
    s, n, t = s.astype(float), n.astype(float), t.astype(float)
    fit = survival.fit_rate(s, n, t, j)
    rates, qs = np.meshgrid(np.linspace(0, 2, 401), np.linspace(0.5, 1, 251))
    p = qs[..., None] * np.exp(-rates[..., None] * t)
    assert -fit["nll"] >= survival.log_likelihood(s, n, p).max() - 1e-6


def test_flat_and_degenerate(spark):
    fit = survival.fit_rate([90.0, 91.0, 92.0], [100.0] * 3, [0.0, 1.0, 2.0], ["a"] * 3)
    assert fit["rate"] == 0 and fit["at_edge"]
    df = spark.createDataFrame([("r", 1, 1.0, "a", 5, 9), ("r", 2, 1.0, "a", 6, 9), ("q", 1, None, "a", 1, 2), ("p", 1, 1.0, "a", 9, 10), ("p", 1, 2.0, "a", 5, 10)], "run_id string, shot_id int, t double, j string, successes bigint, trials bigint")
    got = {r.run_id: r for r in survival.fit_groups(df, ["run_id"], "t", "j").collect()}
    assert set(got) == {"r", "p"} and got["r"].rate is None and got["p"].rate > 0 and got["p"].n_trials == 20
    held = survival.held_out_nll(df, survival.fit_groups(df, ["run_id"], "t", "j").where("rate is not null"), ["run_id"], "t", "j").collect()
    assert [r.run_id for r in held] == ["p"] and held[0].n_unseen == 0


def test_known_survival(spark):
    """Five exposures of 50 ms and four gaps of 10 ms at the published rates."""
    runs = spark.createDataFrame([("r", 5, 50.0), ("none", 0, 50.0)], "run_id string, n_frames int, exposure_ms double")
    b = survival.loss_budget(runs, 0.049250, 0.027984).collect()
    assert len(b) == 9 and 1 - sum(r.part for r in b) == pytest.approx(0.986658, abs=1e-6)


def test_mixture_recovery(spark):
    g = np.random.default_rng(2)
    rows = [("a", float(v)) for v in np.r_[g.normal(0, 1, 700), g.normal(6, 1.5, 300)]] + [("b", float(v)) for v in g.normal(5, 1, 400)] + [("c", 1.0)] * 50 + [("d", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    fit = {r.k: r for r in mixture.fit_mixtures(df, ["k"], "v").collect()}
    a = fit["a"]
    assert set(fit) == {"a", "b"} and (a.weight, a.mean0, a.mean1, a.sd0, a.sd1) == pytest.approx((0.3, 0, 6, 1, 1.5), abs=0.15)
    scored = mixture.score(df, mixture.fit_mixtures(df, ["k"], "v"), ["k"], "v").where("k = 'a'").toPandas()
    x = scored.v.to_numpy()
    dens = (1 - a.weight) * np.exp(-0.5 * ((x - a.mean0) / a.sd0) ** 2) / a.sd0 + a.weight * np.exp(-0.5 * ((x - a.mean1) / a.sd1) ** 2) / a.sd1
    assert np.allclose(scored.log_density, np.log(dens / mixture.ROOT_2PI)) and (scored.occupied == (scored.posterior >= 0.5)).all()


def brute(y, p):
    """Likelihood and occupancy of one trajectory by summing over all paths."""
    k, total, occ = len(y), 0.0, np.zeros(len(y))
    for path in itertools.product((0, 1), repeat=k):
        w = p["start"] if path[0] else 1 - p["start"]
        for t in range(k - 1):
            stay, gain = p["stay"][t], p["gain"][t]
            w *= (stay if path[t + 1] else 1 - stay) if path[t] else (gain if path[t + 1] else 1 - gain)
        for t in range(k):
            if not np.isnan(y[t]):
                m, s = (p["mean1"][t], p["sd1"][t]) if path[t] else (p["mean0"][t], p["sd0"][t])
                w *= np.exp(-0.5 * ((y[t] - m) / s) ** 2) / s / mixture.ROOT_2PI
        total += w
        occ += w * np.array(path)
    return np.log(total), occ / total


def test_chain_against_all_paths():
    g = np.random.default_rng(0)
    for k in (1, 2, 5):
        p = {"start": 0.6, "stay": g.uniform(0.7, 0.99, k - 1), "gain": g.uniform(0.01, 0.3, k - 1), "mean0": g.normal(0, 0.2, k), "mean1": g.normal(4, 0.2, k), "sd0": g.uniform(0.5, 1, k), "sd1": g.uniform(0.5, 1, k)}
        y = g.normal(2, 2, (20, k))
        y[3, 0] = np.nan
        ll, post, pairs = chains.forward_backward(y, {c: (np.full(20, v) if c == "start" else np.tile(v, (20, 1))) for c, v in p.items()})
        want = [brute(r, p) for r in y]
        assert np.allclose(ll, [w[0] for w in want]) and np.allclose(post, [w[1] for w in want])
        assert np.allclose(pairs.sum((2, 3)), 1) and np.allclose(pairs[:, :, 1].sum(2), post[:, :-1])


def test_chain_recovery(spark):
    g = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        s = g.random() < 0.7
        for f in range(4):
            s = s and (f == 0 or g.random() < 0.9)
            rows.append(("r", i, f, 0, float(g.normal(5 if s else 0, 0.8)) if g.random() > 0.02 else None))
    df = spark.createDataFrame(rows, "run_id string, shot_id int, frame_id int, site_id int, v double").repartition(5)
    traj = chains.trajectories(df, "v")
    p = chains.baum_welch(traj, 10).first()
    assert p.start == pytest.approx(0.7, abs=0.04) and np.mean(p.stay[:3]) == pytest.approx(0.9, abs=0.02) and max(p.gain[:3]) < 0.02 and p.n == traj.count()
    assert p.mean1 == pytest.approx([5] * 4, abs=0.15) and p.sd0 == pytest.approx([0.8] * 4, abs=0.15)
    lls = [chains.baum_welch(traj, n).first().log_likelihood for n in (1, 2, 4)]
    assert lls == sorted(lls)
    assert chains.smoothed(traj, chains.baum_welch(traj, 2)).count() == traj.count()


def test_draws(spark):
    units = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(4)], "c string, shot_id int")
    d = resample.draws(units, ["c"], "shot_id", 50).cache()
    per = {(r.replicate, r.c): r.n for r in d.groupBy("replicate", "c").agg(F.sum("times").alias("n")).collect()}
    assert len(per) == 100 and all(n == (30 if c == "a" else 4) for (_, c), n in per.items())  # as many as there are, every time
    again = resample.draws(units.repartition(3), ["c"], "shot_id", 50)
    assert d.exceptAll(again).count() == 0
    mean = d.where("c = 'a'").agg((F.sum(F.col("times") * F.col("shot_id")) / F.sum("times")).alias("m")).first().m
    assert mean == pytest.approx(14.5, abs=0.8)
    stats = units.withColumn("v", F.col("shot_id").cast("double"))
    by_rows = stats.join(d, ["c", "shot_id"]).groupBy("replicate", "c").agg((F.sum(F.col("times") * F.col("v")) / F.sum("times")).alias("m"))
    by_array = {(r.replicate, r.c): r.m for r in resample.replicate_means(stats.repartition(3), ["c"], "shot_id", ["c"], "v", 50).collect()}
    assert by_array == pytest.approx({(r.replicate, r.c): r.m for r in by_rows.collect()})
    b = {r.c: r for r in resample.bootstrap_mean(stats, ["c"], "shot_id", ["c"], "v", 200).collect()}
    assert b["a"].lower < 14.5 < b["a"].upper and b["a"].upper - b["a"].lower == pytest.approx(4 * 8.66 / 30**0.5, rel=0.25)


def test_gate(spark):
    g = np.random.default_rng(1)
    rows = [("better", float(a), float(a - 0.2 + 0.05 * g.standard_normal())) for a in g.random(60)] + [("same", float(a), float(a + 0.05 * g.standard_normal())) for a in g.random(60)] + [("one", 1.0, 0.5)]
    got = {r.run_id: r.passes for r in survival.paired_gate(spark.createDataFrame(rows, "run_id string, s double, r double"), ["run_id"], "s", "r").collect()}
    assert got == {"better": 1, "same": 0, "one": 0}


def test_surfaces(spark):
    from shotlens.operators.surfaces import design, frame_surfaces, robust_surfaces

    g = np.random.default_rng(4)
    x, y = g.uniform(0, 700, 30), g.uniform(0, 600, 30)
    b = design(x, y, 2)
    z = np.stack([b @ g.normal(0, 5, 6) + 100 for _ in range(7)])
    assert np.allclose(robust_surfaces(z, b), z, atol=1e-4)
    bad = z + g.normal(0, 0.1, z.shape)
    bad[:, 3] += 500  # one wild site moves a plain fit but not a robust one
    bad[2, 5] = np.nan
    plain = b @ np.linalg.lstsq(b, bad[0], rcond=None)[0]
    assert np.abs(robust_surfaces(bad, b)[0] - z[0]).max() < 5 < np.abs(plain - z[0]).max()
    sites = spark.createDataFrame([("r", i, float(x[i]), float(y[i])) for i in range(30)], "run_id string, site_id int, site_x double, site_y double")
    rows = [("r", t, 0, i, float(2 + 0.01 * x[i] - 0.02 * y[i] + t)) for t in range(5) for i in range(30)] + [("r", 9, 0, 0, 1.0), ("r", 9, 0, 1, None)]
    got = {r.shot_id: r for r in frame_surfaces(spark.createDataFrame(rows, "run_id string, shot_id int, frame_id int, site_id int, v double"), sites, "v", shots_per_task=2).collect()}
    assert len(got) == 6 and got[3].residual < 0.01 and got[3].level - got[0].level == pytest.approx(3, abs=1e-3) and got[9].level is None and got[9].n_sites == 1


def test_rate_intervals(spark):
    g = np.random.default_rng(6)
    rows = [("r", 1000 * k + i, f"c{k}", float(k), int(g.binomial(20, 0.9 * np.exp(-0.2 * k)))) for k in range(1, 7) for i in range(25)]
    df = spark.createDataFrame([(*r[:4], "0->1", r[4], 20) for r in rows], "run_id string, shot_id int, condition_id string, t double, j string, successes bigint, trials bigint")
    d = resample.draws(df, ["run_id", "condition_id"], "shot_id", 60)
    b = survival.bootstrap_rates(df, d, "t", "j").first()
    assert b.lower < 0.2 < b.upper and b.lower < b.rate < b.upper and (b.n_replicates, b.n_fitted) == (60, 60) and b.upper - b.lower < 0.06
