"""Structures of the counts: recovery of shifts, ranking, described levels, diagnostics and the audit against known distributions."""

import math

import numpy as np
import pytest

from shotlens.operators import emissions as E

ROWS = "run_id string, shot_id int, frame_id int, site_id int, y double, part string, weight double, v double"


def table(spark, seed=0, frames=(0.0, 30.0), sites=tuple(np.linspace(-60, 60, 12)), shots=120, run="r"):
    g, rows = np.random.default_rng(seed), []
    for s in range(shots):
        part = ("train", "train", "train", "validation", "test")[s % 5]
        for f, df in enumerate(frames):
            for i, ds in enumerate(sites):
                rows.append((run, s, f, i, float(df + ds + 300 * (g.random() < 0.6) + 25 * g.standard_normal()), part, 9.0, 9.0))
    return spark.createDataFrame(rows, ROWS).repartition(4)


@pytest.fixture(scope="module")
def model(spark):
    rows = table(spark).cache()
    return rows, E.Structures(rows.where("part = 'train'"), "y", strengths=(5, 100))


def test_shifts_and_ranking(spark, model):
    rows, m = model
    f = {r.frame_id: r.frame_shift for r in m.frame_shifts.collect()}
    assert f[1] - f[0] == pytest.approx(30, abs=8)
    s = {(r.site_id, r.strength): r.site_shift for r in m.site_shifts.collect()}
    assert s[11, 5] == pytest.approx(60, abs=12) and s[0, 5] == pytest.approx(-60, abs=12) and abs(s[11, 100]) < abs(s[11, 5])
    n = 72 * 2
    assert s[11, 100] / s[11, 5] == pytest.approx((n / (n + 100)) / (n / (n + 5)), rel=1e-6)
    held = rows.where("part = 'validation'")
    r = {x.structure: x for x in E.ranking(E.densities(m.adjusted(held, "y")), ["run_id"]).collect()}
    assert set(r) == {"global", "frame", "offsets", "site", "shrunk_5", "shrunk_100"} and all(x.n == held.count() for x in r.values())
    assert [k for k, x in r.items() if x.selected] == ["shrunk_5"] and r["shrunk_5"].nll < r["offsets"].nll - 0.05 and not r["site"].eligible
    p = m.shrunk.where("strength = 5").first()
    assert (p.mean1 - p.mean0, p.sd0, p.weight) == pytest.approx((300, 26, 0.6), rel=0.12)


def test_unseen_sites_and_frames(spark, model):
    _, m = model
    new = spark.createDataFrame([("r", 1, 0, 99, 150.0, "test", 1.0, 1.0), ("r", 1, 7, 0, 150.0, "test", 1.0, 1.0), ("q", 1, 0, 0, 1.0, "test", 1.0, 1.0), ("r", 1, 0, 0, float("nan"), "test", 1.0, 1.0)], ROWS)
    got = m.adjusted(new, "y")
    by = {(r.structure, r.frame_id, r.site_id): r for r in got.collect()}
    shift = {r.frame_id: r.frame_shift for r in m.frame_shifts.collect()}[0]
    assert by["shrunk_5", 0, 99].v == pytest.approx(150 - shift) and by["global", 7, 0].v == 150  # an unseen site has shift 0
    assert not any(f == 7 for s, f, _ in by if s not in ("global", "site")) and by["site", 0, 99].mean1 == by["global", 0, 99].mean1
    assert not any(r.run_id == "q" for r in by.values())
    empty = new.where("false")
    assert E.densities(E.Structures(empty, "y").adjusted(empty, "y")).count() == 0


def test_scalars():
    assert E.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    levels = (0.3, 0.0, 6.0, 1.0, 1.5)
    for p in (0.005, 0.5, 0.9):
        assert E.mixture_cdf(E.mixture_quantile(p, *levels), *levels) == pytest.approx(p, abs=1e-9)
    x = E.crossing(*levels)
    f = lambda m, s, w: w * math.exp(-0.5 * ((x - m) / s) ** 2) / s
    assert 0 < x < 6 and f(0, 1, 0.7) == pytest.approx(f(6, 1.5, 0.3))
    assert E.crossing(0.999999, 0.0, 1.0, 1.0, 1.0) == 0.0
    assert E.overlap(0, 0, 1, 1) == pytest.approx(0.5, abs=1e-3) and E.overlap(0, 50, 1, 1) < 1e-9 and E.overlap(0, 2, 1, 1) == pytest.approx(E.normal_cdf(-1), abs=1e-3)


def test_residuals_and_weak_sites(spark):
    rows = [("r", 0, 0.02, 0.5)] * 90 + [("r", 0, 0.5, 1.0)] * 10 + [("r", 1, 0.999, 5.0)] * 3 + [("r", 1, 0.999, 1.0)] * 97
    d = {r.frame_id: r for r in E.residual_diagnostics(spark.createDataFrame(rows, "run_id string, frame_id int, posterior double, nearest double"), ["run_id"]).collect()}
    assert (d[0].ambiguous, d[0].far, d[1].far) == (0.1, 0.0, 0.03) and d[0].another_level and d[1].heavier_tails
    p = spark.createDataFrame([("a", 0.5, 0.0, 10.0, 1.0, 1.0), ("b", 0.5, 0.0, 1.0, 1.0, 1.0)], "k string, weight double, mean0 double, mean1 double, sd0 double, sd1 double")
    assert {r.k: r.weak for r in E.weak_sites(E.described(p)).collect()} == {"a": False, "b": True}


def test_audit(spark):
    g = np.random.default_rng(2)
    n = 20_000
    good = np.where(g.random(n) < 0.4, g.normal(10, 1.5, n), g.normal(0, 1, n))
    bad = np.where(g.random(n) < 0.4, g.normal(8, 1.5, n), g.normal(0, 2, n))
    rows = [(k, float(x), int(x > 5), 0.4, 0.0, 10.0, 1.0, 1.5) for k, v in (("good", good), ("bad", bad)) for x in v]
    a = {r.k: r for r in E.distribution_audit(spark.createDataFrame(rows, "k string, v double, occupied int, weight double, mean0 double, mean1 double, sd0 double, sd1 double"), ["k"]).collect()}
    assert a["good"].absolute_error < 0.06 and a["good"].divergence < 0.002 and a["good"].model_mass == pytest.approx(0.995, abs=0.004) and a["good"].tail_mass == pytest.approx(0.01, abs=0.003)
    assert abs(a["good"].mode) < 0.6 and abs(a["good"].model_mode) < 0.3 and a["good"].valley == pytest.approx(a["good"].model_valley, abs=0.005) and a["good"].sd0_ratio == pytest.approx(1, abs=0.03)
    assert a["bad"].absolute_error > 0.3 and a["bad"].divergence > 0.02 and a["bad"].sd0_ratio > 1.5


def test_bands(spark):
    rows = table(spark, 5, sites=(0.0, 0.0), frames=(0.0,))
    b = E.density_bands(rows, ["run_id"], "y", bins=12, replicates=100).orderBy("bin").collect()
    assert len(b) == 12 and all(r.lower <= r.density + 1e-9 and r.density <= r.upper + 1e-9 for r in b)
    again = E.density_bands(rows.repartition(2), ["run_id"], "y", bins=12, replicates=100, units_per_task=30).orderBy("bin").collect()
    assert [r.upper for r in again] == pytest.approx([r.upper for r in b], abs=2e-9)


def test_audit_where_the_densities_underflow(spark):
    """All rows lie so far from both levels that no density is above zero: the shares of the model still add up to one."""
    schema = "k string, v double, occupied int, weight double, mean0 double, mean1 double, sd0 double, sd1 double"
    rows = [("far", 1000.0 + i, 1, 0.4, 0.0, 10.0, 1.0, 1.5) for i in range(400)]
    near = [("near", float(i % 20), int(i % 20 > 5), 0.4, 0.0, 10.0, 1.0, 1.5) for i in range(400)]
    # bin 58 has no rows, and its share of the model is the least number above zero
    least = [("least", v, 0, 0.5, 0.5, 0.5, 58 / 38.595, 58 / 38.595) for v in [0.0] * 200 + [60.0] * 200]
    a = {r.k: r for r in E.distribution_audit(spark.createDataFrame(rows + near + least, schema), ["k"]).collect()}
    far = a["far"]
    assert set(a) == {"far", "near", "least"} and 0 < a["least"].divergence < math.log(2) and (far.n_rows, far.model_mass, far.tail_mass) == (400, 0, 1) and far.model_mode < 1010
    # nearly all of the model's share is in the first bin, which has a sixtieth of the rows
    p, q = np.full(60, 1 / 60), np.eye(60)[0]
    m = (p + q) / 2
    want = (sum(p * np.log(p / m)) + math.log(1 / m[0])) / 2
    assert far.divergence == pytest.approx(want, abs=0.005)


def test_bands_make_no_rows_of_replicates(spark):
    """Replicates stay in arrays, and large groups, in blocks of shots, have the same bands as those that fit in a task."""
    rows = table(spark, 5, sites=(0.0, 0.0), frames=(0.0,)).unionByName(table(spark, 6, sites=(0.0,), frames=(0.0,), shots=20, run="small")).cache()
    whole, blocks = (E.density_bands(rows, ["run_id"], "y", bins=12, replicates=50, units_per_task=n) for n in (20_000, 30))
    for df in (whole, blocks):
        assert "replicate" not in df._jdf.queryExecution().optimizedPlan().toString()
    a, b = ({(r.run_id, r.bin): (r.density, r.lower, r.upper) for r in df.collect()} for df in (whole, blocks))
    assert len(a) == 24 and a == b
