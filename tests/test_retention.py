"""Retention models: the solver against brute force and known truth, candidates and gates, resampling, closed forms, guards."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotlens.operators import retention as R
from shotlens.operators.survival import log_likelihood

CELLS = "dataset_id string, run_id string, shot_id int, split string, cycle_index int, interval string, t double, exposure_s double, pulses int, known double, successes int, trials int"


def draw(g, p, n=20):
    return int(g.binomial(n, p)), n


def dark_cells(rates, q, seed=0, shots=40, run="r"):
    g, rows, shot = np.random.default_rng(seed), [], 0
    for k, t in enumerate(np.linspace(0.2, 6, 8)):
        for i in range(shots):
            split = ("train", "train", "train", "validation", "test")[i % 5]
            rows += [("d", run, shot, split, i, j, float(t), 0.0, 1, 0.0, *draw(g, q[j] * np.exp(-rates[j] * t))) for j in q]
            shot += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, CELLS).repartition(5)


def test_solver_against_a_grid():
    g = np.random.default_rng(1)
    t = np.tile(np.linspace(0.1, 4, 6), 2)
    x = np.c_[np.r_[np.ones(6), np.zeros(6)], np.r_[np.zeros(6), np.ones(6)], t]
    n = np.full(12, 60.0)
    for truth in ([-0.1, -0.3, -0.4], [0.0, -0.2, 0.0], [-0.02, -0.01, -2.5]):
        s = g.binomial(60, np.exp(x @ np.array(truth))).astype(float)
        b, nll = R.fit_log_linear(s[None], n[None], x)
        assert (b <= 0).all()
        for _ in range(3000):
            c = np.minimum(0, b[0] + g.normal(0, 10 ** g.uniform(-4, 0), 3))
            assert nll[0] <= -log_likelihood(s, n, np.exp(x @ c)) + 1e-6
    # replicates are fitted apart from each other
    many = g.binomial(60, 0.7, (30, 12)).astype(float)
    b, nll = R.fit_log_linear(many, np.tile(n, (30, 1)), x)
    one = [R.fit_log_linear(m[None], n[None], x) for m in many]
    assert np.allclose(nll, [o[1][0] for o in one], atol=1e-6) and np.allclose(np.exp(b), [np.exp(o[0][0]) for o in one], atol=1e-3)


def test_floor():
    t, n = np.linspace(0.05, 3, 12), np.full(12, 5000.0)
    s = n * 0.8 * (0.25 + 0.75 * np.exp(-1.4 * t))
    level, share, rate, _ = R.fit_floor(s, n, t)
    assert (level, share, rate) == pytest.approx((0.8, 0.25, 1.4), rel=0.01)


def selected(df):
    return {r.run_id if "run_id" in r else r.dataset_id: r.candidate for r in df.where("selected").collect()}


def test_dark_candidates_and_gate(spark):
    q = {"0->1": 0.9, "1->2": 0.93, "10->11": 0.95}
    same = dark_cells(dict.fromkeys(q, 0.15), q, 1, run="same")
    first = dark_cells({"0->1": 0.5, "1->2": 0.05, "10->11": 0.05}, q, 2, run="first")
    one = [(*r[:5], "0->1", *r[6:]) for r in dark_cells({"0->1": 0.2}, {"0->1": 0.9}, 3, run="one")]
    cells = frame(spark, same + first + one + [("d", "empty", 1, "train", 1, "0->1", None, 0.0, 1, 0.0, 1, 2)])
    fits = R.fit_candidates(cells, ["run_id"], "dark").cache()
    by = {(r.run_id, r.candidate): r for r in fits.collect()}
    assert by["same", "shared"].parameters["rate"] == pytest.approx(0.15, abs=0.02) and by["one", "by_interval"].parameters is None
    assert by["first", "first_separate"].parameters["rate__first"] == pytest.approx(0.5, abs=0.06)
    assert by["first", "by_interval"].train_nll <= by["first", "first_separate"].train_nll <= by["first", "shared"].train_nll
    table = R.compare(cells, fits, ["run_id"], "dark", tolerance=1e-3).cache()
    assert selected(table) == {"same": "shared", "first": "first_separate", "one": "shared"}
    assert {r.n_validation for r in table.where("run_id = 'same'").collect()} == {sum(r[11] for r in same if r[3] == "validation")}


def test_bright_and_control(spark):
    g, rows = np.random.default_rng(4), []
    for run, f in (("floor", 0.4), ("plain", 0.0)):
        for k, t in enumerate(np.linspace(0.05, 3, 10)):
            rows += [("d", run, 100 * k + i, ("train", "train", "validation")[i % 3], i, "first", float(t), 0.0, 1, 0.0, *draw(g, 0.85 * (f + (1 - f) * np.exp(-1.2 * t)), 30)) for i in range(30)]
    assert selected(R.compare(frame(spark, rows), R.fit_candidates(frame(spark, rows), ["run_id"], "bright"), ["run_id"], "bright")) == {"floor": "floor", "plain": "no_floor"}
    flat = [("d", "flat" if k < 2 else "falls", 100 * j + i, ("train", "validation")[i % 2], i, "0->1", float(t), 0.0, 1, 0.0, *draw(g, 0.9 if k < 2 else 0.95 * np.exp(-0.3 * t), 30)) for k in (1, 2) for j, t in enumerate(np.linspace(0.1, 3, 6)) for i in range(30)]
    cells = frame(spark, flat)
    fits = R.fit_candidates(cells, ["run_id"], "control").cache()
    train = [r for r in flat if r[1] == "flat" and r[3] == "train"]
    level = [r.parameters["level__0->1"] for r in fits.where("run_id = 'flat' and candidate = 'flat'").collect()]
    assert level == pytest.approx([sum(r[10] for r in train) / sum(r[11] for r in train)], abs=1e-6)
    assert selected(R.compare(cells, fits, ["run_id"], "control")) == {"flat": "flat", "falls": "monotone"}


def repeated(seed, factors, shots=90):
    g, rows = np.random.default_rng(seed), []
    for run, (e, q, level) in factors.items():
        for i in range(shots):
            for k in range(1, 6):
                known = -(0.05 * e * k + 0.03 * 0.01 * (k - 1))
                rows.append(("d", run, i, ("train", "train", "validation")[i % 3], i, "all", 0.0, e, k, known, *draw(g, level * np.exp(known) * q ** (k - 1), 40)))
    return rows


def test_repeated_imaging(spark):
    plain = frame(spark, repeated(1, {"a": (0.05, 1.0, 0.6), "b": (0.1, 1.0, 0.5)}))
    common = frame(spark, repeated(2, {"a": (0.05, 0.97, 0.6), "b": (0.1, 0.97, 0.5)}))
    apart = frame(spark, repeated(3, {"a": (0.05, 0.99, 0.6), "b": (0.1, 0.93, 0.5)}))
    for cells, want in ((plain, "known_losses"), (common, "common_factor"), (apart, "factor_by_exposure")):
        fits = R.fit_candidates(cells, ["dataset_id"], "repeated").cache()
        assert selected(R.compare(cells, fits, ["dataset_id"], "repeated")) == {"d": want}
    by = {r.candidate: r for r in fits.collect()}
    p = by["factor_by_exposure"].parameters
    assert (p["factor__50ms"], p["factor__100ms"], p["level__a"]) == pytest.approx((0.99, 0.93, 0.6), abs=0.02)
    assert by["factor_by_boundary"].n_parameters == 6 and by["common_factor"].train_nll <= by["known_losses"].train_nll


def test_guards(spark):
    rows = frame(spark, dark_cells({"0->1": 0.2}, {"0->1": 0.9}, 3, 5))
    with pytest.raises(ValueError, match="training rows only"):
        R.training_only(rows)
    assert R.training_only(rows.where("split = 'train'")).count() == 24
    with pytest.raises(ValueError, match="held-out shots"):
        R.disjoint_shots(rows, rows.where("shot_id = 3"))
    assert R.disjoint_shots(rows.where("split = 'train'"), rows.where("split = 'test'")).count() == 8
    empty = rows.where("false")
    assert R.compare(empty, R.fit_candidates(empty, ["run_id"], "dark"), ["run_id"], "dark").count() == 0
    assert R.resampled_parameters(empty, ["run_id"], "shared", ["run_id", "shot_id"], 10).count() == 0


def test_resampling(spark):
    q = {"0->1": 0.9, "1->2": 0.93}
    cells = frame(spark, dark_cells(dict.fromkeys(q, 0.15), q, 5))
    draws = R.resampled_parameters(cells, ["run_id"], "shared", ["run_id", "shot_id"], 200).cache()
    again = R.resampled_parameters(cells.repartition(3), ["run_id"], "shared", ["run_id", "shot_id"], 200, units_per_task=50)
    a, b = ({r.replicate: r.parameters["rate"] for r in x.collect()} for x in (draws, again))
    assert len(a) == 200 and all(a[k] == pytest.approx(b[k], abs=1e-4) for k in a)  # whatever the layout and the blocks
    fits = R.fit_candidates(cells, ["run_id"], "dark")
    i = {r.parameter: r for r in R.parameter_intervals(draws, fits, ["run_id"], "shared").collect()}
    assert i["rate"].lower < 0.15 < i["rate"].upper and i["rate"].upper - i["rate"].lower < 0.05 and set(i) == {"rate", "level__0->1", "level__1->2"} and i["rate"].n_failed == 0
    n = sum(r.trials for r in cells.where("split = 'train'").collect())
    assert i["rate"].upper - i["rate"].lower > 0.2 * n**-0.5
    r = {(x.a, x.b): x.r for x in R.parameter_correlations(draws, ["run_id"]).collect()}
    assert len(r) == 3 and r["level__0->1", "rate"] > 0.3
    band = R.bands(draws, ["run_id"], "level__0->1", "rate", [0.0, 2.0]).orderBy("t").collect()
    assert band[1].lower < 0.9 * np.exp(-0.3) < band[1].upper and band[0].median == pytest.approx(0.9, abs=0.02)
    few = cells.where("t < 0.3")  # one time: nothing can be fitted
    failed = R.resampled_parameters(few, ["run_id"], "shared", ["run_id", "shot_id"], 20)
    assert failed.where("parameters is null").count() == 20


def test_published_contrasts_and_budget(spark):
    """Closed forms at the published rates: survival of five frames and the contrasts at equal light."""
    designs = spark.createDataFrame([("d", e, 5) for e in (0.05, 0.1, 0.2)], "dataset_id string, exposure_s double, n_frames int")
    got = {(round(r.total_s, 2), r.exposure_s): r for r in R.matched_contrasts(designs, ["dataset_id"], 0.049250, 0.027984).collect()}
    want = {(0.1, 0.05): -0.000278, (0.2, 0.05): -0.000831, (0.2, 0.1): -0.000277, (0.4, 0.1): -0.000548}
    assert {k: round(got[k].difference, 6) for k in want} == want
    rates = spark.createDataFrame([("d", e, [0.049250], [0.027984], [1.0]) for e in (0.05, 0.1, 0.2)], "dataset_id string, exposure_s double, bright array<double>, dark array<double>, factor array<double>")
    parts = {(r.exposure_s, r.part): r.median for r in R.budget_intervals(rates, ["dataset_id"], combinations=20).collect()}
    assert [round(parts[e, "survival"], 6) for e in (0.05, 0.1, 0.2)] == [0.986658, 0.974584, 0.950878]
    for e in (0.05, 0.1, 0.2):
        assert sum(parts[e, k] for k in ("light", "gaps", "readout", "survival")) == pytest.approx(1, abs=1e-8)
    wide = spark.createDataFrame([("d", 0.05, [0.04, 0.06], [0.02, 0.03], [0.99, 1.0])], rates.schema)
    r = {x.part: x for x in R.budget_intervals(wide, ["dataset_id"]).collect()}
    assert r["light"].lower < r["light"].upper and r["readout"].lower == pytest.approx(0, abs=1e-9) and r["readout"].upper > 0.03


def test_ratio(spark):
    side = lambda v: spark.createDataFrame([("d", i, v + 0.001 * (i % 5)) for i in range(100)], "dataset_id string, replicate int, rate double")
    r = R.rate_ratios(side(0.06), side(0.03).where("replicate < 90"), ["dataset_id"]).first()
    assert r.n_replicates == 90 and r.ratio_lower <= 2 <= r.ratio_upper + 0.02 and r.loss_median == pytest.approx(1 - np.exp(-0.05 * 0.062), abs=1e-4)


def test_design_names_are_in_order():
    d = pd.DataFrame({"interval": ["10->11", "2->3"] * 3, "t": [1.0, 1.0, 2.0, 2.0, 3.0, 3.0], "run_id": "r", "exposure_s": 0.0, "pulses": 1, "known": 0.0})
    names, x, low = R.design("first_separate", d, np.ones(6, bool))
    assert names == ["level__2->3", "level__10->11", "rate__first", "rate__later"] and x[1].tolist() == [1, 0, 1, 0] and len(low) == 4
    assert F is not None


def hard_counts(g, replicates=400):
    """Weighted counts whose best levels and rate lie at or near their bounds."""
    of, t = np.repeat(np.arange(4), 11), np.tile(np.linspace(0.05, 2.5, 11), 4)
    n = g.poisson(1.0, (replicates, 4, 44)).sum(1) * g.integers(1, 8, 44).astype(float)
    s = g.binomial(n.astype(int), np.array([0.99, 0.97, 1.0, 0.95])[of]).astype(float)
    return s, n, np.c_[np.eye(4)[of], t], np.r_[np.full(4, np.log(1e-9)), -R.HIGHEST_RATE]


def test_solver_reaches_the_top_from_any_start():
    """no replicate stops where a bound turns its step away."""
    s, n, x, low = hard_counts(np.random.default_rng(0))
    nll = [R.fit_log_linear(s, n, x, 0.0, low, start=np.array(b))[1] for b in ([-0.05] * 5, [-1.0] * 5, [-0.01, -2.0, -0.01, -2.0, -0.5])]
    nll.append(R.fit_log_linear(s, n, x, 0.0, low)[1])
    assert np.ptp(nll, axis=0).max() < 1e-6


def test_intervals_and_bands_without_rows_of_replicates(spark):
    """replicates stay in arrays, and give what the rows of replicates gave; a run in several blocks too."""
    q = {"0->1": 0.9, "1->2": 0.93}
    cells = frame(spark, dark_cells(dict.fromkeys(q, 0.15), q, 5) + dark_cells(dict.fromkeys(q, 0.3), q, 6, 10, "small")).cache()
    by, unit = ["run_id"], ["run_id", "shot_id"]
    draws = R.resampled_parameters(cells, by, "shared", unit, 100).cache()
    fits = R.fit_candidates(cells, by, "dark", "shared").cache()
    assert fits.count() == 2
    want = sorted(tuple(r) for r in R.parameter_intervals(draws, fits, by, "shared").collect())
    band = sorted(tuple(r) for r in R.bands(draws, by, "level__0->1", "rate", [0.0, 0.5, 2.0]).collect())
    rate = {(r.run_id, r.replicate): r.parameters["rate"] for r in draws.collect()}
    for how in ({}, {"units_per_task": 50}):
        got = R.resampled_intervals(cells, fits, by, "shared", unit, replicates=100, **how)
        assert "replicate" not in got._jdf.queryExecution().optimizedPlan().toString().replace("n_replicates", "")
        assert [r[:2] for r in want] == [r[:2] for r in sorted(got.collect())] and np.allclose([r[2:] for r in want], [r[2:] for r in sorted(got.collect())], atol=2e-6)
        got = sorted(tuple(r) for r in R.resampled_bands(cells, by, "shared", unit, "level__0->1", "rate", [0.0, 0.5, 2.0], replicates=100, **how).collect())
        assert [r[:2] for r in band] == [r[:2] for r in got] and np.allclose([r[2:] for r in band], [r[2:] for r in got], atol=2e-6)
        values = {r.run_id: r.v for r in R.resampled_values(cells, by, "shared", unit, "rate", replicates=100, **how).collect()}
        assert all(values[k][i] == pytest.approx(v, abs=1e-6) for (k, i), v in rate.items())


def test_groups_that_no_replicate_can_be_fitted_in(spark):
    """F1 of round 3, model_intervals: a run with one time, or with no shot that has a number, gives no rows instead of an error."""
    q = {"0->1": 0.9, "1->2": 0.93}
    good = dark_cells(dict.fromkeys(q, 0.15), q, 5, 10)
    once = [r for r in dark_cells(dict.fromkeys(q, 0.15), q, 6, 10, "once") if r[6] < 0.3]
    nameless = [(*r[:4], None, *r[5:]) for r in dark_cells(dict.fromkeys(q, 0.15), q, 7, 5, "nameless")]
    cells, by = frame(spark, good + once + nameless).cache(), ["run_id"]
    fits = R.fit_candidates(cells, by, "dark", "shared").cache()
    shots, cycles = ["run_id", "shot_id"], ["run_id", "cycle_index"]
    for unit, runs, how in (shots, {"r", "nameless"}, {}), (cycles, {"r"}, {}), (shots, {"r", "nameless"}, {"units_per_task": 5}):
        got = R.resampled_intervals(cells, fits, by, "shared", unit, replicates=50, **how).collect()
        assert {(r.run_id, r.parameter) for r in got} == {(k, p) for k in runs for p in ("rate", "level__0->1", "level__1->2")} and all(r.n_replicates == 50 and r.lower <= r.upper for r in got)
    assert {r.run_id for r in R.resampled_bands(cells, by, "shared", shots, "level__0->1", "rate", [0.0, 1.0], replicates=50).collect()} == {"r", "nameless"}


def test_solver_where_losses_curve_along_one_line_only():
    """F1 of round 3, model_intervals: few shots with few losses; the level reaches 1 first, and the rate is solved again with it there."""
    g, t = np.random.default_rng(3), np.linspace(0.1, 1.5, 8)
    n = g.poisson(1.0, (1000, 8, 2)) * 13.0
    s, n, x = (n - g.poisson(1.0, (1000, 8, 2)).clip(0, 1) * (g.random((8, 2)) < 0.4) * (n > 0)).sum(2), n.sum(2), np.c_[np.ones(8), t]
    low = np.array([np.log(1e-9), -R.HIGHEST_RATE])
    nll = [R.fit_log_linear(s, n, x, 0.0, low, rounds=40, start=np.array(b))[1] for b in ([-0.05, -0.05], [-1.0, -1.0], [-0.01, -3.0])]
    assert np.ptp(nll, axis=0).max() < 1e-6
