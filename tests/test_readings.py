"""Implausible readings against a plain version of the definition, and the defined cases."""

import numpy as np
import pytest

from shotlens.operators import readings
from shotlens.operators.readings import ReadingModel, filtered, implausible_readings, stuck_mask

COLUMNS = "run_id string, shot_id int, shot_order int, frame_id int, site_id int, load_id int, roi double, bg double, block int, part string, value double"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1.0) for r in rows], COLUMNS)


def sites(spark, ids=(0, 1), px=25):
    return spark.createDataFrame([("r", i, px, "extra") for i in ids], "run_id string, site_id int, roi_n_pixels int, block string")


def series(n=300, seed=0, step=0.0):
    g = np.random.default_rng(seed)
    y = 1000 + 10 * g.standard_normal(n) + 400 * (g.random(n) < 0.5)
    y[n // 2 :] += step
    return np.round(y, 3)


def found(df):
    return {(r.site_id, r.shot_id, r.reason) for r in df.collect()}


def plain_cases(y, px=25):
    """The definition by hand, with the range taken from the readings near the middle and grown by one width at a time."""
    n = len(y)
    case = (y <= 0) | (y > 65535 * px)
    i = 0
    while i < n:
        j = i
        while j + 1 < n and y[j + 1] == y[i]:
            j += 1
        if j - i >= 3:
            case[i : j + 1] = True
        i = j + 1
    x = y[~case]
    lo, hi = np.quantile(x, 0.2), np.quantile(x, 0.8)
    while True:
        w = hi - lo
        near = x[(x >= lo - w) & (x <= hi + w)]
        if near.min() >= lo and near.max() <= hi:
            break
        lo, hi = min(lo, near.min()), max(hi, near.max())
    return case | (y > hi + (hi - lo)) | (y < lo - (hi - lo))


@pytest.mark.parametrize("model", [ReadingModel(), ReadingModel(block_shots=64, context=16), ReadingModel(sites_per_task=1)])
@pytest.mark.parametrize("step", [0.0, 300.0])
def test_against_the_definition(spark, model, step):
    y = {0: series(seed=1, step=step), 1: series(seed=2, step=step)}
    y[0][[20, 150, 151]] = [9000, 20000, 15000]
    y[0][[61, 62, 63, 64, 65]] = y[0][61]  # a stuck run across a border of blocks
    y[1][[5, 200]] = [0, 2e6]
    y[1][100:104] = y[1][100]
    y[1][120:123] = y[1][120]  # three are no run
    rows = [("r", t, t, 0, s, 1, float(v), 5.0 + t % 7) for s, x in y.items() for t, v in enumerate(x)]
    out = implausible_readings(table(spark, rows), sites(spark), ["roi"], model)
    assert {(s, t) for s, t, _ in found(out)} == {(s, int(t)) for s, x in y.items() for t in np.flatnonzero(plain_cases(x))}


def test_reasons_repeats_and_missing(spark):
    y = series(120, 3)
    rows = [("r", t, t, 0, 0, 1, float(v), None) for t, v in enumerate(y)]
    rows[10] = ("r", 10, 10, 0, 0, 1, float("nan"), None)
    rows[11] = ("r", 11, 11, 0, 0, 1, None, None)
    rows[40] = ("r", 40, 40, 0, 0, 1, 50000.0, None)
    rows[50] = ("r", 50, 50, 0, 0, 1, -3.0, None)
    rows += [("r", 40, 40, 0, 0, 2, 50000.0, None), ("r", 40, 40, 0, 0, None, 50000.0, None)]  # delivered again
    rows += [(None, 1, 1, 0, 0, 1, -5.0, None), ("r", None, 1, 0, 0, 1, -5.0, None), ("r", 1, None, 0, 0, 1, -5.0, None)]
    out = implausible_readings(table(spark, rows), sites(spark), ["roi", "bg"])
    assert found(out) == {(0, 40, "spike"), (0, 50, "impossible")}


def test_repeats_do_not_make_a_stuck_run(spark):
    rows = [("r", t, t, 0, 0, load, float(v), 1.0 + t) for t, v in enumerate(series(50, 4)) for load in (1, 2, 3, 4)]
    assert not found(implausible_readings(table(spark, rows), sites(spark), ["roi"]))


def test_missing_readings_do_not_break_a_run(spark):
    y = series(60, 5)
    y[[20, 22, 24, 26]] = 1111.0
    rows = [("r", t, t, 0, 0, 1, None if t in (21, 23, 25) else float(v), 1.0) for t, v in enumerate(y)]
    assert {(t, r) for _, t, r in found(implausible_readings(table(spark, rows), sites(spark), ["roi"]))} == {(20, "stuck"), (22, "stuck"), (24, "stuck"), (26, "stuck")}


def test_no_site_row_short_series_and_empty(spark):
    rows = [("r", 0, 0, 0, 9, 1, 3e6, 1.0), ("r", 1, 1, 0, 9, 1, 5.0, 1.0)]
    assert not found(implausible_readings(table(spark, rows), sites(spark), ["roi"]))  # no limit known, no range to judge by
    assert implausible_readings(table(spark, []), sites(spark), ["roi"]).count() == 0
    assert implausible_readings(table(spark, rows), sites(spark, ()), ["roi"]).count() == 0


def test_stuck_mask():
    x = np.array([[1.0], [1.0], [1.0], [1.0], [2.0], [2.0], [2.0]])
    assert stuck_mask(x, ~np.isnan(x), 4)[:, 0].tolist() == [True] * 4 + [False] * 3


def judged(y, m=ReadingModel(), px=25):
    """One series through the block's function."""
    n = len(y)
    import pyarrow as pa

    rows = pa.table({"run_id": ["r"] * n, "shot_id": np.arange(n, dtype=np.int32), "shot_order": np.arange(n, dtype=np.int32), "frame_id": np.zeros(n, np.int32), "site_id": np.zeros(n, np.int32), "load_id": np.ones(n, np.int32), "home": np.ones(n, np.int32), "roi": y})
    out = readings.judge_block(["roi"], m)(rows, pa.table({"site_id": [0], "roi_n_pixels": [px]}))
    return {(i, r) for i, r in zip(out["shot_id"].to_pylist(), out["reason"].to_pylist()) if i is not None}


def test_the_filter_decides(monkeypatch):
    """With the filter off, or blind to innovations, or with nothing but its start, the rows are others."""
    y = series(400, 7)
    y[[30, 200]] = [9000, 4000]
    y[100:106] = y[100]
    y[250:] += 700  # a lasting step
    on = judged(y)
    assert on == {(30, "spike"), (200, "spike"), *((i, "stuck") for i in range(100, 106))}
    assert judged(y, ReadingModel(threshold=np.inf)) == {x for x in on if x[1] == "stuck"}  # nothing flagged, nothing found
    assert judged(y, ReadingModel(stuck=10**6)) == {x for x in on if x[1] == "spike"}
    none = np.zeros((len(y), 1), bool)
    monkeypatch.setattr(readings, "filtered", lambda x, seen, plausible, m: (plausible.copy(), none))
    assert judged(y) == set()

    def only_start(x, seen, plausible, m):
        a, b, r = readings.start(x, plausible, m.warm)
        return plausible & (np.minimum(np.abs(x - a), np.abs(x - b)) <= m.threshold * np.sqrt(r)), none

    monkeypatch.setattr(readings, "filtered", only_start)
    assert judged(y) != on


def test_updates_are_withheld_and_variance_vanishes():
    y = np.r_[np.full(40, 100.0) + np.arange(40) % 5, 900.0, 101.0, 102.0, np.full(5, 103.5), 104.0][:, None]
    seen = np.ones_like(y, bool)
    fine, quiet = filtered(y, seen, seen, ReadingModel())
    assert not fine[40, 0] and fine[41:43, 0].all()
    assert np.flatnonzero(quiet[:, 0]).tolist() == list(range(43, 48))


def test_a_level_seldom_taken_is_no_spike_but_a_burst_is():
    g = np.random.default_rng(3)
    y = 1000 + 5 * g.standard_normal(200)
    y[9::13] += 400  # a level that is taken at one reading in thirteen
    y[[70, 71, 72]] += [5000, 5005, 5002]
    assert {i for i, _ in judged(y)} == {70, 71, 72}
