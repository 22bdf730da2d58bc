"""Hidden chains of sites that are held in the dark between frames: occupied stays occupied with level_j * exp(-rate * hold), empty stays empty.

The chain is that of ``chains`` with other transitions: frames have levels of their own, interval j has a level, all intervals share a
rate, and each shot has its hold time. In the M-step levels and rate are the log-linear fit of the expected transitions, a concave
problem. Several starts and the grid of a profile over the rate are rows of one array, so that a pass over the data serves them all.

Trajectories of a run are packed into chunks of ``chunk`` trajectories by hold time. A run of up to ``in_task`` trajectories is fitted in
one task, a larger one by rounds in which chunks give sums and one row per run takes the M-step; both give the same.

Defined results: missing values say nothing; trajectories without a hold time, or without any value, are left out; a run with one hold time
has no rate of its own (null) but levels; a start whose levels cross or vanish fails; runs without a start that lives give no row.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.operators.chains import FAILED, FLOOR, HEAD, RUNNING, SETTLED, SPENT, expected
from shotlens.operators.retention import HIGHEST_RATE, fit_log_linear
from shotlens.operators.survival import TINY
from shotlens.session import cut

#: Half of the 95 % point of chi-square with one degree of freedom.
CUTOFF_95 = 1.920729410347062
START_RATES = (0.05, 0.5, 2.0)
FITS = "run_id string, n bigint, holds int, rate double, lower double, upper double, levels array<double>, start double, mean0 array<double>, mean1 array<double>, sd0 array<double>, sd1 array<double>, log_likelihood double, converged boolean, rounds int, n_converged int"


class Fits:
    """Rows of parameters of one run that are fitted side by side; ``fixed`` rates are kept, others (NaN) are fitted."""

    def __init__(self, d: dict):
        self.times, self.floor = np.array(d["times"], float), float(d["floor"])
        for c in ("ll", "state", "rounds", "start", "rate", "fixed", "q", "m0", "m1", "s0", "s1"):
            setattr(self, c, np.array(d[c], float))

    def packed(self) -> str:
        return json.dumps({k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in vars(self).items()})

    @property
    def active(self) -> np.ndarray:
        return np.flatnonzero(self.state == RUNNING)

    def sums(self, y: np.ndarray, length: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Of the active rows over trajectories y (frames by n): log-likelihood, occupied starts, six sums of each frame, and p11 and p10 by hold time and interval."""
        a, k = self.active, y.shape[0]
        out = np.zeros((len(a), 2 + 6 * k + 2 * len(self.times) * (k - 1)))
        for c, t in enumerate(self.times):
            here = time == t
            if not here.any():
                continue
            stay = np.clip(self.q[a] * np.exp(-self.rate[a, None] * t), TINY, 1 - 1e-12)
            rows = np.zeros((len(a), HEAD + 6 * k))
            rows[:, 3] = self.start[a]
            rows[:, HEAD:] = np.concatenate([np.pad(stay, ((0, 0), (0, 1)), constant_values=0.5), np.full((len(a), k), 1e-12), self.m0[a], self.m1[a], self.s0[a], self.s1[a]], 1)
            e = expected(y[:, here], length[here], rows)
            f = e[:, 2:].reshape(len(a), k, 10)
            out[:, :2] += e[:, :2]
            out[:, 2 : 2 + 6 * k] += f[:, :, :6].reshape(len(a), -1)
            at = 2 + 6 * k + 2 * c * (k - 1)
            out[:, at : at + 2 * (k - 1)] += f[:, :-1, 6:8].reshape(len(a), -1)
        return out

    def advance(self, sums: np.ndarray, n: int, rounds: int, tolerance: float) -> None:
        a, k, c = self.active, self.m0.shape[1], len(self.times)
        grown = sums[:, 0] - self.ll[a]
        self.ll[a] = sums[:, 0]
        bad = ~np.isfinite(sums[:, 0]) | (grown < -np.maximum(1e-6, 1e-8 * np.abs(sums[:, 0])))
        self.state[a] = np.where(bad, FAILED, np.where(grown <= tolerance * n, SETTLED, np.where(self.rounds[a] >= rounds, SPENT, RUNNING)))
        go = self.state[a] == RUNNING
        a, sums = a[go], sums[go]
        if not len(a):
            return
        g, gx, gxx, h, hx, hxx = sums[:, 2 : 2 + 6 * k].reshape(-1, k, 6).transpose(2, 0, 1)
        empty = g + h <= 0
        lost = ((np.minimum(g, h) <= 1e-8) & ~empty).any(1)
        over = lambda x, w: x / np.maximum(w, 1e-12)
        m0, m1 = over(hx, h), over(gx, g)
        lost |= ((m1 <= m0) & ~empty).any(1)
        sd = lambda xx, w, m: np.maximum(np.sqrt(np.maximum(over(xx, w) - m * m, 0)), self.floor)
        for name, new in (("m0", m0), ("m1", m1), ("s0", sd(hxx, h, m0)), ("s1", sd(gxx, g, m1))):
            old = getattr(self, name)
            old[a] = np.where(empty, old[a], new)
        self.start[a] = np.clip(sums[:, 1] / n, 1e-6, 1 - 1e-6)
        moves = sums[:, 2 + 6 * k :].reshape(len(a), c, k - 1, 2)
        s, m = moves[..., 0].reshape(len(a), -1), moves.sum(3).reshape(len(a), -1)
        level = np.tile(np.eye(k - 1), (c, 1))
        t = np.repeat(self.times, k - 1)
        free = np.isnan(self.fixed[a])
        low = np.log(np.full(k - 1, TINY))
        for rows in (np.flatnonzero(free), np.flatnonzero(~free)):
            if not len(rows):
                continue
            if free[rows[0]] and c > 1:
                b, _ = fit_log_linear(s[rows], m[rows], np.c_[level, t], 0.0, np.r_[low, -HIGHEST_RATE], rounds=50)
                self.rate[a[rows]] = -b[:, -1]
            else:  # a known rate, or one hold time, which can't tell rate and levels apart
                b = np.stack([fit_log_linear(s[[r]], m[[r]], level, -self.rate[a[r]] * t, low, rounds=50)[0][0] for r in rows])
            self.q[a[rows]] = np.clip(np.exp(b[:, : k - 1]), 1e-6, 1 - 1e-6)
        self.state[a[lost]] = FAILED
        self.rounds[a] += 1


def begin(y_quartiles: np.ndarray, sd: np.ndarray, times: list[float]) -> Fits:
    """Starts from the quartiles of each frame and several rates."""
    m0, m1 = y_quartiles
    scale = max(float(np.mean(m1 - m0)), 1e-6)
    k, r = len(m0), len(START_RATES) if len(times) > 1 else 1
    rep = lambda v: np.tile(np.asarray(v, float), (r, 1))
    rates = START_RATES if len(times) > 1 else (0.0,)
    return Fits({"times": times, "floor": FLOOR * scale, "ll": [-np.inf] * r, "state": [RUNNING] * r, "rounds": [0] * r, "start": [0.5] * r, "rate": list(rates), "fixed": [np.nan] * r, "q": np.full((r, k - 1), 0.9), "m0": rep(m0), "m1": rep(np.maximum(m1, m0 + 1e-6)), "s0": rep(np.maximum(sd / 2, FLOOR * scale)), "s1": rep(np.maximum(sd / 2, FLOOR * scale))})


def best_of(f: Fits) -> int | None:
    """The likeliest settled row, or of all that live if none settled."""
    ok = f.state == SETTLED
    ok = ok if ok.any() else f.state == SPENT
    return int(np.where(ok, f.ll, -np.inf).argmax()) if ok.any() else None


def profile_of(f: Fits, i: int, points: int, span: float) -> Fits:
    """Rows with the rate fixed on a grid around row i's, the other parameters from row i; the last row is row i itself."""
    low, high = (f.rate[i] / span, f.rate[i] * span) if f.rate[i] > 0.05 else (1e-4, 2.0)  # a rate near 0 is bounded from above only
    grid = np.r_[np.geomspace(low, high, points), f.rate[i]]
    n = len(grid)
    rep = lambda v: np.repeat(v[i][None], n, 0)
    return Fits({"times": f.times, "floor": f.floor, "ll": [-np.inf] * n, "state": [RUNNING] * n, "rounds": [0] * n, "start": [f.start[i]] * n, "rate": grid, "fixed": grid, "q": rep(f.q), "m0": rep(f.m0), "m1": rep(f.m1), "s0": rep(f.s0), "s1": rep(f.s1)})


def limits(rates: np.ndarray, ll: np.ndarray) -> tuple[float | None, float | None]:
    """Where the profile falls by the cutoff below its top on either side, on the logarithm of the rate; None where it doesn't within the grid."""
    order = np.argsort(rates)
    x, y = np.log(np.maximum(rates[order], 1e-300)), ll[order]
    top = int(np.argmax(y))
    cutoff = y[top] - CUTOFF_95
    out = []
    for step in (-1, 1):
        i = top
        while 0 <= i + step < len(y) and y[i + step] >= cutoff:
            i += step
        j = i + step
        out.append(float(np.exp(x[j] + (cutoff - y[j]) / (y[i] - y[j]) * (x[i] - x[j]))) if 0 <= j < len(y) else None)
    return out[0], out[1]


def row_of(run: str, n: int, f: Fits, i: int, centre: np.ndarray, p: Fits | None) -> list:
    several = len(f.times) > 1
    lower, upper = limits(p.rate, p.ll) if p is not None and several else (None, None)
    return [run, n, len(f.times), max(0.0, float(f.rate[i])) if several else None, lower, upper, f.q[i].tolist(), float(f.start[i]), (f.m0[i] + centre).tolist(), (f.m1[i] + centre).tolist(), f.s0[i].tolist(), f.s1[i].tolist(), float(f.ll[i]), bool(f.state[i] == SETTLED), int(f.rounds[i]), int((f.state == SETTLED).sum())]


COLUMNS = [c.strip().split()[0] for c in FITS.split(", ")]


def fit_holds(traj: DataFrame, rounds: int = 200, tolerance: float = 1e-7, points: int = 14, span: float = 6.0, in_task: int = 100_000, chunk: int = 20_000) -> DataFrame:
    """FITS for each run of traj (run_id, y, t): the likeliest chain over the starts, and the profile interval of its rate."""
    x = traj.where(F.col("t").isNotNull() & ~F.isnan("t") & (F.col("t") >= 0)).select("run_id", "y", F.col("t").cast("double").alias("t"))
    x = cut(x.withColumn("_id", F.monotonically_increasing_id()))
    q = x.select("run_id", F.posexplode("y").alias("frame", "v")).where("v is not null and not isnan(v)").groupBy("run_id", "frame").agg(F.percentile_approx("v", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias("q"), F.stddev_pop("v").alias("sd"))
    guess = q.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("frame", F.col("q")[0].alias("m0"), F.col("q")[1].alias("m1"), "sd"))).alias("frames"))
    n = x.groupBy("run_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("t")).alias("times"), F.max(F.size("y")).alias("k")).where("k >= 2")  # as many times as conditions
    guess = cut(guess.join(n, "run_id").where(F.size("frames") == F.col("k")))

    def starts(row) -> tuple[np.ndarray, Fits]:
        centre = np.array([f["m0"] for f in row["frames"]], float)
        up = np.array([f["m1"] for f in row["frames"]], float) - centre
        return centre, begin((np.zeros(len(centre)), up), np.array([f["sd"] for f in row["frames"]], float), list(row["times"]))

    def matrix(lists, k: int) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(v) for v in lists])
        y = np.full((k, len(lists)), np.nan)
        for j, v in enumerate(lists):
            y[: len(v), j] = np.asarray(v, float)
        return y, length

    def whole(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame(columns=COLUMNS)
        row = right.iloc[0]
        centre, f = starts(row)
        y, length = matrix(left["y"], len(centre))
        y, time = y - centre[:, None], left["t"].to_numpy(float)

        def settle(fits: Fits) -> None:
            while len(fits.active):
                fits.advance(fits.sums(y, length, time), int(row["n"]), rounds, tolerance)

        settle(f)
        i = best_of(f)
        if i is None:
            return pd.DataFrame(columns=COLUMNS)
        p = None
        if len(f.times) > 1:
            p = profile_of(f, i, points, span)
            settle(p)
        return pd.DataFrame([row_of(row["id"], int(row["n"]), f, i, centre, p)], columns=COLUMNS)

    small, large = guess.where(F.col("n") <= in_task), guess.where(F.col("n") > in_task)
    out = x.join(small.select("run_id"), "run_id", "left_semi").groupBy("run_id").cogroup(small.withColumnRenamed("run_id", "id").groupBy("id")).applyInPandas(whole, FITS)
    if large.isEmpty():
        return cut(out)

    # larger runs: chunks are packed once, rounds send them the rows of parameters, and only sums come back
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, length = matrix(pdf["y"], int(pdf["y"].map(len).max()))
        return pd.DataFrame([[key[0], y.shape[0], y.tobytes(), length.astype(np.int64).tobytes(), pdf["t"].to_numpy(float).tobytes()]], columns=["run_id", "k", "y", "length", "t"])

    part = F.pmod(F.xxhash64("_id"), F.ceil(F.col("n") / chunk)).alias("part")
    packed = cut(x.join(large.select("run_id", "n"), "run_id").select("run_id", part, "y", "t").groupBy("run_id", "part").applyInPandas(pack, "run_id string, k int, y binary, length binary, t binary"))

    def first(batches):
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                centre, f = starts(r)
                rows.append([r["run_id"], r["n"], json.dumps(centre.tolist()), f.packed(), None, len(f.active)])
            yield pd.DataFrame(rows, columns=["run_id", "n", "centre", "fits", "profile", "active"])

    STATE = "run_id string, n bigint, centre string, fits string, profile string, active int"

    def e_step(batches):
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                f, centre = Fits(json.loads(r["profile"] or r["fits"])), np.array(json.loads(r["centre"]))
                length = np.frombuffer(r["length"], np.int64)
                y = np.full((len(centre), len(length)), np.nan)
                y[: r["k"]] = np.frombuffer(r["y"], float).reshape(r["k"], -1)
                rows.append([r["run_id"], f.sums(y - centre[:, None], length, np.frombuffer(r["t"], float)).tobytes()])
            yield pd.DataFrame(rows, columns=["run_id", "sums"])

    def m_step(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = right.iloc[0].to_dict()
        f = Fits(json.loads(r["profile"] or r["fits"]))
        if len(left) and len(f.active):
            total = sum(np.frombuffer(s, float) for s in left["sums"])
            f.advance(total.reshape(len(f.active), -1), int(r["n"]), rounds, tolerance)
        r["profile" if r["profile"] else "fits"] = f.packed()
        i = best_of(f)
        if not r["profile"] and not len(f.active) and i is not None and len(f.times) > 1:  # the starts are done: the profile begins
            f = profile_of(f, i, points, span)
            r["profile"] = f.packed()
        r["active"] = len(f.active)
        return pd.DataFrame([r])[["id", "n", "centre", "fits", "profile", "active"]].rename(columns={"id": "run_id"})

    def last(batches):
        for b in batches:
            rows = []
            for _, r in b.iterrows():
                f = Fits(json.loads(r["fits"]))
                i = best_of(f)
                if i is not None:
                    rows.append(row_of(r["run_id"], int(r["n"]), f, i, np.array(json.loads(r["centre"])), Fits(json.loads(r["profile"])) if r["profile"] else None))
            yield pd.DataFrame(rows, columns=COLUMNS)

    state = cut(large.mapInPandas(first, STATE))
    for _ in range(2 * rounds + 4):
        running = state.where("active > 0")
        if running.isEmpty():
            break
        sums = packed.join(running.select("run_id", "centre", "fits", "profile"), "run_id").mapInPandas(e_step, "run_id string, sums binary")
        state = cut(sums.groupBy("run_id").cogroup(state.withColumnRenamed("run_id", "id").groupBy("id")).applyInPandas(m_step, STATE))
    return cut(out.unionByName(state.mapInPandas(last, FITS)))
