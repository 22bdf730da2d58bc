"""Survival models of binomial cells, one fit per group.

The rows are reduced to cells (successes, trials at a point of the design) by an aggregate; a group has as many cells as
its design has points, so a fit gets a few numbers whatever the rows, and groups are fitted in parallel.

Every model has the form p = q_j * exp(offset - rate * t): with t the dark hold and j the interval it is retention in the
dark, with t the wait and one j the decay in light, with t the number of earlier pulses and known losses as offset repeated imaging.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators.resample import times_drawn

TINY = 1e-9


def log_likelihood(s: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    p = np.clip(p, TINY, 1 - TINY)
    return (s * np.log(p) + (n - s) * np.log1p(-p)).sum(-1)


def levels(s: np.ndarray, n: np.ndarray, e: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each row of e (one per rate) and each level the q in (0, 1] that makes q * e most likely; of (cells by levels) says which cell has which level.

    The log-likelihood is concave in q, so its slope is bisected, for all rates and levels at once.
    """
    top = np.minimum(1.0, (1 - TINY) / np.stack([e[:, of[:, k] > 0].max(1) for k in range(of.shape[1])], 1))

    def slope(q: np.ndarray) -> np.ndarray:
        mine = q @ of.T
        p = np.clip(mine * e, TINY, 1 - TINY)
        return (s / mine - (n - s) * e / (1 - p)) @ of

    lo, hi = np.full_like(top, TINY), top.copy()
    full = slope(top) >= 0
    for _ in range(40):
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where(full, top, (lo + hi) / 2)


def fit_rate(s, n, t, j, offset=None, highest: float = 20.0) -> dict:
    """Rate and levels by profile likelihood: a grid over the rate, then ever finer grids around the best point."""
    s, n, t = (np.asarray(x, float) for x in (s, n, t))
    offset = np.zeros_like(t) if offset is None else np.asarray(offset, float)
    names, at = np.unique(np.asarray(j), return_inverse=True)
    of = np.eye(len(names))[at]

    def profile(rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.exp(offset - rates[:, None] * t)
        q = levels(s, n, e, of)
        return log_likelihood(s, n, (q @ of.T) * e), q

    grid = np.r_[0.0, np.geomspace(1e-4, highest, 40)]
    for _ in range(5):
        ll, _ = profile(grid)
        best = int(ll.argmax())
        a, b = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
        grid = np.linspace(a, b, 21)
    ll, q = profile(grid)
    best = int(ll.argmax())
    rate = float(grid[best])
    return {"rate": rate, "levels": dict(zip(names.tolist(), q[best].tolist())), "nll": -float(ll[best]), "at_edge": bool(rate <= 0 or rate >= 0.99 * highest)}


def fit_rates(s: np.ndarray, n: np.ndarray, t: np.ndarray, j: np.ndarray, highest: float = 20.0) -> np.ndarray:
    """The rates that fit_rate finds for many replicates (rows of s and n) of the same cells; NaN where trials have fewer than two values of t.

    The log-likelihood is concave in the rate and the logarithms of the levels together, so the slope of its profile in the rate
    falls from 0 to the highest rate and is bisected; the levels at a rate are found by Newton steps within a bracket.
    """
    names, at = np.unique(j, return_inverse=True)
    of = np.eye(len(names))[at]
    used = n > 0
    least = np.stack([np.where(used[:, of[:, k] > 0], t[of[:, k] > 0], np.inf).min(1) for k in range(len(names))], 1)
    least = np.where(np.isfinite(least), least, 0.0)
    w, q = n - s, np.full(least.shape, -0.1)

    def slope(rate: np.ndarray) -> np.ndarray:
        nonlocal q
        decay = rate[:, None] * t
        hi = np.minimum(0.0, np.log1p(-TINY) + rate[:, None] * least)
        lo, top = np.full_like(hi, np.log(TINY)), hi.copy()
        q = np.minimum(np.maximum(q, lo), hi)
        for i in range(60):
            p = np.clip(np.exp(q[:, at] - decay), TINY, 1 - TINY)
            odds = p / (1 - p)
            g = (s - w * odds) @ of
            lo, hi = np.where(g > 0, q, lo), np.where(g > 0, hi, q)
            bend = np.maximum((w * odds / (1 - p)) @ of, 1e-300)
            new = q + np.clip(g / bend, -50, 50)
            new = np.where((g > 0) & (q >= top), top, np.where((new > lo) & (new < hi), new, np.where((g > 0) & (new >= top) & (hi >= top), top, (lo + hi) / 2)))
            moved = np.abs(new - q).max()
            q = new
            if moved < 1e-11:
                break
        p = np.clip(np.exp(q[:, at] - decay), TINY, 1 - TINY)
        return (-t * (s - w * p / (1 - p))).sum(1)

    lo, hi = np.zeros(len(s)), np.full(len(s), float(highest))
    flat, steep = slope(lo) <= 0, slope(hi) >= 0
    for _ in range(40):
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    rate = np.where(flat, 0.0, np.where(steep, highest, (lo + hi) / 2))
    several = np.where(used, t, -np.inf).max(1) > np.where(used, t, np.inf).min(1)
    return np.where(several, rate, np.nan)


FIT = "n_cells int, n_trials bigint, rate double, tau double, nll double, at_edge boolean, levels map<string, double>"


def fit_groups(cells: DataFrame, by: list[str], t: str, interval: str, offset: str | None = None) -> DataFrame:
    """by..., and the fit of each group; cells have successes and trials. A group with fewer than two values of t has no rate."""
    use = [*by, t, interval, *([offset] if offset else [])]
    design = cells.where(F.col(t).isNotNull() & ~F.isnan(t)).groupBy(*use).agg(F.sum("successes").alias("s"), F.sum("trials").alias("n")).where("n > 0")
    kinds = ", ".join(f"{b} {cells.schema[b].dataType.simpleString()}" for b in by)

    def fit(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        if x[t].nunique() < 2:
            out = {"rate": None, "levels": {}, "nll": None, "at_edge": None}
        else:
            x = x.sort_values([interval, t])
            out = fit_rate(x["s"], x["n"], x[t], x[interval].astype(str), x[offset] if offset else None)
        tau = 1 / out["rate"] if out["rate"] else None
        row = [*key, len(x), int(x["n"].sum()), out["rate"], tau, out["nll"], out["at_edge"], out["levels"]]
        return pd.DataFrame([row], columns=[*by, "n_cells", "n_trials", "rate", "tau", "nll", "at_edge", "levels"])

    return design.groupBy(*by).applyInPandas(fit, f"{kinds}, {FIT}")


def bootstrap_rates(cells: DataFrame, draws: DataFrame, t: str, interval: str, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of each run's rate over replicates that draw whole shots; cells are weighted, not copied, and every replicate of a run is a fit of its own."""
    x = cells.join(draws.select("replicate", "run_id", "shot_id", "times"), ["run_id", "shot_id"])
    x = x.withColumns({"successes": F.col("successes") * F.col("times"), "trials": F.col("trials") * F.col("times")})
    fits = fit_groups(x, ["replicate", "run_id"], t, interval)
    a = (1 - confidence) / 2
    g = fits.groupBy("run_id").agg(F.count("*").alias("n_replicates"), F.count("rate").alias("n_fitted"), F.percentile("rate", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    point = fit_groups(cells, ["run_id"], t, interval).select("run_id", "rate")
    return point.join(g, "run_id").select("run_id", "n_replicates", "n_fitted", rounded("rate", 5).alias("rate"), rounded(F.col("q")[0], 5).alias("lower"), rounded(F.col("q")[1], 5).alias("upper"))


def resampled_rates(cells: DataFrame, strata: list[str], unit: str, t: str, interval: str, replicates: int = 1000, confidence: float = 0.95, blocks: int = 4) -> DataFrame:
    """What bootstrap_rates gives for draws() of so many replicates. The cells of a run's shots go to a few tasks, and each draws and fits its block of replicates at once: draws and weighted cells are never rows."""
    use = cells.select(*dict.fromkeys(["run_id", *strata, unit, t, interval, "successes", "trials"]))
    for c in strata:
        use = use.where(F.col(c).isNotNull())
    use = use.withColumns({"stratum": F.concat_ws("|", *strata), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).select("run_id", "block", "stratum", unit, t, interval, "successes", "trials")

    def fit(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        own = np.arange(1 + key[1], replicates + 1, blocks)
        units = x[["stratum", unit]].drop_duplicates().reset_index(drop=True)
        row = pd.MultiIndex.from_frame(units).get_indexer(pd.MultiIndex.from_frame(x[["stratum", unit]]))
        ok = (x[t].notna() & x[interval].notna()).to_numpy()
        x, row = x[ok], row[ok]
        design = x[[interval, t]].drop_duplicates().sort_values([interval, t])
        if not len(design):
            return pd.DataFrame({"run_id": [], "replicate": [], "rate": []})
        cell = pd.MultiIndex.from_frame(design).get_indexer(pd.MultiIndex.from_frame(x[[interval, t]]))
        s, n = np.zeros((len(units), len(design))), np.zeros((len(units), len(design)))
        np.add.at(s, (row, cell), x["successes"].to_numpy(float))
        np.add.at(n, (row, cell), x["trials"].to_numpy(float))
        times = times_drawn(units["stratum"].to_numpy(str), units[unit].to_numpy(), own)
        s, n = times @ s, times @ n
        any_trial = (n > 0).any(1)
        rate = fit_rates(s[any_trial], n[any_trial], design[t].to_numpy(float), design[interval].to_numpy(str)) if any_trial.any() else []
        return pd.DataFrame({"run_id": key[0], "replicate": own[any_trial], "rate": pd.Series(rate, dtype=float)})

    fits = use.groupBy("run_id", "block").applyInPandas(fit, "run_id string, replicate int, rate double").withColumn("rate", F.when(~F.isnan("rate"), F.col("rate")))
    a = (1 - confidence) / 2
    g = fits.groupBy("run_id").agg(F.count("*").alias("n_replicates"), F.count("rate").alias("n_fitted"), F.percentile("rate", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    point = fit_groups(cells, ["run_id"], t, interval).select("run_id", "rate")
    return point.join(g, "run_id").select("run_id", "n_replicates", "n_fitted", rounded("rate", 5).alias("rate"), rounded(F.col("q")[0], 5).alias("lower"), rounded(F.col("q")[1], 5).alias("upper"))


def held_out_nll(cells: DataFrame, fits: DataFrame, by: list[str], t: str, interval: str) -> DataFrame:
    """Negative log-likelihood of other cells under the fits, in all and per trial. Cells of intervals the fit never saw are counted apart."""
    x = cells.join(fits.select(*by, "rate", "levels"), by).withColumn("q", F.col("levels")[F.col(interval).cast("string")])
    p = F.least(F.greatest(F.col("q") * F.exp(-F.col("rate") * F.col(t)), F.lit(TINY)), F.lit(1 - TINY))
    nll = -(F.col("successes") * F.ln(p) + (F.col("trials") - F.col("successes")) * F.ln(1 - p))
    return x.groupBy(*by).agg(F.sum("trials").alias("n_trials"), F.sum(nll).alias("nll"), F.sum(F.when(F.col("q").isNull(), F.col("trials")).otherwise(0)).alias("n_unseen")).withColumn("nll_per_trial", F.try_divide("nll", F.col("n_trials") - F.col("n_unseen")))


def paired_gate(per_shot: DataFrame, by: list[str], simple: str, richer: str) -> DataFrame:
    """Whether a richer model is worth it: the gain per shot, its mean and normal interval over shots; passes if the lower end is above zero."""
    gain = F.col(simple) - F.col(richer)
    g = per_shot.groupBy(*by).agg(F.count("*").alias("n_shots"), F.avg(gain).alias("gain"), (F.stddev_samp(gain) / F.sqrt(F.count("*"))).alias("se"))
    lower = F.col("gain") - 1.959964 * F.col("se")
    return g.select(*by, "n_shots", rounded("gain", 6).alias("gain"), rounded(lower, 6).alias("lower"), rounded(F.col("gain") + 1.959964 * F.col("se"), 6).alias("upper"), (F.coalesce(lower > 0, F.lit(False))).cast("int").alias("passes"))


def loss_budget(runs: DataFrame, bright_rate: float, dark_rate: float, gap_s: float = 0.01) -> DataFrame:
    """Each exposure and gap of a run in order: what survives up to it, its own loss, and its part of the total; the parts add up."""
    n = F.col("n_frames")
    seg = F.explode(F.sequence(F.lit(1), 2 * n - 1)).alias("segment")
    x = runs.where("n_frames >= 1 and exposure_ms is not null").select("run_id", (F.col("exposure_ms") / 1000.0).alias("exposure_s"), "n_frames", seg)
    bright = F.col("segment") % 2 == 1
    hazard = F.when(bright, bright_rate * F.col("exposure_s")).otherwise(dark_rate * gap_s)
    # segments alternate, so the hazard before one is a closed form of its number
    k = F.col("segment") - 1
    before = F.ceil(k / 2) * bright_rate * F.col("exposure_s") + F.floor(k / 2) * dark_rate * gap_s
    return x.select("run_id", "segment", F.when(bright, "exposure").otherwise("gap").alias("kind"), rounded(F.exp(-before), 9).alias("before"), rounded(1 - F.exp(-hazard), 9).alias("loss"), rounded(F.exp(-before) * (1 - F.exp(-hazard)), 9).alias("part"))
