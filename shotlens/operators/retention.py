"""Survival models of binomial cells as log-linear regressions: fitted on training shots, compared on validation shots, resampled by shots.

Every model but one has log p = known + x . b with x >= 0 and b <= 0, where exp(b) is what a step leaves (a level) or -b a rate.
The log-likelihood is concave in b, so projected Newton steps reach its only top from any start; all replicates of a bootstrap are
one array. The one with a floor, p = level * (f + (1 - f) exp(-rate t)), is profiled over f and rate.

* dark: retention over a dark hold t, a level per interval; one rate, one for the first interval and one for the others, or one each
* bright: first-frame occupancy over a wait t in light; with or without a floor
* control: retention after a wait t; flat, or falling with a rate
* repeated: occupancy by pulses, a level per run, with known losses in light and dark; nothing on top, a factor per further pulse in
  common, by exposure, or by boundary

Cells are (group, run_id, shot_id, split, interval, t, exposure_s, pulses, known, successes, trials). A group's design has as many
points as its conditions, intervals and frames, whatever the rows, so a fit gets a few numbers and groups are fitted in parallel.

Defined results: only rows of the training split are fitted (``training_only`` raises on others); a rate whose training cells have
fewer than two times makes a candidate unfitted (null), as does a level without training cells; validation cells at points that
the fit doesn't know are counted as unseen and not scored; null or NaN times are left out; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators.survival import TINY, levels, log_likelihood
from shotlens.session import cut

POINT = ["run_id", "interval", "t", "exposure_s", "pulses", "known"]
#: Candidates of each family, the plainest first.
FAMILIES = {
    "dark": ["shared", "first_separate", "by_interval"],
    "bright": ["no_floor", "floor"],
    "control": ["flat", "monotone"],
    "repeated": ["known_losses", "common_factor", "factor_by_exposure", "factor_by_boundary"],
}
HIGHEST_RATE = 20.0


def training_only(rows: DataFrame, split: str = "split", label: str = "train") -> DataFrame:
    """rows, unless they have another split than label."""
    other = [r[0] for r in rows.select(split).distinct().where(~F.col(split).eqNullSafe(F.lit(label))).limit(5).collect()]
    if other:
        raise ValueError(f"training rows only, but {split!r} also has {other}")
    return rows


def disjoint_shots(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """held_out, unless it shares shots with train."""
    key = ["run_id", "shot_id"]
    both = [tuple(r) for r in held_out.select(*key).join(train.select(*key), key, "left_semi").distinct().limit(3).collect()]
    if both:
        raise ValueError(f"held-out shots among the training shots: {both}")
    return held_out


def fit_log_linear(s: np.ndarray, n: np.ndarray, x: np.ndarray, known: np.ndarray | float = 0.0, low: np.ndarray | None = None, rounds: int = 200, tolerance: float = 1e-12, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(b, nll) for each row of s and n (replicates by cells); x is cells by parameters.

    Where each cell has one of the first columns, a level, the curvature between levels is diagonal: what is solved has as many
    unknowns as there are other columns, so a step takes time in proportion to the cells, however many levels there are.
    """
    scale = np.maximum(x.max(0), 1e-12)
    x = x / scale
    k = x.shape[1]
    low = np.full(k, np.log(TINY)) if low is None else low * scale
    b = np.maximum(np.full((len(s), k), -0.05) if start is None else np.tile(np.minimum(start * scale, -0.01), (len(s), 1)), low)
    top = np.log1p(-TINY)
    one_hot = np.isin(x, (0.0, 1.0)).all(0)
    m = k if one_hot.all() else int(np.argmin(one_hot))  # columns of levels come first
    m = m if m and (x[:, :m].sum(1) == 1).all() else 0
    order = np.argsort(x[:, :m].argmax(1), kind="stable") if m else np.arange(len(x))
    x, s, n, known = x[order], s[:, order], n[:, order], known[order] if isinstance(known, np.ndarray) else known
    of = x[:, :m].argmax(1) if m else None
    z = x[:, m:]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if m else None
    lost = n - s

    def at_point(b, rows):
        e = b[:, m:] @ z.T + known
        if m:
            e += b[:, of]
        np.minimum(e, top, out=e)
        p = np.exp(e)
        e *= s[rows]
        e += lost[rows] * np.log1p(-p)
        return e.sum(1), p

    by_level = lambda v: np.add.reduceat(v, first, 1)

    def solved(g, stop, own, h, cross):
        """(Newton step, diagonal of the curvature) for the parameters that are not stopped."""
        sl, sz = stop[:, :m], stop[:, m:]
        own = np.where(sl, 0.0, own)
        h = np.where(sz[:, :, None] | sz[:, None, :], 0.0, h)
        damp = 1e-10 * np.maximum(own.sum(1) + np.einsum("rkk->r", h), 1e-9)
        own = own + np.where(sl, 1.0, damp[:, None])
        h = h + np.eye(z.shape[1]) * np.where(sz, 1.0, damp[:, None])[:, :, None]
        each = np.concatenate([own, np.einsum("rkk->rk", h)], 1)
        cross = np.where(sl[:, :, None] | sz[:, None, :], 0.0, cross)
        left = h - np.einsum("rlk,rlj->rkj", cross / own[:, :, None], cross)
        right = g[:, m:] - np.einsum("rlk,rl->rk", cross, g[:, :m] / own)
        dz = (right / left[:, :, 0] if z.shape[1] == 1 else np.linalg.solve(left, right[:, :, None])[:, :, 0]) if z.shape[1] else right
        return np.concatenate([(g[:, :m] - np.einsum("rlk,rk->rl", cross, dz)) / own, dz], 1), each

    ll, p = at_point(b, slice(None))
    going = np.arange(len(s))
    for _ in range(rounds):
        if not len(going):
            break
        c, pp = b[going], p[going]
        odds = lost[going] * (pp / (1 - pp))
        slope, bend = s[going] - odds, odds / (1 - pp)
        g = np.concatenate([by_level(slope), slope @ z], 1) if m else slope @ z
        stop = ((c >= -1e-10) & (g > 0)) | ((c <= low) & (g < 0))
        g = np.where(stop, 0.0, g)
        own = by_level(bend) if m else np.zeros((len(c), 0))
        h = np.einsum("rc,ck,cl->rkl", bend, z, z) if z.shape[1] > 1 else (bend @ (z * z))[:, :, None] if z.shape[1] else np.zeros((len(c), 0, 0))
        cross = np.stack([by_level(bend * w) for w in z.T], 2) if m and z.shape[1] else np.zeros((len(c), m, z.shape[1]))
        d, each = solved(g, stop, own, h, cross)
        # of the parameters that would pass their bounds the first goes to its bound, and the step of the others is solved again with that
        held, straight = stop.copy(), (g * d).sum(1)
        for i in range(k):
            beyond = ~held & ((c + d > 0) | (c + d < low))
            r = np.flatnonzero(beyond.any(1))
            if not len(r):
                break
            room = np.divide(np.where(d > 0, -c, low - c)[r], d[r], out=np.full((len(r), k), np.inf), where=beyond[r])
            held[r] |= beyond[r] if i > 4 else room <= np.minimum(room.min(1, keepdims=True), 1)
            to = np.where(held[r], np.clip(c[r] + d[r], low, 0.0) - c[r], 0.0)
            pull = np.concatenate([own[r] * to[:, :m] + np.einsum("rlk,rk->rl", cross[r], to[:, m:]), np.einsum("rlk,rl->rk", cross[r], to[:, :m]) + np.einsum("rkj,rj->rk", h[r], to[:, m:])], 1)
            free = np.where(held[r], to, solved(np.where(held[r], 0.0, g[r] - pull), held[r], own[r], h[r], cross[r])[0])
            up = ((g[r] * free).sum(1) > 0) | (straight[r] <= 0)
            d[r[up]], held[r[~up]] = free[up], True
        # a slope that no curvature stands against leads to the bound; where bounds turn a step away from the top, each parameter goes its own way
        step, best, new, after = np.ones(len(going)), ll[going], c.copy(), ll[going].copy()
        todo = np.flatnonzero((g * d).sum(1) > tolerance * np.maximum(1.0, np.abs(best)))  # others have nothing to gain
        for i in range(52):
            if not len(todo):
                break
            if i == 12:
                d[todo], step[todo] = g[todo] / each[todo], 1.0
            try_ = np.clip(c[todo] + step[todo, None] * d[todo], low, 0.0)
            got, there = at_point(try_, going[todo])
            ok = got >= best[todo] + 1e-4 * (g[todo] * (try_ - c[todo])).sum(1)
            new[todo[ok]], after[todo[ok]], p[going[todo[ok]]] = try_[ok], got[ok], there[ok]
            todo = todo[~ok]
            step[todo] *= 0.5
        b[going] = new
        settled = after - ll[going] <= tolerance * np.maximum(1.0, np.abs(after))
        ll[going] = np.maximum(after, ll[going])
        going = going[~settled]
    return b / scale, -ll


def _in_order(intervals: pd.Series) -> list[str]:
    return sorted(intervals.unique(), key=lambda i: [int(x) if x.isdigit() else 0 for x in i.split("->")])


def _rates(candidate: str, names: pd.Series, order: list[str]) -> dict[str, np.ndarray]:
    """The rates of a candidate, and the points at which each acts."""
    first = (names == order[0]).to_numpy(bool)
    if candidate in ("flat", *FAMILIES["repeated"]):
        return {}
    if candidate == "first_separate":
        return {"rate__first": first, "rate__later": ~first}
    if candidate == "by_interval":
        return {f"rate__{i}": (names == i).to_numpy(bool) for i in order}
    return {"rate": np.ones(len(names), bool)}


def carried(candidate: str, d: pd.DataFrame, x: np.ndarray, used: np.ndarray) -> np.ndarray:
    """For each row of used (replicates by points) whether design() has a result for it; x is the design of all points."""
    names, t = d["interval"].astype(str), d["t"].to_numpy(float)
    ok = (used.astype(float) @ (x > 0) > 0).all(1)
    for here in _rates(candidate, names, _in_order(names)).values():
        ok &= np.where(used & here, t, -np.inf).max(1) > np.where(used & here, t, np.inf).min(1)
    return ok


def fit_many(candidate: str, d: pd.DataFrame, s: np.ndarray, n: np.ndarray, cells: int = 200_000) -> tuple[list[str], np.ndarray]:
    """(names, parameters by replicate): the candidate fitted to every row of s and n; NaN where it can't be. Replicates start from the fit to their sum."""
    if candidate == "floor":
        got = [f and f["parameters"] for f in (fit_candidate(candidate, d, a, b) for a, b in zip(s, n))]
        names = next((list(f) for f in got if f), [])
        return names, np.array([[f[k] for k in names] if f else [np.nan] * len(names) for f in got], float).reshape(len(s), len(names))
    full = design(candidate, d, np.ones(len(d), bool))
    if full is None:
        return [], np.zeros((len(s), 0))
    names, x, low = full
    known = d["known"].to_numpy(float)
    out = np.full((len(s), len(names)), np.nan)
    can = np.flatnonzero(carried(candidate, d, x, n > 0))
    if len(can):
        start = fit_log_linear(s[can].sum(0)[None], n[can].sum(0)[None], x, known, low)[0][0]
        rate = np.array([k.startswith("rate") for k in names])
        for at in np.array_split(can, -(-len(can) * len(d) // cells)):
            b, _ = fit_log_linear(s[at], n[at], x, known, low, start=start)
            out[at] = np.where(rate, -b, np.exp(b))
    return names, out


def design(candidate: str, d: pd.DataFrame, used: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Names, x and lower bounds of a candidate over the points d; ``used`` marks those with training cells. None if they can't carry it."""
    t, cols = d["t"].to_numpy(float), {}
    if candidate in FAMILIES["repeated"]:
        level, pulses = d["run_id"].astype(str), d["pulses"].to_numpy(float)
        runs, of = np.unique(level.to_numpy(str), return_inverse=True)
        for r, column in zip(runs, np.eye(len(runs))[:, of]):
            cols[f"level__{r}"] = column
        if candidate == "common_factor":
            cols["factor__common"] = pulses - 1
        elif candidate == "factor_by_exposure":
            for e in sorted(d["exposure_s"].unique()):
                cols[f"factor__{round(e * 1000)}ms"] = (pulses - 1) * (d["exposure_s"] == e)
        elif candidate == "factor_by_boundary":
            for k in range(1, int(pulses.max())):
                cols[f"factor__boundary_{k}"] = (pulses > k).astype(float)
    else:
        names = d["interval"].astype(str)
        order = _in_order(names)
        for i in order:
            cols[f"level__{i}"] = (names == i).to_numpy(float)
        if candidate in ("first_separate", "by_interval") and len(order) < 2:
            return None
        for name, here in _rates(candidate, names, order).items():
            if len(np.unique(t[used & here])) < 2:
                return None
            cols[name] = here * t
    x = np.stack([np.asarray(c, float) for c in cols.values()], 1)
    if (x[used].max(0, initial=0) <= 0).any():
        return None
    return list(cols), x, np.array([-HIGHEST_RATE if c.startswith("rate") else np.log(TINY) for c in cols])


def fit_floor(s: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[float, float, float, float]:
    """(level, floor share, rate, nll) by profile over share and rate on ever finer grids."""
    one = np.ones((len(t), 1))
    shares, rates = np.linspace(0, 1, 21), np.r_[0.0, np.geomspace(1e-3, HIGHEST_RATE, 40)]
    for _ in range(6):
        f, r = (g.ravel() for g in np.meshgrid(shares, rates, indexing="ij"))
        e = f[:, None] + (1 - f[:, None]) * np.exp(-r[:, None] * t)
        q = levels(s, n, e, one)
        ll = log_likelihood(s, n, q * e)
        best = int(ll.argmax())
        out = float(q[best, 0]), float(f[best]), float(r[best]), -float(ll[best])
        i, j = divmod(best, len(rates))
        shares = np.linspace(shares[max(0, i - 1)], shares[min(len(shares) - 1, i + 1)], 15)
        rates = np.linspace(rates[max(0, j - 1)], rates[min(len(rates) - 1, j + 1)], 15)
    return out


def fit_candidate(candidate: str, d: pd.DataFrame, s: np.ndarray, n: np.ndarray) -> dict | None:
    """One fit over the points d with training counts s and n: parameters, probabilities at all points, nll, on_boundary."""
    used = n > 0
    got = design("no_floor" if candidate == "floor" else candidate, d, used) if used.any() else None
    if got is None:
        return None
    names, x, low = got
    known = d["known"].to_numpy(float)
    if candidate == "floor":
        level, share, rate, nll = fit_floor(s[used], n[used], d["t"].to_numpy(float)[used])
        p = level * (share + (1 - share) * np.exp(-rate * d["t"].to_numpy(float)))
        edge = level > 1 - 1e-6 or rate < 1e-7 or rate > HIGHEST_RATE - 1e-6 or not 1e-7 <= share <= 1 - 1e-7
        return {"parameters": {names[0]: level, "floor": level * share, "rate": rate}, "p": p, "nll": nll, "edge": bool(edge)}
    b, nll = fit_log_linear(s[None, used], n[None, used], x[used], known[used], low)
    b = b[0]
    known_p = np.clip(np.exp(known + x @ b), TINY, 1 - TINY)
    known_p[(x[:, x[used].max(0) <= 0] > 0).any(1)] = np.nan
    return {"parameters": {k: float(-v if k.startswith("rate") else np.exp(v)) for k, v in zip(names, b)}, "p": known_p, "nll": float(nll[0]), "edge": _on_edge(names, b)}


def _on_edge(names: list[str], b: np.ndarray) -> bool:
    """A level or factor at 0 or 1, or a rate at 0 or its highest; the levels of the repeated models don't count, as they may be 1."""
    factors = any(k.startswith("factor") for k in names)
    return any((v > -1e-7 or v < -HIGHEST_RATE + 1e-6) if k.startswith("rate") else (v > -1e-6 or v < np.log(1e-6)) for k, v in zip(names, b) if k.startswith("factor") or not factors)


FIT = {"candidate": "string", "complexity": "int", "n_parameters": "int", "train_nll": "double", "on_boundary": "boolean", "parameters": "map<string, double>", "points": "map<string, double>"}


def _kinds(df: DataFrame, by: list[str], more: dict[str, str]) -> str:
    return ", ".join([f"{b} {df.schema[b].dataType.simpleString()}" for b in by] + [f"{k} {v}" for k, v in more.items()])


def _pointed(cells: DataFrame) -> DataFrame:
    """Cells with usable times, and the key of their point."""
    ok = F.col("t").isNotNull() & ~F.isnan("t") & F.col("known").isNotNull() & ~F.isnan("known") & F.col("interval").isNotNull() & (F.col("trials") > 0)
    return cells.where(ok).withColumn("point", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in POINT]))


def _of_training(c: str) -> Column:
    return F.sum(F.when(F.col("split") == "train", F.col(c)).otherwise(0)).cast("double")


def _spread(df: DataFrame, by: list[str]) -> DataFrame:
    """df with its groups over all partitions of a shuffle: they are few bytes and much work, and would be put together in a task by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def fit_candidates(cells: DataFrame, by: list[str], family: str, only: str | None = None) -> DataFrame:
    """(by..., FIT): every candidate of the family, or only one, fitted to the train cells of each group, with its probability at all points of the design."""
    rest = [c for c in POINT if c not in by]
    d = _pointed(cells).groupBy(*by, "point", *rest).agg(_of_training("successes").alias("s"), _of_training("trials").alias("n"))

    def fit(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("point").reset_index(drop=True)
        rows = []
        for i, c in enumerate(FAMILIES[family]):
            if only not in (None, c):
                continue
            got = fit_candidate(c, x, x["s"].to_numpy(float), x["n"].to_numpy(float))
            if got:
                points = {k: float(v) for k, v in zip(x["point"], got["p"]) if np.isfinite(v)}
                rows.append([*key, c, i, len(got["parameters"]), got["nll"], got["edge"], got["parameters"], points])
            else:
                rows.append([*key, c, i, *[None] * 5])
        return pd.DataFrame(rows, columns=[*by, *FIT])

    return _spread(d, by).groupBy(*by).applyInPandas(fit, _kinds(d, by, FIT))


def scored(cells: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """(by..., candidate, run_id, shot_id, split, trials, nll, unseen) of every cell under every fit that there is."""
    x = _pointed(cells).join(fits.where("points is not null").select(*by, "candidate", "points"), by)
    p = F.col("points")[F.col("point")]
    p = F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))
    nll = -(F.col("successes") * F.ln(p) + (F.col("trials") - F.col("successes")) * F.ln(1 - p))
    return x.select(*dict.fromkeys([*by, "candidate", "run_id", "shot_id", "split"]), "trials", nll.alias("nll"), F.col("points")[F.col("point")].isNull().cast("int").alias("unseen"))


def gains(scores: DataFrame, by: list[str], plain: str, richer: str, per_row: bool = False) -> DataFrame:
    """(by..., run_id, shot_id, gain): what the richer candidate gains over the plain one on each shot, in all or per row."""
    keys = list(dict.fromkeys([*by, "run_id", "shot_id"]))
    of = lambda c: F.sum(F.when(F.col("candidate") == c, F.col("nll")))
    n = F.sum(F.when(F.col("candidate") == plain, F.col("trials")))
    g = scores.where(F.col("candidate").isin(plain, richer) & (F.col("unseen") == 0)).groupBy(*keys).agg((of(plain) - of(richer)).alias("gain"), n.alias("n"))
    return g.where("gain is not null").select(*keys, (F.col("gain") / F.col("n") if per_row else F.col("gain")).alias("gain"))


def normal_gate(gain: DataFrame, by: list[str]) -> DataFrame:
    """Mean gain per shot with its normal interval over shots; resolved if the lower end is above zero."""
    g = gain.groupBy(*by).agg(F.count("*").alias("n_shots"), F.avg("gain").alias("gain"), (F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("se"))
    lower = F.col("gain") - 1.959963984540054 * F.col("se")
    return g.select(*by, "n_shots", "gain", lower.alias("lower"), (F.col("gain") + 1.959963984540054 * F.col("se")).alias("upper"), F.coalesce(lower > 0, F.lit(False)).alias("resolved"))


def unit_weights(units: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson weights (replicates by units), the same for a unit wherever it is met."""
    import hashlib

    return np.stack([np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed}|{u}".encode(), digest_size=8).digest(), "big")).poisson(1.0, replicates) for u in units], 1).astype(float) if len(units) else np.zeros((replicates, 0))


def quantiles(v: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """Each share's quantile of every column of v (rows are replicates), interpolated as Spark's percentile does."""
    v = np.sort(v, 0)
    at = np.array(shares) * (len(v) - 1)
    lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
    near = (hi - at)[:, None] * v[lo] + (at - lo)[:, None] * v[hi]
    return np.where(((lo == hi)[:, None]) | (v[lo] == v[hi]), v[lo], near)


def _blocks(df: DataFrame, unit: Column, units_per_task: int) -> DataFrame:
    """A block number, so that a block has about so many units."""
    n = df.select(unit.alias("u")).distinct().count()
    return df.withColumn("_block", F.pmod(F.xxhash64(unit), F.lit(max(1, -(-n // units_per_task)))).cast("int"))


def resampled_gate(gain: DataFrame, by: list[str], least: float = 1e-4, replicates: int = 2000, seed: int = 20260731, units_per_task: int = 20_000) -> DataFrame:
    """Mean gain over shots with the percentile interval of a Poisson bootstrap over shots; resolved if the mean is above least and the lower end above zero."""
    unit = F.concat_ws("|", "run_id", "shot_id")

    def sums(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        w = unit_weights(x["u"].to_numpy(str), replicates, seed)
        v = x["gain"].to_numpy(float)
        return pd.DataFrame({**{b: [k] * replicates for b, k in zip(by, key)}, "replicate": np.arange(replicates), "s": w @ v, "n": w.sum(1)})

    x = _blocks(gain.withColumn("u", unit), unit, units_per_task).select(*by, "_block", "u", "gain")
    parts = x.groupBy(*by, "_block").applyInPandas(sums, _kinds(gain, by, {"replicate": "int", "s": "double", "n": "double"}))
    m = parts.groupBy(*by, "replicate").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m")).groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = gain.groupBy(*by).agg(F.count("*").alias("n_shots"), F.avg("gain").alias("gain"))
    lower = F.col("q")[0]
    return point.join(m, by).select(*by, "n_shots", "gain", lower.alias("lower"), F.col("q")[1].alias("upper"), ((F.col("gain") > least) & (lower > 0)).alias("resolved"))


def compare(cells: DataFrame, fits: DataFrame, by: list[str], family: str, tolerance: float = 0.0) -> DataFrame:
    """(by..., candidate, ..., selected): validation likelihood of every candidate, its gate against the plainer one, and the choice.

    dark, bright, control: the best on validation (within the tolerance the one with the fewest parameters) if its gain over the
    plainest resolves over shots and it has no parameter on a bound, else the plainest. repeated: the common factor if its gate
    passes, then the factors by exposure if theirs against the common one does; the factors by boundary are for diagnosis only.
    """
    scores = scored(cells.where("split = 'validation'"), fits, by)
    v = scores.groupBy(*by, "candidate").agg(F.sum("trials").alias("n_validation"), F.sum("nll").alias("validation_nll"), F.sum(F.col("unseen") * F.col("trials")).alias("n_unseen"))
    names = FAMILIES[family]
    if family == "repeated":
        steps = {names[1]: names[0], names[2]: names[1]}
        gates = [resampled_gate(gains(scores, by, plain, c, True), by).withColumn("candidate", F.lit(c)) for c, plain in steps.items()]
    else:
        gates = [normal_gate(gains(scores, by, names[0], c), by).withColumn("candidate", F.lit(c)) for c in names[1:]]
    g = gates[0]
    for x in gates[1:]:
        g = g.unionByName(x)
    t = fits.where("n_parameters is not null").select(*by, "candidate", "complexity", "n_parameters", "train_nll", "on_boundary").join(v, [*by, "candidate"], "left").join(g, [*by, "candidate"], "left")
    mean = F.try_divide("validation_nll", F.col("n_validation") - F.col("n_unseen"))
    t = t.withColumn("validation_mean_nll", mean)
    w = Window.partitionBy(*by)
    passes = F.coalesce(F.col("resolved"), F.lit(False)) & (F.lit(family == "repeated") | ~F.col("on_boundary"))
    t = t.withColumn("passes", passes).withColumn("delta", F.col("validation_mean_nll") - F.min("validation_mean_nll").over(w))
    if family == "repeated":
        ok = lambda c: F.max(F.when(F.col("candidate") == c, F.col("passes")).otherwise(False)).over(w)
        chosen = F.when(ok(names[1]) & ok(names[2]), names[2]).when(ok(names[1]), names[1]).otherwise(names[0])
    else:
        best = F.min(F.when(F.col("delta") <= tolerance, F.struct("n_parameters", "complexity", "candidate"))).over(w)["candidate"]
        ok = F.max(F.when(F.col("candidate") == F.col("best"), F.col("passes")).otherwise(False)).over(w)
        t = t.withColumn("best", best)
        chosen = F.when(ok, F.col("best")).otherwise(F.lit(names[0]))
    t = t.withColumn("selected", F.col("candidate") == chosen)
    r = [rounded(c, 6).alias(c) for c in ("train_nll", "validation_mean_nll", "delta", "gain", "lower", "upper")]
    return t.select(*by, "candidate", "n_parameters", "on_boundary", "n_validation", "n_unseen", "n_shots", *r, "passes", "selected")


def resampled(cells: DataFrame, by: list[str], candidate: str, unit: list[str], finish, kinds: dict[str, str], replicates: int = 1000, seed: int = 20260731, units_per_task: int = 20_000) -> DataFrame:
    """(by..., kinds): ``finish`` of each group's replicates: of the candidate's names and its parameters (replicates by names, NaN where they can't be fitted).

    Units are whole shots, cycles or blocks of the train cells with Poisson weights. A group that fits in a task is weighted, fitted
    and finished there, so that replicates are never rows; of a larger one each task weights a block of units, and only its sums by
    replicate and point move.
    """
    rest = [p for p in POINT if p not in by]
    key = F.when(F.forall(F.array(*[F.col(u).isNotNull() for u in unit]), lambda x: x), F.concat_ws("|", *by, *unit))
    c = _pointed(cells.where("split = 'train'")).withColumn("_u", key)
    tasks = F.ceil(F.count_distinct("_u") / units_per_task).cast("int")
    large = c.groupBy(*by).agg(tasks.alias("_blocks")).where("_blocks > 1")
    hot = large.select(*by).limit(1).count() > 0
    large = cut(large) if hot else None
    c = c.groupBy(*by, "_u", "point", *rest).agg(F.sum("successes").cast("double").alias("s"), F.sum("trials").cast("double").alias("n"))
    out = _kinds(cells, by, kinds)

    def weighted(x: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """Points in order, and the sums by replicate and point; rows without a unit have points, but no weight."""
        x = x.sort_values("point", kind="stable")
        _, first, p = np.unique(x["point"].to_numpy(str), return_index=True, return_inverse=True)
        d = x.iloc[first][["point", *rest]].reset_index(drop=True)
        has = x["_u"].notna().to_numpy()
        units, u = np.unique(x["_u"].to_numpy()[has].astype(str), return_inverse=True)
        s, n = np.zeros((len(d), replicates)), np.zeros((len(d), replicates))
        if len(units):
            w = np.ascontiguousarray(unit_weights(units, replicates, seed).T)
            a, b, p = x["s"].to_numpy()[has], x["n"].to_numpy()[has], p[has]
            ends = np.searchsorted(p, np.arange(len(d) + 1))
            for i in range(len(d)):  # a point has cells of few of the units
                of = slice(ends[i], ends[i + 1])
                s[i], n[i] = np.stack([a[of], b[of]]) @ w[u[of]]
        return d, s.T, n.T

    def done(group: tuple, d: pd.DataFrame, s: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        got = finish(*fit_many(candidate, d, np.ascontiguousarray(s), np.ascontiguousarray(n)))
        rows = pd.DataFrame({**{k: [v] * len(got) for k, v in zip(by, group)}, **{k: got[k] for k in kinds}})
        return rows if len(rows) else rows.astype(object)  # a column without rows is one of floats, of which Arrow makes no array of strings

    def in_task(group: tuple, x: pd.DataFrame) -> pd.DataFrame:
        return done(group, *weighted(x)) if x["_u"].notna().any() else pd.DataFrame(columns=[*by, *kinds], dtype=object)

    small = _spread(c.join(large, by, "left_anti") if hot else c, by).groupBy(*by).applyInPandas(in_task, out)
    if not hot:
        return small

    def sums(group: tuple, x: pd.DataFrame) -> pd.DataFrame:
        d, s, n = weighted(x)
        return pd.DataFrame({**{k: [v] * len(d) for k, v in zip(by, group)}, **{k: d[k] for k in ("point", *rest)}, "s": [v.tobytes() for v in s.T], "n": [v.tobytes() for v in n.T]})

    def merged(group: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("point", kind="stable")
        _, first, p = np.unique(x["point"].to_numpy(str), return_index=True, return_inverse=True)
        s, n = np.zeros((len(first), replicates)), np.zeros((len(first), replicates))
        for i, a, b in zip(p, x["s"], x["n"]):
            s[i] += np.frombuffer(a)
            n[i] += np.frombuffer(b)
        return done(group, x.iloc[first][["point", *rest]].reset_index(drop=True), s.T, n.T)

    some = c.join(large, by).withColumn("_block", F.pmod(F.xxhash64("_u"), F.col("_blocks")).cast("int")).repartition(*by, "_block")
    parts = some.groupBy(*by, "_block").applyInPandas(sums, _kinds(c, by, {k: c.schema[k].dataType.simpleString() for k in ("point", *rest)} | {"s": "binary", "n": "binary"}))
    return small.unionByName(_spread(parts, by).groupBy(*by).applyInPandas(merged, out))


def resampled_parameters(cells: DataFrame, by: list[str], candidate: str, unit: list[str], replicates: int = 1000, seed: int = 20260731, units_per_task: int = 20_000) -> DataFrame:
    """(by..., replicate, parameters): the parameters of every replicate of ``resampled``, null where it can't be fitted."""

    def rows(names: list[str], v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"replicate": np.arange(len(v)), "parameters": [dict(zip(names, r)) if names and r[0] == r[0] else None for r in v.tolist()]})

    return resampled(cells, by, candidate, unit, rows, {"replicate": "int", "parameters": "map<string, double>"}, replicates, seed, units_per_task)


def resampled_values(cells: DataFrame, by: list[str], candidate: str, unit: list[str], parameter: str, **how) -> DataFrame:
    """(by..., v): one parameter of every replicate as an array, NaN where it can't be fitted."""

    def values(names: list[str], v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"v": [v[:, names.index(parameter)].tolist()] if parameter in names else []})

    return resampled(cells, by, candidate, unit, values, {"v": "array<double>"}, **how)


def resampled_intervals(cells: DataFrame, fits: DataFrame, by: list[str], candidate: str, unit: list[str], confidence: float = 0.95, most_failed: float = 0.1, **how) -> DataFrame:
    """What parameter_intervals gives for resampled_parameters; the quantiles are taken where the replicates are."""
    a = (1 - confidence) / 2

    def ends(names: list[str], v: np.ndarray) -> pd.DataFrame:
        ok = ~np.isnan(v).any(1) if names else np.zeros(len(v), bool)
        q = quantiles(v[ok], (a, 1 - a)) if ok.any() else np.zeros((2, 0))
        return pd.DataFrame({"parameter": names if ok.any() else [], "lower": q[0], "upper": q[1], "n_replicates": len(v), "n_failed": int((~ok).sum())})

    q = resampled(cells, by, candidate, unit, ends, {"parameter": "string", "lower": "double", "upper": "double", "n_replicates": "bigint", "n_failed": "bigint"}, **how)
    point = fits.where((F.col("candidate") == candidate) & F.col("parameters").isNotNull()).select(*by, F.explode("parameters").alias("parameter", "estimate"))
    ok = F.col("n_failed") <= most_failed * F.col("n_replicates")
    x = point.join(q, [*by, "parameter"])
    return x.select(*by, "parameter", rounded("estimate", 6).alias("estimate"), rounded(F.when(ok, F.col("lower")), 6).alias("lower"), rounded(F.when(ok, F.col("upper")), 6).alias("upper"), "n_replicates", "n_failed")


def resampled_bands(cells: DataFrame, by: list[str], candidate: str, unit: list[str], level: str, rate: str, times: list[float], confidence: float = 0.95, **how) -> DataFrame:
    """What bands gives for resampled_parameters; replicates times times are never rows."""
    a, t = (1 - confidence) / 2, np.array(times, float)

    def ends(names: list[str], v: np.ndarray) -> pd.DataFrame:
        q, r = (v[:, names.index(k)] if k in names else np.full(len(v), np.nan) for k in (level, rate))
        ok = ~np.isnan(q) & ~np.isnan(r)
        got = quantiles(q[ok, None] * np.exp(-r[ok, None] * t), (a, 0.5, 1 - a)) if ok.any() else np.zeros((3, 0))
        return pd.DataFrame({"t": t if ok.any() else [], "lower": got[0], "median": got[1], "upper": got[2]})

    x = resampled(cells, by, candidate, unit, ends, dict.fromkeys(("t", "lower", "median", "upper"), "double"), **how)
    return x.select(*by, "t", *[rounded(k, 6).alias(k) for k in ("lower", "median", "upper")])


def parameter_intervals(draws: DataFrame, fits: DataFrame, by: list[str], candidate: str, confidence: float = 0.95, most_failed: float = 0.1) -> DataFrame:
    """(by..., parameter, estimate, lower, upper, n_replicates, n_failed); no interval where more than a tenth of the replicates failed."""
    a = (1 - confidence) / 2
    n = draws.groupBy(*by).agg(F.count("*").alias("n_replicates"), F.count_if(F.col("parameters").isNull()).alias("n_failed"))
    q = draws.where("parameters is not null").select(*by, F.explode("parameters").alias("parameter", "v")).groupBy(*by, "parameter").agg(F.percentile("v", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    point = fits.where((F.col("candidate") == candidate) & F.col("parameters").isNotNull()).select(*by, F.explode("parameters").alias("parameter", "estimate"))
    ok = F.col("n_failed") <= most_failed * F.col("n_replicates")
    x = point.join(q, [*by, "parameter"]).join(n, by)
    return x.select(*by, "parameter", rounded("estimate", 6).alias("estimate"), rounded(F.when(ok, F.col("q")[0]), 6).alias("lower"), rounded(F.when(ok, F.col("q")[1]), 6).alias("upper"), "n_replicates", "n_failed")


def parameter_correlations(draws: DataFrame, by: list[str]) -> DataFrame:
    """(by..., a, b, r): correlation of every two parameters over the replicates."""
    e = F.transform(F.array_sort(F.map_entries("parameters")), lambda x: x)
    x = draws.where("parameters is not null").select(*by, "replicate", F.posexplode(e).alias("i", "x"), e.alias("all"))
    pairs = x.select(*by, F.col("x.key").alias("a"), F.col("x.value").alias("va"), F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
    return pairs.groupBy(*by, "a", F.col("y.key").alias("b")).agg(rounded(F.try_divide(F.covar_pop("va", "y.value"), F.stddev_pop("va") * F.stddev_pop("y.value")), 6).alias("r"))


def bands(draws: DataFrame, by: list[str], level: str, rate: str, times: list[float], confidence: float = 0.95) -> DataFrame:
    """(by..., t, lower, median, upper) of level * exp(-rate * t) over the replicates."""
    a = (1 - confidence) / 2
    p = draws.where("parameters is not null").select(*by, F.col("parameters")[level].alias("q"), F.col("parameters")[rate].alias("r")).where("q is not null and r is not null")
    x = p.select(*by, F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("t"), "q", "r").withColumn("v", F.col("q") * F.exp(-F.col("r") * F.col("t")))
    g = x.groupBy(*by, "t").agg(F.percentile("v", F.array(F.lit(a), F.lit(0.5), F.lit(1 - a))).alias("q"))
    return g.select(*by, "t", *[rounded(F.col("q")[i], 6).alias(k) for i, k in enumerate(("lower", "median", "upper"))])


def rate_ratios(bright: DataFrame, dark: DataFrame, by: list[str], horizon_s: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """(by..., ratio of the bright to the dark rate, loss in light over the horizon) with intervals; draws (by..., replicate, rate) of either side meet by replicate."""
    a = (1 - confidence) / 2
    x = bright.select(*by, "replicate", F.col("rate").alias("b")).join(dark.select(*by, "replicate", F.col("rate").alias("d")), [*by, "replicate"]).where("d > 0")
    ends = lambda v: F.percentile(v, F.array(F.lit(a), F.lit(0.5), F.lit(1 - a)))
    g = x.groupBy(*by).agg(F.count("*").alias("n_replicates"), ends(F.col("b") / F.col("d")).alias("r"), ends(1 - F.exp(-horizon_s * F.col("b"))).alias("l"))
    return g.select(*by, "n_replicates", *[rounded(F.col(c)[i], 6).alias(f"{n}_{k}") for c, n in (("r", "ratio"), ("l", "loss")) for i, k in enumerate(("lower", "median", "upper"))])


def matched_contrasts(designs: DataFrame, by: list[str], bright_rate: float, dark_rate: float, gap_s: float = 0.01, totals: tuple[float, ...] = (0.1, 0.2, 0.4)) -> DataFrame:
    """Survival at equal light: designs (by..., exposure_s, n_frames) that reach a total in whole pulses, against the one with the fewest pulses."""
    x = designs.select(*by, "exposure_s", "n_frames").distinct().withColumn("total_s", F.explode(F.array(*[F.lit(t) for t in totals])))
    x = x.withColumn("pulses", F.round(F.col("total_s") / F.col("exposure_s")).cast("int")).where((F.abs(F.col("pulses") * F.col("exposure_s") - F.col("total_s")) < 1e-9) & (F.col("pulses") >= 1) & (F.col("pulses") <= F.col("n_frames")))
    x = x.groupBy(*by, "total_s", "exposure_s", "pulses").agg(F.exp(-bright_rate * F.col("total_s") - dark_rate * gap_s * (F.col("pulses") - 1)).alias("survival"))
    base = x.groupBy(*by, "total_s").agg(F.min(F.struct("pulses", "survival")).alias("m")).select(*by, "total_s", F.col("m.survival").alias("base"))
    x = x.join(base, [*by, "total_s"])
    return x.select(*by, "total_s", "exposure_s", "pulses", rounded("survival", 9).alias("survival"), rounded(F.col("survival") - F.col("base"), 9).alias("difference"), rounded(F.col("survival") / F.col("base"), 9).alias("ratio"))


def budget_intervals(rates: DataFrame, by: list[str], n_frames: int = 5, gap_s: float = 0.01, combinations: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(by..., exposure_s, part, lower, median, upper) of the losses in light, in the gaps and by readout over independent draws.

    rates has (by..., exposure_s, bright, dark, factor): arrays of draws; combination k takes one of each by a hash of k, apart from each other.
    """
    a = (1 - confidence) / 2
    pick = lambda c, salt: F.col(c)[F.pmod(F.xxhash64(F.col("k"), F.lit(salt)), F.size(c)).cast("int")]
    x = rates.where("size(bright) > 0 and size(dark) > 0 and size(factor) > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(combinations))))
    x = x.select(*by, "exposure_s", F.exp(-pick("bright", 1) * F.col("exposure_s")).alias("b"), F.exp(-pick("dark", 2) * gap_s).alias("d"), pick("factor", 3).alias("q"))
    cycle = F.col("b") * F.col("d") * F.col("q")
    # exposures at cycle**i, gaps and readouts after them: geometric sums
    sum_ = lambda m: F.when(F.abs(1 - cycle) < 1e-12, F.lit(float(m))).otherwise((1 - F.pow(cycle, F.lit(m))) / (1 - cycle))
    parts = {"light": (1 - F.col("b")) * sum_(n_frames), "gaps": F.col("b") * (1 - F.col("d")) * sum_(n_frames - 1), "readout": F.col("b") * F.col("d") * (1 - F.col("q")) * sum_(n_frames - 1), "survival": F.pow(cycle, F.lit(n_frames - 1)) * F.col("b")}
    long = x.select(*by, "exposure_s", F.explode(F.create_map(*[y for k, v in parts.items() for y in (F.lit(k), v)])).alias("part", "v"))
    g = long.groupBy(*by, "exposure_s", "part").agg(F.percentile("v", F.array(F.lit(a), F.lit(0.5), F.lit(1 - a))).alias("q"))
    return g.select(*by, "exposure_s", "part", *[rounded(F.col("q")[i], 9).alias(k) for i, k in enumerate(("lower", "median", "upper"))])
