"""Structures of the counts: which levels a run's frames and sites share, fitted on training shots and ranked on validation shots.

* global: two levels per run; frame: two levels per run and frame; site: two levels per run and site (diagnosis only)
* offsets: a shift per frame, then two levels per run; the shift is the middle of the frame's two levels against the run's mean
* shrunk_K: the shifts per frame and one per site, the mean of what the levels leave at the site, shrunk by n / (n + K)
* raw: two levels per run of the raw sums (another scale, so for comparison only)

Fits go through ``mixture.fit_mixtures``: aggregates to a group's values or bins, groups in parallel. Structures that need the
same fit share it, and all strengths of shrinkage are fitted in one pass. Models are tables of parameters, joined to rows.

Defined results: rows without a finite value are not scored; a frame that training doesn't have has no model, a site that it
doesn't have has shift 0; a site with fewer than ``least_rows`` training rows has the run's levels; groups that can't be fitted have no
model, so their rows have none; ties in the ranking go by name; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators.mixture import fit_mixtures, log_normal, log_sum
from shotlens.operators.shots import finite
from shotlens.operators.summaries import entropy
from shotlens.session import cut

STRENGTHS = (5, 10, 20, 50, 100)
LEVELS = ["weight", "mean0", "mean1", "sd0", "sd1"]
#: Structures that may not be chosen.
DIAGNOSTIC = ("raw", "site")


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def mixture_cdf(x: float, weight: float, mean0: float, mean1: float, sd0: float, sd1: float) -> float:
    return (1 - weight) * normal_cdf((x - mean0) / sd0) + weight * normal_cdf((x - mean1) / sd1)


def mixture_quantile(p: float, *levels: float) -> float:
    """Where the mixture's distribution function reaches p, by bisection."""
    _, m0, m1, s0, s1 = levels
    lo, hi = min(m0 - 12 * s0, m1 - 12 * s1), max(m0 + 12 * s0, m1 + 12 * s1)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mixture_cdf(mid, *levels) < p else (lo, mid)
    return (lo + hi) / 2


def crossing(weight: float, mean0: float, mean1: float, sd0: float, sd1: float) -> float:
    """Where both levels are equally likely, between the means if there is such a point, else at the mean on whose far side it lies."""
    gap = lambda x: math.log(max(weight, 1e-300)) - math.log(sd1) - 0.5 * ((x - mean1) / sd1) ** 2 - math.log(max(1 - weight, 1e-300)) + math.log(sd0) + 0.5 * ((x - mean0) / sd0) ** 2
    if gap(mean0) >= 0 or gap(mean1) <= 0:
        return mean0 if gap(mean0) >= 0 else mean1
    lo, hi = mean0, mean1
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def overlap(mean0: float, mean1: float, sd0: float, sd1: float, points: int = 4001) -> float:
    """Half of the area that both densities cover, at most 0.5."""
    x = np.linspace(min(mean0 - 8 * sd0, mean1 - 8 * sd1), max(mean0 + 8 * sd0, mean1 + 8 * sd1), points)
    f = lambda m, s: np.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi))
    return float(min(0.5, 0.5 * np.minimum(f(mean0, sd0), f(mean1, sd1)).sum() * (x[1] - x[0])))


def described(params: DataFrame) -> DataFrame:
    """Parameters (a row for each group) with separation, overlap, threshold and the central 99 % of the mixture."""

    def add(batches):
        for b in batches:
            rows = b[LEVELS].to_numpy(float).tolist()
            b["separation"] = [(r[2] - r[1]) / math.sqrt((r[3] ** 2 + r[4] ** 2) / 2) for r in rows]
            b["overlap"] = [overlap(*r[1:]) for r in rows]
            b["threshold"] = [crossing(*r) for r in rows]
            b["central_low"], b["central_high"] = [mixture_quantile(0.005, *r) for r in rows], [mixture_quantile(0.995, *r) for r in rows]
            yield b

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in params.schema.fields)
    return params.mapInPandas(add, f"{kinds}, separation double, overlap double, threshold double, central_low double, central_high double")


def mean_of_levels(v: Column) -> Column:
    """The mean of the level at v's side, weighted by the posterior, from the columns of a joined model."""
    l0, l1 = F.ln(1 - F.col("weight")) + log_normal(v, F.col("mean0"), F.col("sd0")), F.ln("weight") + log_normal(v, F.col("mean1"), F.col("sd1"))
    p = 1 / (1 + F.exp(F.least(l0 - l1, F.lit(700.0))))
    return (1 - p) * F.col("mean0") + p * F.col("mean1")


class Structures:
    """All structures of each run, from training rows (run_id, site_id, frame_id, value, raw). A structure is fitted when it is asked for first."""

    def __init__(self, train: DataFrame, value: str, raw: str | None = None, strengths: tuple[int, ...] = STRENGTHS, least_rows: int = 20):
        self.rows = cut(train.select("run_id", "site_id", "frame_id", finite(value).alias("v"), (finite(raw) if raw else F.lit(None).cast("double")).alias("raw")))
        self.strengths, self.least_rows = strengths, least_rows

    def levels(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return fit_mixtures(rows, by, "v").select(*by, "n", *LEVELS)

    @cached_property
    def whole(self) -> DataFrame:
        plain = self.rows.select("run_id", F.lit("global").alias("structure"), "v").unionByName(self.rows.select("run_id", F.lit("raw").alias("structure"), F.col("raw").alias("v")))
        return cut(self.levels(plain, ["run_id", "structure"]))

    @cached_property
    def frames(self) -> DataFrame:
        return cut(self.levels(self.rows, ["run_id", "frame_id"]))

    @cached_property
    def sites(self) -> DataFrame:
        return cut(self.levels(self.rows, ["run_id", "site_id"]).where(f"n >= {self.least_rows}"))

    @cached_property
    def frame_shifts(self) -> DataFrame:
        middle = (F.col("mean0") + F.col("mean1")) / 2
        run = Window.partitionBy("run_id")  # as many rows as a run has frames
        reference = F.sum(middle * F.col("n")).over(run) / F.sum("n").over(run)
        return cut(self.frames.select("run_id", "frame_id", (middle - reference).alias("frame_shift")))

    @property
    def unshifted(self) -> DataFrame:
        return self.rows.join(self.frame_shifts, ["run_id", "frame_id"]).select("run_id", "site_id", "frame_id", (F.col("v") - F.col("frame_shift")).alias("v")).where("v is not null")

    @cached_property
    def shared(self) -> DataFrame:
        return cut(self.levels(self.unshifted, ["run_id"]))

    @cached_property
    def site_shifts(self) -> DataFrame:
        left = self.unshifted.join(self.shared.drop("n"), "run_id").groupBy("run_id", "site_id").agg(F.count("*").alias("n"), F.avg(F.col("v") - mean_of_levels(F.col("v"))).alias("residual"))
        k = F.explode(F.array(*[F.lit(int(s)) for s in self.strengths])).alias("strength")
        return cut(left.select("run_id", "site_id", "n", "residual", k).select("run_id", "site_id", "strength", (F.col("n") / (F.col("n") + F.col("strength")) * F.col("residual")).alias("site_shift")))

    @cached_property
    def shrunk(self) -> DataFrame:
        z = self.unshifted.join(self.site_shifts, ["run_id", "site_id"]).select("run_id", "strength", (F.col("v") - F.col("site_shift")).alias("v"))
        return cut(self.levels(z, ["run_id", "strength"]))

    def adjusted(self, rows: DataFrame, value: str, raw: str | None = None, only_shrunk: bool = False) -> DataFrame:
        """rows once for each structure (or each strength of shrinkage only) that has a model for them: structure, v on the model's scale, and the model's levels."""
        keep = [c for c in rows.columns if c not in ("v", "structure", "n", "strength", "shifts", "frame_shift", *LEVELS)]  # columns of these names are given up
        base = rows.select(*keep, finite(value).alias("_v"), (finite(raw) if raw else F.lit(None).cast("double")).alias("_raw"))
        w = lambda name: self.whole.where(F.col("structure") == name).drop("structure", "n")
        shifted = base.join(self.frame_shifts, ["run_id", "frame_id"])
        cols = [*keep, "structure", "v", *LEVELS]
        per = self.site_shifts.groupBy("run_id", "site_id").agg(F.map_from_entries(F.collect_list(F.struct("strength", "site_shift"))).alias("shifts"))  # a few strengths
        s = shifted.join(per, ["run_id", "site_id"], "left").join(self.shrunk.drop("n"), "run_id")
        s = s.withColumns({"structure": F.concat(F.lit("shrunk_"), F.col("strength").cast("string")), "v": F.col("_v") - F.col("frame_shift") - F.coalesce(F.col("shifts")[F.col("strength")], F.lit(0.0))})
        if only_shrunk:
            return s.select(*cols).where("v is not null")
        out = [
            base.join(w("global"), "run_id").withColumns({"structure": F.lit("global"), "v": F.col("_v")}),
            base.join(self.frames.drop("n"), ["run_id", "frame_id"]).withColumns({"structure": F.lit("frame"), "v": F.col("_v")}),
            shifted.join(self.shared.drop("n"), "run_id").withColumns({"structure": F.lit("offsets"), "v": F.col("_v") - F.col("frame_shift")}),
        ]
        own = [F.coalesce(F.col(f"s.{c}"), F.col(f"g.{c}")).alias(c) for c in LEVELS]
        out.append(base.alias("b").join(w("global").alias("g"), "run_id").join(self.sites.drop("n").alias("s"), ["run_id", "site_id"], "left").select(*[F.col(f"b.{c}") for c in keep if c not in ("run_id", "site_id")], "run_id", "site_id", F.lit("site").alias("structure"), F.col("b._v").alias("v"), *own))
        if raw:
            out.append(base.join(w("raw"), "run_id").withColumns({"structure": F.lit("raw"), "v": F.col("_raw")}))
        return reduce(DataFrame.unionByName, [o.select(*cols) for o in [*out, s]]).where("v is not null")


def densities(adjusted: DataFrame) -> DataFrame:
    """log_density, posterior of the brighter level, call, and the distance to the nearer level in its sds."""
    v = F.col("v")
    l0, l1 = F.ln(1 - F.col("weight")) + log_normal(v, F.col("mean0"), F.col("sd0")), F.ln("weight") + log_normal(v, F.col("mean1"), F.col("sd1"))
    x = adjusted.withColumns({"l0": l0, "l1": l1}).withColumn("log_density", log_sum(F.col("l0"), F.col("l1")))
    near = F.least(F.abs((v - F.col("mean0")) / F.col("sd0")), F.abs((v - F.col("mean1")) / F.col("sd1")))
    x = x.withColumns({"posterior": F.exp(F.col("l1") - F.col("log_density")), "nearest": near})
    return x.withColumn("occupied", (F.col("posterior") >= 0.5).cast("int")).drop("l0", "l1")


def ranking(scored: DataFrame, by: list[str]) -> DataFrame:
    """Mean negative log density of each structure; the best that may be chosen is selected, by name in a tie."""
    x = scored.groupBy(*by, "structure").agg(F.count("*").alias("n"), (-F.avg("log_density")).alias("nll")).withColumn("eligible", ~F.col("structure").isin(*DIAGNOSTIC))
    w = Window.partitionBy(*by)
    best = F.min(F.when(F.col("eligible"), F.struct(F.round("nll", 9).alias("a"), "structure"))).over(w)["structure"]
    lowest = F.min(F.when(F.col("eligible"), F.col("nll"))).over(w)
    return x.select(*by, "structure", "n", rounded("nll", 6).alias("nll"), rounded(F.col("nll") - lowest, 6).alias("delta"), "eligible", (F.col("structure") == best).alias("selected"))


def residual_diagnostics(scored: DataFrame, by: list[str], ambiguous: tuple[float, float] = (0.1, 0.9), far: float = 4.0, most_ambiguous: float = 0.05, most_far: float = 0.02) -> DataFrame:
    """Per group and frame: shares of rows between the levels and far from both, mean entropy; and whether a group asks for another level or heavier tails."""
    p = F.col("posterior")
    x = scored.groupBy(*by, "frame_id").agg(F.count("*").alias("n"), F.avg(((p > ambiguous[0]) & (p < ambiguous[1])).cast("double")).alias("ambiguous"), F.avg((F.col("nearest") > far).cast("double")).alias("far"), F.avg(entropy(p)).alias("entropy"))
    w = Window.partitionBy(*by)
    return x.select(*by, "frame_id", "n", *[rounded(c, 6).alias(c) for c in ("ambiguous", "far", "entropy")], (F.max("ambiguous").over(w) >= most_ambiguous).alias("another_level"), (F.max("far").over(w) >= most_far).alias("heavier_tails"))


def weak_sites(params: DataFrame, least_separation: float = 2.0, most_overlap: float = 0.1) -> DataFrame:
    """Described levels of sites with a flag for those that can't be told apart."""
    return params.withColumn("weak", (F.col("separation") < least_separation) | (F.col("overlap") > most_overlap))


def distribution_audit(scored: DataFrame, by: list[str], bins: int = 60) -> DataFrame:
    """How far the distribution of v is from its model's, per group: histogram over the central 99.5 %, modes, valley between the levels, tails.

    All rows of a group have the same model. Histogram and sums are aggregates; the densities are those at the middles of the bins.
    """
    p = described(scored.groupBy(*by).agg(*[F.first(c).alias(c) for c in LEVELS]))
    ends = scored.groupBy(*by).agg(F.percentile_approx("v", F.array(F.lit(0.0025), F.lit(0.9975)), F.lit(10_000)).alias("q"), F.count("*").alias("n_rows"))
    g = cut(ends.join(p, by).withColumns({"lo": F.col("q")[0], "width": (F.col("q")[1] - F.col("q")[0]) / bins}).where("width > 0").drop("q"))
    x = scored.drop(*LEVELS).join(g, by)
    tails = x.groupBy(*by).agg(F.avg(((F.col("v") < F.col("central_low")) | (F.col("v") > F.col("central_high"))).cast("double")).alias("tail_mass"), *[F.stddev_pop(F.when(F.col("occupied") == k, F.col("v"))).alias(f"sd_{k}") for k in (0, 1)])
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    h = x.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("lo") + bins * F.col("width"))).groupBy(*by, at.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    grid = g.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(h, [*by, "bin"], "left").fillna(0, ["c"])
    inside = F.sum("c").over(Window.partitionBy(*by))
    mid = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    d = grid.withColumns({"mid": mid, "p": F.col("c") / F.greatest(inside, F.lit(1))})
    part = lambda w, m, s: F.ln(w) + log_normal(F.col("mid"), F.col(m), F.col(s))
    d = d.withColumns({"f0": part(1 - F.col("weight"), "mean0", "sd0"), "f1": part(F.col("weight"), "mean1", "sd1")})
    d = d.withColumn("log_f", F.coalesce(log_sum(F.col("f0"), F.col("f1")), "f0", "f1"))
    # densities far from both levels are too small for a double, their logarithms aren't
    w = Window.partitionBy(*by)
    d = d.withColumns({"f": F.exp("log_f") * F.col("width"), "e": F.exp(F.col("log_f") - F.max("log_f").over(w))})
    d = d.withColumn("q", F.col("e") / F.sum("e").over(w))
    # the mean of both shares isn't formed: half of the least double is zero
    kl = lambda a: F.when(F.col(a) > 0, F.col(a) * F.ln(2 * F.col(a) / (F.col("p") + F.col("q")))).otherwise(0.0)
    third = (F.col("mean1") - F.col("mean0")) / 3
    valley = (F.col("mid") >= F.col("mean0") + third) & (F.col("mid") <= F.col("mean1") - third)
    top = lambda c, where=None: F.max(F.struct(c if where is None else F.when(where, F.col(c)), (-F.col("mid")).alias("m")))["m"]
    a = d.groupBy(*by).agg(
        F.sum("f").alias("model_mass"), F.sum(F.abs(F.col("p") - F.col("f"))).alias("absolute_error"), (F.sum(kl("p") + kl("q")) / 2).alias("divergence"),
        (-top("c")).alias("mode"), (-top("log_f")).alias("model_mode"), F.sum(F.when(valley, F.col("p")).otherwise(0)).alias("valley"), F.sum(F.when(valley, F.col("f")).otherwise(0)).alias("model_valley"),
    )
    out = a.join(tails, by).join(g.select(*by, "n_rows", "sd0", "sd1"), by)
    r = [rounded(c, 6).alias(c) for c in ("model_mass", "absolute_error", "divergence", "mode", "model_mode", "valley", "model_valley", "tail_mass")]
    return out.select(*by, "n_rows", *r, rounded(F.try_divide("sd_0", "sd0"), 6).alias("sd0_ratio"), rounded(F.try_divide("sd_1", "sd1"), 6).alias("sd1_ratio"))


def density_bands(rows: DataFrame, by: list[str], value: str, bins: int = 60, replicates: int = 400, seed: int = 20260731, units_per_task: int = 20_000, confidence: float = 0.95, values_per_task: int = 4_000_000) -> DataFrame:
    """(by..., bin, density, lower, upper): the histogram's density with the band of a Poisson bootstrap over whole shots.

    A shot's values are one array. A group that fits in a task is counted, resampled and summed up there; of a larger one each
    task counts a block of shots, and only its sums by replicate and bin move.
    """
    from shotlens.operators.retention import quantiles, unit_weights

    unit = F.concat_ws("|", "run_id", "shot_id").alias("_u")
    x = rows.select(*by, unit, finite(value).alias("v")).where("v is not null")
    shots = cut(x.groupBy(*by, "_u").agg(F.collect_list("v").alias("v")))
    tasks = F.greatest(F.ceil(F.count("*") / units_per_task), F.ceil(F.sum(F.size("v")) / values_per_task)).cast("int")
    large = cut(shots.groupBy(*by).agg(tasks.alias("_blocks")).where("_blocks > 1"))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in by)
    out = f"{kinds}, width double, bin int, s double, lower double, upper double"
    a = (1 - confidence) / 2

    def counted(pdf: pd.DataFrame, lo: float, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Counts by bin, and by replicate and bin."""
        v = np.concatenate(pdf["v"].to_list())
        u = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["v"]])
        ok = (v >= lo) & ~(v > lo + bins * width)
        at = np.minimum(np.nan_to_num(np.floor((v[ok] - lo) / width)), bins - 1).astype(int)
        h = np.bincount(u[ok] * bins + at, minlength=len(pdf) * bins).reshape(len(pdf), bins).astype(float)
        return h.sum(0), unit_weights(pdf["_u"].to_numpy(str), replicates, seed) @ h

    def bands(key: tuple, width: float, whole: np.ndarray, h: np.ndarray) -> pd.DataFrame:
        total = h.sum(1)
        some = total > 0
        q = quantiles(h[some] / total[some, None], (a, 1 - a)) if some.any() else np.zeros((2, bins))
        return pd.DataFrame({**{k: [v] * bins for k, v in zip(by, key)}, "width": width, "bin": np.arange(bins), "s": whole / max(whole.sum(), 1), "lower": q[0], "upper": q[1]})

    def in_task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(np.concatenate(pdf["v"].to_list()))
        # as percentile_approx has them: the values of these ranks
        lo, hi = (float(v[max(int(np.ceil(p * len(v))), 1) - 1]) for p in (0.0025, 0.9975))
        width = (hi - lo) / bins
        return bands(key, width, *counted(pdf, lo, width)) if width > 0 else pd.DataFrame(columns=[*by, "width", "bin", "s", "lower", "upper"])

    small = shots.join(large, by, "left_anti").groupBy(*by).applyInPandas(in_task, out)
    some = shots.join(large, by)
    e = some.select(*by, F.explode("v").alias("v")).groupBy(*by).agg(F.percentile_approx("v", F.array(F.lit(0.0025), F.lit(0.9975)), F.lit(10_000)).alias("q"))
    e = e.select(*by, F.col("q")[0].alias("lo"), ((F.col("q")[1] - F.col("q")[0]) / bins).alias("width")).where("width > 0")

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole, h = counted(pdf, pdf["lo"].iloc[0], pdf["width"].iloc[0])
        return pd.DataFrame([[*key[:-1], pdf["width"].iloc[0], whole.tobytes(), h.tobytes()]], columns=[*by, "width", "whole", "h"])

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole, h = (sum(np.frombuffer(x) for x in pdf[c]) for c in ("whole", "h"))
        return bands(key, pdf["width"].iloc[0], whole, h.reshape(replicates, bins))

    some = some.join(e, by).withColumn("_block", F.pmod(F.xxhash64("_u"), F.col("_blocks")).cast("int")).repartition(*by, "_block")
    parts = some.groupBy(*by, "_block").applyInPandas(sums, f"{kinds}, width double, whole binary, h binary")
    x = small.unionByName(parts.groupBy(*by).applyInPandas(merged, out))
    return x.select(*by, "bin", *[rounded(F.col(v) / F.col("width"), 9).alias(n) for n, v in (("density", "s"), ("lower", "lower"), ("upper", "upper"))])
