"""Smooth backgrounds over the sites of a frame: a robust polynomial surface per frame, many frames at a time.

Frames are grouped in blocks of shots of one run, so a task gets a bounded number of sites times frames, whatever the run's length,
and solves all of them together. Missing values get no weight; a frame with fewer values than coefficients has no surface.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded


def design(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    """All products of powers of x and y up to a total degree, with both scaled to [-1, 1]."""
    scale = lambda v: 2 * (v - v.min()) / max(np.ptp(v), 1e-9) - 1
    a, b = scale(x), scale(y)
    return np.stack([a**i * b**j for i in range(degree + 1) for j in range(degree + 1 - i)], axis=1)


def robust_surfaces(z: np.ndarray, basis: np.ndarray, rounds: int = 4, k: float = 1.345) -> np.ndarray:
    """Fitted values (frames by sites) of the rows of z, by least squares reweighted ``rounds`` times with Huber weights."""
    seen = ~np.isnan(z)
    v, w = np.nan_to_num(z), seen.astype(float)
    ridge = 1e-9 * np.eye(basis.shape[1])
    for _ in range(rounds + 1):
        left = np.einsum("fs,si,sj->fij", w, basis, basis) + ridge
        right = np.einsum("fs,si->fi", w * v, basis)
        fit = np.linalg.solve(left, right[..., None])[..., 0] @ basis.T
        rest = np.where(seen, v - fit, np.nan)
        with np.errstate(all="ignore"):
            mid = np.nan_to_num(np.nanmedian(rest, axis=1, keepdims=True)) if rest.size else 0.0
            sd = np.nan_to_num(1.4826 * np.nanmedian(np.abs(rest - mid), axis=1, keepdims=True)) if rest.size else 0.0
        size = np.abs(np.nan_to_num(rest))
        w = seen * np.where(size <= np.maximum(k * sd, 1e-9), 1.0, np.maximum(k * sd, 1e-9) / np.maximum(size, 1e-9))
    return fit


OUT = "run_id string, shot_id int, frame_id int, n_sites int, level double, tilt double, residual double"


def frame_surfaces(clean: DataFrame, sites: DataFrame, value: str, degree: int = 1, shots_per_task: int = 512) -> DataFrame:
    """Per run, shot and frame: sites with a value, the surface's mean, its range over the sites, and the RMS of what it leaves."""
    x = clean.select("run_id", F.col("shot_id").cast("int").alias("shot_id"), F.col("frame_id").cast("int").alias("frame_id"), F.col("site_id").cast("int").alias("site_id"), F.col(value).cast("double").alias("v"))
    x = x.join(sites.select("run_id", "site_id", "site_x", "site_y").dropDuplicates(["run_id", "site_id"]), ["run_id", "site_id"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        frames, at = np.unique(pdf[["shot_id", "frame_id"]].to_numpy(), axis=0, return_inverse=True)
        ids, first, j = np.unique(pdf["site_id"].to_numpy(), return_index=True, return_inverse=True)
        z = np.full((len(frames), len(ids)), np.nan)
        z[at.ravel(), j] = pdf["v"].to_numpy()
        basis = design(pdf["site_x"].to_numpy()[first], pdf["site_y"].to_numpy()[first], degree)
        n = (~np.isnan(z)).sum(1)
        s = robust_surfaces(z, basis)
        ok = n >= basis.shape[1]
        rest = np.where(np.isnan(z), 0.0, z - s)
        out = pd.DataFrame({"run_id": key[0], "shot_id": frames[:, 0], "frame_id": frames[:, 1], "n_sites": n, "level": s.mean(1), "tilt": np.ptp(s, axis=1), "residual": np.sqrt((rest**2).sum(1) / np.maximum(n, 1))})
        out.loc[~ok, ["level", "tilt", "residual"]] = np.nan
        return out.astype({"shot_id": "int32", "frame_id": "int32", "n_sites": "int32"})

    g = x.withColumn("block", F.floor(F.col("shot_id") / shots_per_task)).groupBy("run_id", "block").applyInPandas(fit, OUT)
    return g.select("run_id", "shot_id", "frame_id", "n_sites", *[F.when(~F.isnan(c), rounded(c, 4)).alias(c) for c in ("level", "tilt", "residual")])
