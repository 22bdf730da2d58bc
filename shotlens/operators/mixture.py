"""Two-level Gaussian mixtures of the counts, one per group, fitted to all rows by expectation maximisation.

The counts of a group of up to EXACT rows are fitted as they are. Those of larger groups are first put into bins by an aggregate: steps of
a two hundredth of the distance of the quartiles up to 10 such distances from the middle, beyond that steps of half a per cent of the
distance, without an end. A bin keeps count, sum and sum of squares, so means and variances of the M-step and the floor of the sd
lose nothing within a bin; only the weight of a row between the levels is that of its bin's mean. Groups are fitted in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators.shots import finite
from shotlens.session import cut

ROOT_2PI = 2.5066282746310002
EXACT = 20_000


def log_normal(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - F.ln(sd) - F.lit(0.9189385332046727)


def log_sum(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def expectation_maximisation(v: np.ndarray, c: np.ndarray, starts: list[tuple[float, float]], floor: float, within: np.ndarray | float = 0.0, least_weight: float = 0.02, rounds: int = 500, tolerance: float = 1e-8) -> tuple[float, ...]:
    """The best of several starts on values v with counts c and variances within each value's bin: (weight, mean0, mean1, sd0, sd1, log-likelihood), the second component the brighter."""
    n = c.sum()
    mean = (c * v).sum() / n
    spread = max(float(np.sqrt((c * ((v - mean) ** 2 + within)).sum() / n)), floor)
    m = np.array(starts, float)  # all starts in one array; those that have settled stay as they are
    w, s, last, ll = np.full(len(m), 0.5), np.full(m.shape, spread / 2), np.full(len(m), -np.inf), np.full(len(m), -np.inf)
    going = np.arange(len(m))
    for _ in range(rounds):
        square = [(v - m[going, k, None]) ** 2 + within for k in (0, 1)]
        l0, l1 = (np.log(x)[:, None] - 0.5 * q / s[going, k, None] ** 2 - np.log(s[going, k, None] * ROOT_2PI) for k, x, q in zip((0, 1), (1 - w[going], w[going]), square))
        apart = l1 - l0
        e = np.exp(-np.abs(apart))
        ll[going] = (c * (np.maximum(l0, l1) + np.log1p(e))).sum(1)
        more = ll[going] - last[going] > tolerance * np.abs(ll[going])
        going = going[more]
        if not len(going):
            break
        last[going], r = ll[going], c * (np.where(apart >= 0, 1.0, e) / (1 + e))[more]
        for k, part in ((1, r), (0, c - r)):
            total = np.maximum(part.sum(1), 1e-9)
            m[going, k] = (part * v).sum(1) / total
            s[going, k] = np.maximum(np.sqrt((part * ((v - m[going, k, None]) ** 2 + within)).sum(1) / total), floor)
        w[going] = np.clip(np.maximum(r.sum(1), 1e-9) / n, least_weight, 1 - least_weight)
    k = int(ll.argmax())
    best = (w[k], m[k, 0], m[k, 1], s[k, 0], s[k, 1], ll[k]) if m[k, 0] <= m[k, 1] else (1 - w[k], m[k, 1], m[k, 0], s[k, 1], s[k, 0], ll[k])
    return tuple(float(x) for x in best)


def fit_mixtures(rows: DataFrame, by: list[str], value: str, bins: int = 200, exact: int = EXACT) -> DataFrame:
    """(by..., n, weight, mean0, mean1, sd0, sd1, log_likelihood); component 1 is the brighter one. Groups of fewer than 8 values or only one are left out."""
    x = rows.select(*by, finite(value).alias("v")).where("v is not null")
    q = F.percentile_approx("v", F.array(*[F.lit(p) for p in (0.005, 0.25, 0.75, 0.995)]), F.lit(10_000))
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("v").alias("s"), q.alias("q")).where("n >= 8 and s > 0")
    g = cut(g.select(*by, "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("a"), F.col("q")[2].alias("b"), F.col("q")[3].alias("hi"), "s"))
    # where the quartiles coincide the sd gives the step
    wide, middle = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(F.col("s")), (F.col("a") + F.col("b")) / 2
    x = x.join(g, by).withColumn("d", (F.col("v") - middle) / wide)
    far = F.signum("d") * (10 * bins + 1 + F.floor(F.ln(F.greatest(F.abs("d"), F.lit(10.0)) / 10) * 200))
    at = F.when(F.col("n") <= exact, F.col("v")).otherwise(F.when(F.abs("d") < 10, F.floor(F.col("d") * bins)).otherwise(far).cast("double"))
    grid = x.groupBy(*by, "lo", "a", "b", "hi", at.alias("bin")).agg(F.avg("v").alias("v"), F.count("*").alias("c"), F.var_pop("v").alias("within"))
    kinds = ", ".join(f"{b} {rows.schema[b].dataType.simpleString()}" for b in by)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        v, c, within = (pdf[k].to_numpy(float) for k in ("v", "c", "within"))
        lo, a, b, hi = (float(pdf[k].iloc[0]) for k in ("lo", "a", "b", "hi"))
        sd = float(np.sqrt((c * ((v - (c * v).sum() / c.sum()) ** 2 + within)).sum() / c.sum()))
        starts = [(a, b), (lo, hi), (a, hi), (lo, b), ((lo + a) / 2, (b + hi) / 2)]
        out = expectation_maximisation(v, c, starts, max(1e-9, 0.02 * sd), within)
        return pd.DataFrame([[*key, int(c.sum()), *out]], columns=[*by, "n", "weight", "mean0", "mean1", "sd0", "sd1", "log_likelihood"])

    return grid.groupBy(*by).applyInPandas(fit, f"{kinds}, n bigint, weight double, mean0 double, mean1 double, sd0 double, sd1 double, log_likelihood double")


def score(rows: DataFrame, params: DataFrame, by: list[str], value: str) -> DataFrame:
    """log_density, posterior of the brighter component, call and separation of every row with a value and a model."""
    x = rows.withColumn("v", finite(value)).where("v is not null").join(params.select(*by, "weight", "mean0", "mean1", "sd0", "sd1"), by)
    l0 = F.ln(1 - F.col("weight")) + log_normal(F.col("v"), F.col("mean0"), F.col("sd0"))
    l1 = F.ln("weight") + log_normal(F.col("v"), F.col("mean1"), F.col("sd1"))
    x = x.withColumns({"l0": l0, "l1": l1}).withColumn("log_density", log_sum(F.col("l0"), F.col("l1")))
    x = x.withColumn("posterior", F.exp(F.col("l1") - F.col("log_density")))
    apart = (F.col("mean1") - F.col("mean0")) / F.sqrt((F.col("sd0") * F.col("sd0") + F.col("sd1") * F.col("sd1")) / 2)
    return x.withColumns({"occupied": (F.col("posterior") >= 0.5).cast("int"), "separation": apart}).drop("l0", "l1")


def rank_models(scored: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Mean negative log density of each named model on the same held-out rows, best first, names in ties."""
    from functools import reduce

    from pyspark.sql import Window

    parts = [df.groupBy(*by).agg(F.count("*").alias("n"), (-F.avg("log_density")).alias("nll")).withColumn("model", F.lit(name)) for name, df in scored.items()]
    x = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy(*by)
    return x.select(*by, "model", "n", rounded("nll", 6).alias("nll"), rounded(F.col("nll") - F.min("nll").over(w), 6).alias("delta"), F.row_number().over(w.orderBy("nll", "model")).alias("rank"))
