"""Summaries in which the independent unit is the complete shot: rows are first brought to shots, shots to groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators.shots import finite

SHOT = ["run_id", "shot_id"]


def entropy(p: Column) -> Column:
    """Binary entropy in nats, with p kept within 1e-15 of 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def r6(c: Column | str) -> Column:
    return rounded(c, 6)


def guarded_corr(n: Column, sxy: Column, sxx: Column, syy: Column) -> Column:
    """Pearson's r from centred sums, null for fewer than three pairs or a constant side."""
    return F.when((n >= 3) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))


def occupancy_summary(calls: DataFrame, by: list[str]) -> DataFrame:
    per_shot = calls.groupBy(*by, *[k for k in SHOT if k not in by]).agg(F.count("*").alias("n"), F.sum("occupied").alias("o"), F.sum("posterior").alias("p"), F.sum(entropy(F.col("posterior"))).alias("e"))
    return per_shot.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_shots"), r6(F.sum("o") / F.sum("n")).alias("mean_call"), r6(F.sum("p") / F.sum("n")).alias("mean_posterior"), r6(F.sum("e") / F.sum("n")).alias("mean_entropy"))


def transition_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    a, b = F.col("occupied"), F.col("next_call")
    return pairs.groupBy(*by, "interval").agg(
        F.count("*").alias("n_pairs"), r6(F.avg((a == b).cast("double"))).alias("agreement"), F.count_if((a == 1) & (b == 0)).alias("n_lost"), F.count_if((a == 0) & (b == 1)).alias("n_gained"),
        r6(F.try_divide(F.count_if((a == 1) & (b == 1)), F.count_if(a == 1))).alias("retention"), F.count_if(a == 1).alias("n_at_risk"),
    )


def binomial_cells(events: DataFrame, response: str, design: list[str]) -> DataFrame:
    """Successes and trials per shot and design cell: all that a binomial fit needs of the rows."""
    return events.groupBy(*SHOT, *[d for d in design if d not in SHOT]).agg(F.sum(response).alias("successes"), F.count(response).alias("trials"))


def equal_shot_curve(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean over shots of the mean within each shot, with the standard error over shots."""
    shots = rows.groupBy(*by, *[k for k in SHOT if k not in by]).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return shots.groupBy(*by).agg(F.count("m").alias("n_shots"), F.sum("n").alias("n_rows"), r6(F.avg("m")).alias("estimate"), r6(F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("std_error"))


def slopes(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x per group, with the naive standard error; null where x doesn't vary."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(y))
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    rest = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    err = F.when((F.col("n") > 2) & (F.col("sxx") > 0), F.sqrt(rest / (F.col("n") - 2) / F.col("sxx")))
    return s.select(*by, "n", r6(slope).alias("slope"), rounded(F.col("my") - slope * F.col("mx"), 4).alias("intercept"), r6(err).alias("slope_error"), r6(guarded_corr(F.col("n"), F.col("sxy"), F.col("sxx"), F.col("syy"))).alias("r"))


def shot_means(clean: DataFrame, columns: list[str]) -> DataFrame:
    """Sites averaged away: one row per run, shot and frame."""
    return clean.groupBy(*SHOT, "frame_id").agg(F.max("shot_order").alias("shot_order"), F.max("condition_id").alias("condition_id"), *[F.avg(finite(c)).alias(c) for c in columns])


def site_statistics(clean: DataFrame, value: str, background: str) -> DataFrame:
    x = clean.withColumns({"v": finite(value), "b": finite(background)})
    g = x.groupBy("run_id", "site_id", "frame_id").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.9))).alias("q"), F.avg("b").alias("mean_background"), F.count_if(F.col("quality_flag") != "ok").alias("n_flagged"),
    )
    return g.select("run_id", "site_id", "frame_id", "n", rounded("mean", 4).alias("mean"), rounded("sd", 4).alias("sd"), rounded(F.col("q")[0], 4).alias("p10"), rounded(F.col("q")[1], 4).alias("p90"), rounded(F.col("q")[1] - F.col("q")[0], 4).alias("spread"), rounded("mean_background", 4).alias("mean_background"), "n_flagged")


def heterogeneity(stats: DataFrame, sites: DataFrame) -> DataFrame:
    """Spread of the site means by run, grid and frame."""
    x = stats.join(sites.select("run_id", "site_id", "grid_id"), ["run_id", "site_id"], "left").where("mean is not null")
    g = x.groupBy("run_id", "grid_id", "frame_id").agg(F.count("*").alias("n_sites"), F.percentile("mean", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"), F.avg("mean").alias("m"), F.stddev_pop("mean").alias("s"))
    return g.select("run_id", "grid_id", "frame_id", "n_sites", *[rounded(F.col("q")[i], 3).alias(n) for i, n in enumerate(("least", "p25", "median", "p75", "most"))], r6(F.try_divide("s", F.abs("m"))).alias("variation"))


def paired_frames(clean: DataFrame, value: str, first: int = 0, second: int = 1) -> DataFrame:
    """One row per site and shot with both frames' values; a pair with a missing value is left out, a flag on either frame is kept."""
    x = clean.where(F.col("frame_id").isin(first, second)).groupBy("run_id", "shot_id", "site_id")
    pick = lambda f: F.max(F.when(F.col("frame_id") == f, finite(value)))
    return x.agg(pick(first).alias("f0"), pick(second).alias("f1"), F.max((F.coalesce("quality_flag", F.lit("")) != "ok").cast("int")).alias("any_flag")).where("f0 is not null and f1 is not null")


def agreement(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Quadrants of the paired calls per run, with the conditional rates."""
    t = lambda f, n: thresholds.where(F.col("frame_id") == f).select("run_id", "site_id", F.col("threshold").alias(n))
    x = pairs.join(t(0, "t0"), ["run_id", "site_id"]).join(t(1, "t1"), ["run_id", "site_id"])
    a, b = F.col("f0") > F.col("t0"), F.col("f1") > F.col("t1")
    return x.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"),
        r6(F.count_if(a == b) / F.count("*")).alias("agreement"), r6(F.try_divide(F.count_if(a & b), F.count_if(a))).alias("stay_rate"), r6(F.try_divide(F.count_if(~a & b), F.count_if(~a))).alias("gain_rate"), F.sum("any_flag").alias("n_flagged"),
    )


def flag_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.where("quality_flag is not null").select(*by, F.explode(F.split("quality_flag", r"\|")).alias("flag")).groupBy(*by, "flag").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int = 60, tail: float = 0.0025) -> DataFrame:
    """Density of a value in equal bins between two quantiles of its group; values outside are left out and the rest is normed."""
    x = rows.select(*by, finite(value).alias("v")).where("v is not null")
    edges = x.groupBy(*by).agg(F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail))).alias("q")).select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")).where("hi > lo")
    y = x.join(edges, by).where("v >= lo and v <= hi")
    at = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    n = y.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = F.sum("n").over(Window.partitionBy(*by))  # at most as many rows as bins
    return n.select(*by, "bin", "n", rounded(F.col("n") / (whole * (F.col("hi") - F.col("lo")) / bins), 9).alias("density"))


def js_divergence(a: DataFrame, b: DataFrame, by: list[str], cell: list[str], n: str = "n") -> DataFrame:
    """Jensen-Shannon divergence in nats between two tables of counts by cell."""
    both = a.select(*by, *cell, F.col(n).alias("x")).join(b.select(*by, *cell, F.col(n).alias("y")), [*by, *cell], "full").fillna(0, ["x", "y"])
    whole = Window.partitionBy(*by)
    p, q = F.col("x") / F.sum("x").over(whole), F.col("y") / F.sum("y").over(whole)
    z = both.select(*by, p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / F.col("m"))).otherwise(0.0)
    return z.groupBy(*by).agg(r6(F.sum(term("p") + term("q")) / 2).alias("divergence"))


def background_methods(clean: DataFrame, methods: dict[str, str]) -> DataFrame:
    """Each way of correcting the background, unpivoted: per run, frame and method the mean, spread, drift over shots and r with the background."""
    shots = shot_means(clean, [*methods.values(), "background_global"])
    long = shots.select("run_id", "shot_id", "frame_id", "shot_order", F.col("background_global").alias("b"), F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("y")) for m, c in methods.items()])).alias("x")).select("*", "x.*").drop("x")
    long = long.where("y is not null and b is not null")
    g = long.groupBy("run_id", "frame_id", "method").agg(
        F.count("*").alias("n_shots"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.regr_sxx("y", "b").alias("bxx"), F.regr_sxy("y", "b").alias("bxy"), F.regr_syy("y", "b").alias("yy"), F.regr_sxx("y", "shot_order").alias("oxx"), F.regr_sxy("y", "shot_order").alias("oxy"),
    )
    return g.select(
        "run_id", "frame_id", "method", "n_shots", rounded("mean", 4).alias("mean"), rounded("sd", 4).alias("sd"),
        r6(guarded_corr(F.col("n_shots"), F.col("bxy"), F.col("bxx"), F.col("yy"))).alias("r_background"), r6(F.when(F.col("oxx") > 0, F.col("oxy") / F.col("oxx"))).alias("drift"),
    )


def best_method(stats: DataFrame) -> DataFrame:
    """Per run the method with the least mean |r| with the background, then |drift|, then name; couplings above 0.5 are out of the running."""
    m = stats.groupBy("run_id", "method").agg(r6(F.avg(F.abs("r_background"))).alias("coupling"), r6(F.avg(F.abs("drift"))).alias("drift"), F.max(F.abs("r_background")).alias("worst"))
    ok = m.where("coupling is not null and worst <= 0.5")
    return ok.groupBy("run_id").agg(F.min(F.struct("coupling", "drift", "method")).alias("x")).select("run_id", "x.method", "x.coupling", "x.drift")


def nearest_to_median(rows: DataFrame, by: list[str], value: str, ident: str) -> DataFrame:
    """The row of each group whose value is closest to the group's median, the least id in a tie."""
    med = rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"))
    x = rows.join(med, by)
    return x.groupBy(*by).agg(F.min(F.struct(r6(F.abs(F.col(value) - F.col("median"))).alias("off"), F.col(ident))).alias("x"), F.max("median").alias("median")).select(*by, F.col(f"x.{ident}").alias(ident), F.col("x.off").alias("off"), r6("median").alias("median"))


def site_correlations(clean: DataFrame, value: str, frame: int = 0) -> DataFrame:
    """Pearson's r between neighbouring sites of a grid row, over the shots of a run: (run_id, site_id, right_id, n, r)."""
    w = Window.partitionBy("run_id", "shot_id", "frame_id", "grid_id", "site_row").orderBy("site_col")  # one row of a grid
    x = clean.where(F.col("frame_id") == frame).withColumn("v", finite(value))
    x = x.withColumns({"right_id": F.lead("site_id").over(w), "right_col": F.lead("site_col").over(w), "u": F.lead("v").over(w)}).where("right_col = site_col + 1 and v is not null and u is not null")
    g = x.groupBy("run_id", "site_id", "right_id").agg(F.count("*").alias("n"), F.regr_sxx("v", "u").alias("sxx"), F.regr_sxy("v", "u").alias("sxy"), F.regr_syy("v", "u").alias("syy"))
    return g.select("run_id", "site_id", "right_id", "n", r6(guarded_corr(F.col("n"), F.col("sxy"), F.col("sxx"), F.col("syy"))).alias("r"))


def grid_correlations(rows: DataFrame, by: list[str], value: str, shots_per_task: int = 4096) -> DataFrame:
    """(by..., n_pairs, median, p95) of Pearson's r between all sites of a group over its shots, without a row for any pair of readings.

    Each block of shots becomes a matrix of shots by sites, and gives the sums of its products; the sums, as large as the number
    of sites of a group squared, are added up. Pairs of sites with fewer than three shots in common or a constant side have no r.
    """
    import numpy as np
    import pandas as pd

    x = rows.select(*by, "shot_id", "site_id", F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    x = x.withColumn("block", F.floor(F.col("shot_id") / shots_per_task))
    kinds = ", ".join(f"{b} {rows.schema[b].dataType.simpleString()}" for b in by)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        sites, j = np.unique(pdf["site_id"].to_numpy(), return_inverse=True)
        shots, i = np.unique(pdf["shot_id"].to_numpy(), return_inverse=True)
        v, ok = np.zeros((len(shots), len(sites))), np.zeros((len(shots), len(sites)))
        v[i, j], ok[i, j] = pdf["v"].to_numpy(), 1.0
        a, b = np.triu_indices(len(sites), 1)
        m = {"n": ok.T @ ok, "sx": v.T @ ok, "sxx": (v * v).T @ ok, "sxy": v.T @ v}
        out = {k: [pdf[k].iloc[0]] * len(a) for k in by} | {"a": sites[a], "b": sites[b]}
        out |= {"n": m["n"][a, b], "sx": m["sx"][a, b], "sy": m["sx"][b, a], "sxx": m["sxx"][a, b], "syy": m["sxx"][b, a], "sxy": m["sxy"][a, b]}
        return pd.DataFrame(out)

    parts = x.groupBy(*by, "block").applyInPandas(products, f"{kinds}, a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    p = parts.groupBy(*by, "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).where("n >= 3")
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    some = lambda v, s: v > 1e-12 * F.greatest(s, F.lit(1e-300))
    r = p.where(some(vx, F.col("sxx")) & some(vy, F.col("syy"))).select(*by, ((F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)).alias("r"))
    q = r.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.percentile("r", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.select(*by, "n_pairs", rounded(F.col("q")[0], 4).alias("median"), rounded(F.col("q")[1], 4).alias("p95"))
