"""The same summary under other choices: halves of a run, endpoints of a sweep, left-out sites, other count columns, other baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded


def halves(shots: DataFrame) -> DataFrame:
    """(run_id, shot_id, half): the first half of a run's shots in order is early, the rest late."""
    w = Window.partitionBy("run_id").orderBy("shot_order", "shot_id")
    x = shots.select("run_id", "shot_id", "shot_order").withColumns({"at": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("run_id"))})
    return x.select("run_id", "shot_id", F.when(F.col("at") <= F.floor(F.col("n") / 2), "early").otherwise("late").alias("half"))


def shot_blocks(shots: DataFrame, size: int = 20) -> DataFrame:
    """(run_id, shot_id, shot_block): stretches of ``size`` shots of a run in order."""
    w = Window.partitionBy("run_id").orderBy("shot_order", "shot_id")
    return shots.select("run_id", "shot_id", F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("shot_block"))


def site_quarters(sites: DataFrame) -> DataFrame:
    """(run_id, site_id, quarter): the sites of a run in four parts by their number, 0 to 3."""
    w = Window.partitionBy("run_id")
    x = sites.select("run_id", "site_id").dropna().distinct().withColumns({"at": F.row_number().over(w.orderBy("site_id")) - 1, "n": F.count("*").over(w)})
    return x.select("run_id", "site_id", F.floor(F.col("at") * 4 / F.col("n")).cast("int").alias("quarter"))


def endpoint_variants(rows: DataFrame, by: list[str], sweep: str) -> DataFrame:
    """Rows once for each variant they belong to: all, without the least point of the sweep, without the greatest, without both."""
    ends = rows.where(F.col(sweep).isNotNull() & ~F.isnan(sweep)).groupBy(*by).agg(F.min(sweep).alias("_lo"), F.max(sweep).alias("_hi"))
    lo, hi = F.col(sweep) > F.col("_lo"), F.col(sweep) < F.col("_hi")
    names = F.filter(F.array(F.lit("all"), F.when(lo, "without least"), F.when(hi, "without greatest"), F.when(lo & hi, "without both")), lambda v: v.isNotNull())
    return rows.join(ends, by).withColumn("variant", F.explode(names)).drop("_lo", "_hi")


def weak_sites(thresholds: DataFrame, noise: DataFrame, least: float = 2.0) -> DataFrame:
    """Sites whose two levels are less than ``least`` noise widths apart: (run_id, site_id)."""
    x = thresholds.join(noise, ["run_id", "site_id", "frame_id"])
    return x.groupBy("run_id", "site_id").agg(F.min((F.col("high") - F.col("low")) / F.col("noise")).alias("apart")).where(F.col("apart") < least).select("run_id", "site_id")


def without(rows: DataFrame, sites: DataFrame) -> DataFrame:
    return rows.join(sites, ["run_id", "site_id"], "left_anti")


def relative_to_shortest(curve: DataFrame, by: list[str], sweep: str, value: str) -> DataFrame:
    """Each point of a curve minus the point of its own shortest sweep."""
    base = curve.groupBy(*by).agg(F.min(F.struct(sweep, value)).alias("b")).select(*by, F.col(f"b.{value}").alias("_base"))
    return curve.join(base, by).withColumn("change", F.col(value) - F.col("_base")).drop("_base")


def by_method(calls: dict[str, DataFrame], by: list[str], value: str) -> DataFrame:
    """Mean of a value per group under each named way of getting the rows, and its distance from the first one's."""
    first = next(iter(calls))
    parts = [df.groupBy(*by).agg(F.avg(value).alias("m"), F.count("*").alias("n_rows")).withColumn("method", F.lit(name)) for name, df in calls.items()]
    x = reduce(DataFrame.unionByName, parts)
    base = x.where(F.col("method") == first).select(*by, F.col("m").alias("m0"))
    return x.join(base, by, "left").select(*by, "method", "n_rows", rounded("m", 6).alias("estimate"), rounded(F.col("m") - F.col("m0"), 6).alias("difference"))


def spaced(shots: DataFrame, k: int = 5) -> DataFrame:
    """k shots of each run at evenly spaced ranks, both ends among them."""
    w = Window.partitionBy("run_id").orderBy("shot_order", "shot_id")
    x = shots.select("run_id", "shot_id", "shot_order").withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("run_id"))})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / (k - 1)))
    return x.where(F.array_contains(wanted, F.col("at").cast("bigint"))).select("run_id", "shot_id", F.col("at").cast("int").alias("at"))


def matched_prefixes(calls: DataFrame, timing: DataFrame, totals: list[float]) -> DataFrame:
    """Per run and matched light time: mean occupancy over shots of the last frame whose light time does not exceed it."""
    t = timing.select("run_id", "shot_id", "frame_id", F.explode(F.array(*[F.lit(x) for x in totals])).alias("total_s"), F.round("bright_s", 3).alias("b")).where("b <= total_s")
    last = t.groupBy("run_id", "shot_id", "total_s").agg(F.max("frame_id").alias("frame_id"))
    shots = calls.join(last, ["run_id", "shot_id", "frame_id"]).groupBy("run_id", "total_s", "shot_id").agg(F.avg("occupied").alias("m"))
    return shots.groupBy("run_id", "total_s").agg(F.count("*").alias("n_shots"), rounded(F.avg("m"), 6).alias("occupied"))
