"""Sites as points: neighbours, matching between runs, annulus backgrounds from neighbouring sites.

Spatial joins go through a grid of cells as wide as the radius: a point meets the points of nine cells, never all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded


def _celled(df: DataFrame, radius: float, around: bool) -> DataFrame:
    cx, cy = F.floor(F.col("site_x") / radius), F.floor(F.col("site_y") / radius)
    if not around:
        return df.withColumns({"cx": cx, "cy": cy})
    cells = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("cell", F.explode(cells)).select(*df.columns, "cell.cx", "cell.cy")


def near_pairs(a: DataFrame, b: DataFrame, key: str, radius: float) -> DataFrame:
    """Pairs (key, a_id, b_id, distance) of points of one key within the radius."""
    x = _celled(a.select(key, F.col("site_id").alias("a_id"), "site_x", "site_y"), radius, False)
    y = _celled(b.select(key, F.col("site_id").alias("b_id"), "site_x", "site_y"), radius, True).withColumnsRenamed({"site_x": "bx", "site_y": "by"})
    d = F.sqrt(F.pow(F.col("site_x") - F.col("bx"), 2) + F.pow(F.col("site_y") - F.col("by"), 2))
    return x.join(y, [key, "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select(key, "a_id", "b_id", "distance")


def nearest_neighbours(sites: DataFrame, radius: float = 150.0) -> DataFrame:
    """For each site of a run the nearest other site within the radius and how many there are; sites without one are left out."""
    p = near_pairs(sites, sites, "run_id", radius).where("a_id <> b_id")
    return p.groupBy("run_id", F.col("a_id").alias("site_id")).agg(F.min(F.struct(rounded("distance", 6).alias("d"), "b_id")).alias("x"), F.count("*").alias("n_near")).select("run_id", "site_id", F.col("x.b_id").alias("nearest_id"), F.col("x.d").alias("distance"), "n_near")


def _against_before(sites: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs that have one of the same dataset before them, their sites, and the sites of the run before under the later run's id."""
    from pyspark.sql import Window

    order = runs.select("dataset_id", "run_id").distinct().withColumn("before", F.lag("run_id").over(Window.partitionBy("dataset_id").orderBy("run_id"))).where("before is not null")
    a = sites.join(order.select("run_id"), "run_id", "left_semi")
    b = sites.join(order.select(F.col("before").alias("run_id"), F.col("run_id").alias("later")), "run_id").select(F.col("later").alias("run_id"), "site_id", "site_x", "site_y")
    return order.select("run_id"), a, b


def unmatched(sites: DataFrame, runs: DataFrame, radius: float = 60.0) -> DataFrame:
    """(run_id, n_new, n_gone): sites without one of the run before within the radius, and sites of the run before without one of this run."""
    order, a, b = _against_before(sites, runs)
    p = near_pairs(a, b, "run_id", radius)
    new = a.join(p.select("run_id", F.col("a_id").alias("site_id")), ["run_id", "site_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("n_new"))
    gone = b.join(p.select("run_id", F.col("b_id").alias("site_id")), ["run_id", "site_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("n_gone"))
    return order.join(new, "run_id", "left").join(gone, "run_id", "left").fillna(0, ["n_new", "n_gone"])


def match_runs(sites: DataFrame, runs: DataFrame, radius: float = 60.0) -> DataFrame:
    """Sites of each run against the run of the same dataset before it: pairs that are each other's nearest within the radius, and their shift."""
    _, a, b = _against_before(sites, runs)
    p = near_pairs(a, b, "run_id", radius).withColumn("distance", rounded("distance", 6))
    to = p.groupBy("run_id", "a_id").agg(F.min(F.struct("distance", "b_id")).alias("x")).select("run_id", "a_id", F.col("x.b_id").alias("b_id"), F.col("x.distance").alias("distance"))
    fro = p.groupBy("run_id", "b_id").agg(F.min(F.struct("distance", "a_id")).alias("x")).select("run_id", "b_id", F.col("x.a_id").alias("a_id"))
    m = to.join(fro, ["run_id", "a_id", "b_id"])
    return m.groupBy("run_id").agg(F.count("*").alias("n_matched"), rounded(F.percentile("distance", 0.5), 6).alias("median_distance"), F.max("distance").alias("most_distance"))


def local_background(clean: DataFrame, sites: DataFrame, value: str, radius: float = 150.0) -> DataFrame:
    """For each reading the mean of the same frame's readings at the sites around it: (run_id, shot_id, frame_id, site_id, n_around, around)."""
    near = near_pairs(sites, sites, "run_id", radius).where("a_id <> b_id").select("run_id", F.col("a_id").alias("site_id"), "b_id")
    x = clean.select("run_id", "shot_id", "frame_id", "site_id", F.when(~F.isnan(value), F.col(value)).alias("v")).where("v is not null")
    around = x.withColumnRenamed("site_id", "b_id").join(near, ["run_id", "b_id"])
    return around.groupBy("run_id", "shot_id", "frame_id", "site_id").agg(F.count("*").alias("n_around"), rounded(F.avg("v"), 4).alias("around"))
