"""Rows of one delivery per key, and the occupancy call of each reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.operators.contract import KEY

MEASURED = ["shot_order", "condition_id", "cycle_index", "exposure_ms", "frame_elapsed_s", "roi_sum_raw", "background_global", "background_template_offset", "count_corrected_global", "count_corrected_template", "quality_flag"]


def one_delivery(rows: DataFrame, columns: list[str] = MEASURED) -> DataFrame:
    """One row per key: the copy of the least load, whole, as for the readings of problem 3; of copies within a load the one that sorts first.

    A null load comes last, and NaN after every number.
    """
    load = F.coalesce(F.col("load_id").cast("int"), F.lit(2**31 - 1)) if "load_id" in rows.columns else F.lit(0)
    first = F.min(F.struct(load.alias("_load"), *columns)).alias("x")
    return rows.groupBy(*KEY).agg(first).select(*KEY, *[F.col(f"x.{c}").alias(c) for c in columns])


def finite(c: str):
    """The value, or null where it is NaN."""
    return F.when(~F.isnan(c), F.col(c))


def site_thresholds(clean: DataFrame, value: str = "count_corrected_template") -> DataFrame:
    """(run_id, site_id, frame_id, low, high, threshold): the 10th and 90th percentile of a site's counts and their middle."""
    x = clean.select("run_id", "site_id", "frame_id", finite(value).alias("v")).where("v is not null")
    p = x.groupBy("run_id", "site_id", "frame_id").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return p.select("run_id", "site_id", "frame_id", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), ((F.col("q")[0] + F.col("q")[1]) / 2).alias("threshold"))


def occupancy_calls(clean: DataFrame, value: str = "count_corrected_template") -> DataFrame:
    """Every row with a count, called occupied when it is above its site's threshold; posterior is a logistic of the distance."""
    t = site_thresholds(clean, value)
    x = clean.withColumn("v", finite(value)).where("v is not null").join(t, ["run_id", "site_id", "frame_id"])
    steep = F.greatest((F.col("high") - F.col("low")) / 12, F.lit(1e-9))
    return x.withColumns({"occupied": (F.col("v") > F.col("threshold")).cast("int"), "posterior": 1 / (1 + F.exp(-(F.col("v") - F.col("threshold")) / steep))})
