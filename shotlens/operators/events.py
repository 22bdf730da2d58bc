"""Operators on ordered frames: events between neighbours, timing, islands of equal state, intervals and states at a time.

Windows are over the frames of one site in one shot, or over the frames or shots of one run; none is over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def interval_name(a: str, b: str) -> Column:
    return F.concat_ws("->", F.col(a).cast("string"), F.col(b).cast("string"))


def transitions(calls: DataFrame) -> DataFrame:
    """Each pair of neighbouring frames of a site: interval, call before and after."""
    w = Window.partitionBy("run_id", "shot_id", "site_id").orderBy("frame_id")
    x = calls.withColumns({"next_frame": F.lead("frame_id").over(w), "next_call": F.lead("occupied").over(w)})
    return x.where("next_frame is not null").withColumn("interval", interval_name("frame_id", "next_frame"))


def retention_events(calls: DataFrame) -> DataFrame:
    """The pairs at risk: occupied before, and whether still occupied after."""
    return transitions(calls).where("occupied = 1").withColumnRenamed("next_call", "retained")


def interval_order(interval: Column) -> list[Column]:
    """Sort keys for names such as 10->11: by number, names without numbers last."""
    a, b = F.regexp_extract(interval, r"^(\d+)->(\d+)$", 1).try_cast("int"), F.regexp_extract(interval, r"^(\d+)->(\d+)$", 2).try_cast("int")
    return [a.asc_nulls_last(), b.asc_nulls_last(), interval.asc()]


def prefix_timing(timing: DataFrame) -> DataFrame:
    """Light and dark time up to and with each frame of a shot, and the number of pulses."""
    w = Window.partitionBy("run_id", "shot_id").orderBy("frame_id")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return timing.withColumns({"bright_s": F.sum(F.coalesce("exposure_s", F.lit(0.0))).over(run), "dark_s": F.sum(F.coalesce("gap_s", F.lit(0.0))).over(run), "pulses": F.row_number().over(w)})


def islands(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Maximal stretches of equal state per key: (keys, state, first and last position, length)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumns({"_change": F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1), "_at": F.row_number().over(w)})
    x = x.withColumn("_island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(*keys, "_island").agg(F.min(state).alias(state), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), F.count("*").alias("n")).drop("_island")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float, slack: float = 0.0) -> DataFrame:
    """Segments of a and b (start_s, end_s; as a. and b.) of one key that share more than slack (zero or more).

    Time is cut into stretches of ``width``, about the length of most segments: a segment meets those of the stretches that it
    touches, not all of its key, and each pair is kept in the stretch in which the later one starts.
    """
    at = lambda c: F.floor(F.col(c) / width)
    x = a.withColumn("_at", F.explode(F.sequence(at("start_s"), F.greatest(at("start_s"), at("end_s"))))).alias("a")
    y = b.withColumn("_at", F.explode(F.sequence(at("start_s"), F.greatest(at("start_s"), at("end_s"))))).alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_at"]]
    first = F.col("a._at") == F.greatest(at("a.start_s"), at("b.start_s"))
    return x.join(y, [*same, first, F.col("a.end_s") > F.col("b.start_s") + slack, F.col("a.start_s") < F.col("b.end_s") - slack])


def state_at(times: DataFrame, states: DataFrame, keys: list[str], at: str, since: str, value: str) -> DataFrame:
    """As-of lookup: to each time the last state that began at or before it, by one union and a window instead of a range join."""
    l = times.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_asks"), F.lit(None).cast(states.schema[value].dataType).alias("_v"), F.struct(*[F.col(c) for c in times.columns]).alias("_row"))
    r = states.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_asks"), F.col(value).alias("_v"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = l.unionByName(r).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return x.where("_asks = 1").select("_row.*", F.col("_last").alias(value))
