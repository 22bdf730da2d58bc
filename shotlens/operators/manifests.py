"""Splits of shots by the plan of the experiment (not by relations): cycles in time order, and contiguous blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cycle_manifest(shots: DataFrame) -> DataFrame:
    """Whole cycles of a run in time order: the first 60 % train, the next 20 % validation, the rest test."""
    cycles = shots.where("cycle_index is not null").select("run_id", "cycle_index").distinct()
    w = Window.partitionBy("run_id").orderBy("cycle_index")  # one row per cycle
    x = cycles.withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("run_id"))})
    train, valid = F.floor(F.col("n") * 0.6), F.floor(F.col("n") * 0.2)
    split = F.when(F.col("at") < train, "train").when(F.col("at") < train + valid, "validation").otherwise("test")
    return x.select("run_id", "cycle_index", split.alias("split"))


def block_manifest(shots: DataFrame, blocks: int = 5, seats: Column | None = None) -> DataFrame:
    """Shots of a run in time order in contiguous blocks: three of five train, one validation, one test, seated from a hash of the run."""
    w = Window.partitionBy("run_id").orderBy("shot_order", "shot_id")
    x = shots.select("run_id", "shot_id", "shot_order").withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("run_id"))})
    x = x.withColumn("block", F.floor(F.col("at") * blocks / F.col("n")).cast("int"))
    turn = F.lit(0) if seats is None else seats
    seat = F.pmod(F.col("block") + turn, F.lit(blocks))
    return x.select("run_id", "shot_id", "block", F.when(seat < blocks - 2, "train").when(seat == blocks - 2, "validation").otherwise("test").alias("split"))


def attach_split(rows: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the manifest's split, shots that the manifest lacks or assigns more than once)."""
    m = manifest.groupBy("run_id", "shot_id").agg(F.min("split").alias("split"), F.countDistinct("split").alias("n"))
    shots = rows.select("run_id", "shot_id").distinct().join(m, ["run_id", "shot_id"], "left")
    trouble = shots.where("n is null or n > 1").select("run_id", "shot_id", F.when(F.col("n").isNull(), "absent").otherwise("ambiguous").alias("trouble"))
    return rows.drop("split").join(m.select("run_id", "shot_id", "split"), ["run_id", "shot_id"], "left"), trouble


def split_coverage(shots: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shots by run, condition and split: a condition that a split lacks shows a zero."""
    x = shots.select("run_id", "shot_id", "condition_id", "cycle_index").join(manifest, ["run_id", "cycle_index"])
    return x.groupBy("run_id", "condition_id").pivot("split", ["train", "validation", "test"]).agg(F.count(F.lit(1))).fillna(0)


def beside(primary: DataFrame, other: DataFrame) -> DataFrame:
    """primary with the columns of other, shot by shot; an error if either has a shot twice."""
    for name, df in (("primary", primary), ("other", other)):
        twice = df.groupBy("run_id", "shot_id").count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"shots more than once in the {name} table: {[tuple(r)[:2] for r in twice]}")
    return primary.join(other, ["run_id", "shot_id"], "left")


def replaced(rows: DataFrame, other: DataFrame, column: str = "sensitivity_split") -> DataFrame:
    """rows with the split of another plan; a shot that it lacks is unassigned."""
    return rows.drop("split").join(other.select("run_id", "shot_id", F.col(column).alias("split")), ["run_id", "shot_id"], "left").fillna("unassigned", ["split"])
