"""Bootstraps that resample complete shots or complete cycles.

A draw is a row (replicate, stratum, place, times). Draws come from a hash of replicate and slot, so they are the same on every
run and in any engine; they are joined to shot-level statistics, never to rows, and replicates are spread over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded


def spread(replicate: Column, slot: Column, stratum: Column) -> Column:
    """A well mixed number below 2**23 for each triple, in plain 64-bit arithmetic that any engine has."""
    salt = F.conv(F.substring(F.md5(stratum), 1, 7), 16, 10).cast("bigint")
    x = (replicate.cast("bigint") * 1000003 + slot.cast("bigint") * 7919 + salt) % 2147483648
    for _ in range(3):
        x = x.bitwiseXOR(F.shiftright(x, 15))
        x = (x * 1103515245 + 12345) % 2147483648
    return F.shiftright(x, 8)


def spread_numbers(replicate: np.ndarray, slot: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """spread() on arrays; salt from salt_of()."""
    x = (replicate * 1000003 + slot * 7919 + salt) & 2147483647
    for _ in range(3):
        x = x ^ (x >> 15)
        x = (x * 1103515245 + 12345) & 2147483647
    return x >> 8


def salt_of(stratum: str) -> int:
    return int(hashlib.md5(stratum.encode()).hexdigest()[:7], 16)


def times_drawn(strata: np.ndarray, units: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each unit is drawn (replicates by units), as draws() has it; units are distinct within a stratum."""
    order = np.lexsort((units, strata))
    names, first, size = np.unique(strata[order], return_index=True, return_counts=True)
    at = np.repeat(np.arange(len(names)), size)
    salt = np.array([salt_of(x) for x in names], np.int64)[at]
    out = np.zeros((len(replicates), len(units)))
    for r in range(0, len(replicates), step := max(1, 1_000_000 // len(units))):
        own = replicates[r : r + step].astype(np.int64)[:, None]
        picks = first[at] + spread_numbers(own, np.arange(len(units)) - first[at], salt) % size[at]
        out[r : r + step, order] = np.bincount((picks + np.arange(len(own))[:, None] * len(units)).ravel(), minlength=len(own) * len(units)).reshape(len(own), -1)
    return out


def draws(units: DataFrame, strata: list[str], unit: str, replicates: int) -> DataFrame:
    """(replicate, strata..., unit, times): in each stratum as many units are drawn, with replacement, as it has."""
    w = Window.partitionBy(*strata)
    placed = units.select(*strata, unit).distinct().withColumns({"place": F.row_number().over(w.orderBy(unit)) - 1, "size": F.count("*").over(w)})
    slots = placed.select(*strata, "size", F.col("place").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    picked = slots.select("replicate", *strata, (spread(F.col("replicate"), F.col("slot"), F.concat_ws("|", *strata)) % F.col("size")).cast("int").alias("place"))
    times = picked.groupBy("replicate", *strata, "place").agg(F.count("*").alias("times"))
    return times.join(placed.select(*strata, "place", unit), [*strata, "place"]).select("replicate", *strata, unit, "times")


def replicate_means(stats: DataFrame, strata: list[str], unit: str, by: list[str], value: str, replicates: int, blocks: int = 4) -> DataFrame:
    """(replicate, by..., m): the mean over the units that draws() would draw; by is a part of strata.

    Each stratum is a row with its units' values in order, one number for each unit; a replicate adds up the values that its slots
    pick. Units times replicates are never rows, and nothing but one sum for each stratum and replicate moves.
    """
    per = stats.dropna(subset=strata).groupBy(*strata, unit).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_v"), F.count("*").cast("double").alias("_c"))
    rows = per.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct(unit, "_v", "_c"))).alias("_u"))
    # the replicates of a stratum are dealt out in blocks, so that its values are copied a few times only
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*by, F.concat_ws("|", *strata).alias("_name"), F.col("_u._v").alias("_v"), F.col("_u._c").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).repartition(parts, "_name", "_block")

    def add(batches):
        for b in batches:
            for r in b.to_dict("records"):
                v, c, own = np.asarray(r["_v"]), np.asarray(r["_c"]), np.arange(1 + r["_block"], replicates + 1, blocks)
                s, n = np.zeros(len(own)), np.zeros(len(own))
                step = max(1, 4_000_000 // len(own))
                for at in range(0, len(v), step):
                    slots = np.arange(at, min(at + step, len(v)))
                    pick = spread_numbers(own[:, None], slots, salt_of(r["_name"])) % len(v)
                    s, n = s + v[pick].sum(1), n + c[pick].sum(1)
                yield pd.DataFrame({**{k: [r[k]] * len(own) for k in by}, "replicate": own, "s": s, "n": n})

    kinds = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in by)
    x = rows.mapInPandas(add, f"{kinds}, replicate int, s double, n double")
    return x.groupBy("replicate", *by).agg((F.sum("s") / F.sum("n")).alias("m"))


def bootstrap_mean(stats: DataFrame, strata: list[str], unit: str, by: list[str], value: str, replicates: int = 1000, confidence: float = 0.95) -> DataFrame:
    """Mean over units of a unit-level value, per by (a part of strata), with its percentile interval over replicates."""
    per = replicate_means(stats, strata, unit, by, value, replicates)
    a = (1 - confidence) / 2
    ends = per.groupBy(*by).agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("q"), F.count("*").alias("n_replicates"))
    point = stats.groupBy(*by).agg(F.avg(value).alias("estimate"), F.count("*").alias("n_units"))
    return point.join(ends, by).select(*by, "n_units", "n_replicates", rounded("estimate", 6).alias("estimate"), rounded(F.col("q")[0], 6).alias("lower"), rounded(F.col("q")[1], 6).alias("upper"))
