"""Digests and comparisons of deliveries that don't depend on the order of rows or tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.operators.contract import KEY


def digests(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows and an order-free digest per key: the sum of the first 32 bits of each row's MD5; null and the empty text differ."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")).alias("digest"))


def repeated_deliveries(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of keys that were delivered more than once: how many, in how many loads, and in how many the copies differ, by column."""
    g = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.countDistinct("load_id").alias("loads"), *[(F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count("*")))).alias(c) for c in columns]).where("n > 1")
    s = g.agg(F.count("*").alias("n_keys"), F.count_if(F.col("loads") > 1).alias("n_over_loads"), *[F.count_if(~F.col(c)).alias(c) for c in columns])
    return s.select("n_keys", "n_over_loads", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_differ")) for c in columns])).alias("x")).select("n_keys", "n_over_loads", "x.*")


def load_audit(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """Each load's rows against the number it announced, also loads without rows."""
    n = rows.groupBy("load_id").agg(F.count("*").alias("n_rows"), F.countDistinct("run_id").alias("n_runs"))
    x = loads.select("load_id", "station", "rows_announced").join(n, "load_id", "left").fillna(0, ["n_rows", "n_runs"])
    return x.select("load_id", "station", "rows_announced", "n_rows", "n_runs", F.when(F.col("rows_announced").isNull(), "not announced").when(F.col("rows_announced") == F.col("n_rows"), "as announced").otherwise("differs").alias("verdict"))
