"""Writing and reading a checked data set: a table that breaks the contract is not written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.operators.contract import coerce, columns_for, raise_if_broken, violations
from shotlens.operators.provenance import digests
from shotlens.session import cut


def write_checked(df: DataFrame, folder: str, version: str, allowed: frozenset[str] = frozenset(), by: str = "run_id", shots_per_file: int = 4096) -> None:
    """Parquet by run, with a manifest of rows and digests per run beside it; raises before anything is written if a check fails that isn't allowed."""
    table = cut(coerce(df, version))
    raise_if_broken(violations(table), set(allowed))
    # a run of many shots is several tasks and files
    table.repartition(by, F.floor(F.col("shot_id") / shots_per_file)).sortWithinPartitions(by, "shot_id", "frame_id", "site_id").write.mode("error").partitionBy(by).parquet(f"{folder}/frame_sites")
    names = [c for c in columns_for(version).names if c in table.columns]
    digests(table, [by], names).write.mode("error").json(f"{folder}/manifest")


def read_checked(spark: SparkSession, folder: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(table, runs whose rows or digest aren't those of the manifest)."""
    table = spark.read.parquet(f"{folder}/frame_sites").withColumn("run_id", F.col("run_id").cast("string"))
    names = [c for c in columns_for(version).names if c in table.columns]
    want = spark.read.schema("run_id string, n_rows bigint, digest bigint").json(f"{folder}/manifest")
    now = digests(table, ["run_id"], names).withColumnsRenamed({"n_rows": "now_rows", "digest": "now_digest"})
    changed = want.join(now, "run_id", "full").where(~F.col("n_rows").eqNullSafe(F.col("now_rows")) | ~F.col("digest").eqNullSafe(F.col("now_digest")))
    return table, changed.select("run_id")
