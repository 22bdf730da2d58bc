"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "shotlens", cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the given session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster if spark.checkpoint.dir names one, else (tests, one machine) a new local folder."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-shotlens-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(shared)
    return shared or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder: later steps survive the loss of executors and don't plan df again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(*cut_rows: DataFrame) -> None:
    """Deletes the files of results of ``cut`` that nothing reads any more, because what came of them is written."""
    for df in cut_rows:
        file = df._jdf.logicalPlan().rdd().getCheckpointFile()
        if file.isDefined():
            forget_path(df.sparkSession, file.get())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that their Python workers needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-shotlens-")) / "shotlens.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
