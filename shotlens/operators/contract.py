"""The frame-site table's contract: versions, types, migration and the checks every delivery must pass.

Checks never raise and never drop rows: each is one aggregate that counts what breaks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlens.operators.profile import FLAGS
from shotlens.session import cut

#: Older names of six columns and their present names.
RENAMED = {
    "roi_sum": "roi_sum_raw",
    "local_background": "background_annulus_contaminated",
    "global_background": "background_global",
    "background_corrected_count": "count_corrected_annulus_contaminated",
    "common_mode_corrected_count": "count_corrected_global",
    "local_background_density": "background_annulus_density_contaminated",
}
KEY = ["run_id", "shot_id", "frame_id", "site_id"]

#: Name, type, whether null is allowed.
BASE = [
    ("run_id", "string", False), ("shot_id", "int", False), ("shot_order", "int", False), ("frame_id", "tinyint", False), ("site_id", "int", False),
    ("timestamp", "string", True), ("exposure_ms", "double", True), ("frame_elapsed_s", "double", True), ("site_x", "double", False), ("site_y", "double", False),
    ("roi_sum_raw", "double", True), ("background_global", "double", True), ("count_corrected_global", "double", True), ("raw_image_path", "string", True), ("quality_flag", "string", False),
]
ADDED = {
    "2.0": [],
    "3.0": [("dataset_id", "string", False), ("cycle_index", "int", False), ("condition_id", "string", False), ("split", "string", False), ("grid_id", "string", False), ("background_template_offset", "double", True), ("count_corrected_template", "double", True)],
}
ADDED["4.0"] = ADDED["3.0"] + [("cumulative_bright_s", "double", False), ("cumulative_dark_s", "double", False), ("pulse_count", "tinyint", False)]


def columns_for(version: str) -> T.StructType:
    if version not in ADDED:
        raise ValueError(f"unknown contract version {version}; known: {', '.join(ADDED)}")
    return T.StructType([T.StructField(n, T._parse_datatype_string(k), null) for n, k, null in BASE + ADDED[version]])


def key_for(version: str) -> list[str]:
    return KEY if columns_for(version) and version == "2.0" else ["dataset_id", *KEY]


def empty_table(spark, version: str) -> DataFrame:
    return spark.createDataFrame([], columns_for(version))


def coerce(df: DataFrame, version: str) -> DataFrame:
    """Declared columns first, in their types (what can't be cast becomes null); unknown columns stay, last."""
    want = columns_for(version)
    known = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in want if f.name in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in want.names])


def rename_old(df: DataFrame) -> DataFrame:
    """The six renamed columns under their present names; nothing is made up."""
    return df.withColumnsRenamed({a: b for a, b in RENAMED.items() if a in df.columns and b not in df.columns})


def add_timing(df: DataFrame) -> DataFrame:
    """exposure_s, and the gap from the end of the frame before to the start of this one, per shot; the timing is read from one row per frame."""
    per = df.groupBy("run_id", "shot_id", "frame_id").agg(F.max("frame_elapsed_s").alias("start_s"), (F.max("exposure_ms") / 1000.0).alias("exposure_s"))
    w = Window.partitionBy("run_id", "shot_id").orderBy("frame_id")  # as many rows as a shot has frames
    return per.withColumn("gap_s", F.col("start_s") - (F.lag("start_s").over(w) + F.lag("exposure_s").over(w)))


def to_version_3(df: DataFrame, dataset_id: str, sequence_type: str) -> DataFrame:
    """A version 2 table with the ids of version 3, split 'unassigned' where unknown, exposures in seconds and the measured gaps."""
    t = add_timing(df).select("run_id", "shot_id", "frame_id", "exposure_s", F.col("gap_s").alias("interframe_gap_s"))
    out = df.join(t, ["run_id", "shot_id", "frame_id"], "left")
    fill = {"dataset_id": F.lit(dataset_id), "sequence_type": F.lit(sequence_type), "split": F.lit("unassigned")}
    return out.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in fill.items()} | {"frame_name": F.concat(F.lit("frame_"), F.col("frame_id").cast("string"))})


def number_is_missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def violations(df: DataFrame) -> DataFrame:
    """(check, n): how many rows, keys, shots or sites break each rule of the contract. The table is read once, into one row per key."""
    flags = F.split("quality_flag", r"\|")
    count = F.col("count_corrected_global")
    by_row = {f"null {c}": F.col(c).isNull() for c in ("run_id", "shot_id", "frame_id", "site_id", "quality_flag", "split")} | {
        "missing count without flag": (count.isNull() | F.isnan(count)) & ~F.contains("quality_flag", F.lit("nonfinite_count")),
        "unknown flag": (F.col("quality_flag") != "ok") & ~F.forall(flags, lambda x: x.isin(FLAGS)),
        "path in file name": F.col("raw_image_path").rlike(r"[/\\]"),
        "unknown split": ~F.col("split").isin("train", "validation", "test", "unassigned"),
    }
    spread = {"split": "several splits in a shot", "condition_id": "several conditions in a shot", "shot_order": "several orders of a shot"}
    ends = [f(c).alias(f"{c}_{k}") for c in (*spread, "site_x", "site_y") for k, f in (("lo", F.min), ("hi", F.max))]
    names = list(by_row)
    key = cut(df.groupBy(*KEY).agg(F.count("*").alias("n"), *[F.count_if(v).alias(f"_{i}") for i, v in enumerate(by_row.values())], *ends))
    widest = lambda c: F.max(f"{c}_hi") > F.min(f"{c}_lo")

    def counts(df: DataFrame, of: dict[str, Column]) -> DataFrame:
        row = df.agg(*[v.alias(f"_{i}") for i, v in enumerate(of.values())])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"_{i}").cast("bigint").alias("n")) for i, c in enumerate(of)])).alias("x")).select("x.*")

    rows = counts(key, {c: F.coalesce(F.sum(f"_{i}"), F.lit(0)) for i, c in enumerate(names)} | {"key delivered more than once": F.count_if(F.col("n") > 1)})
    shot = key.groupBy("run_id", "shot_id").agg((F.countDistinct("frame_id") * F.countDistinct("site_id") != F.count("*")).alias("torn"), *[widest(c).alias(c) for c in spread])
    shots = counts(shot, {"incomplete block of a shot": F.count_if("torn")} | {t: F.count_if(c) for c, t in spread.items()})
    site = key.groupBy("run_id", "site_id").agg((widest("site_x") | widest("site_y")).alias("moves"))
    return rows.unionByName(shots).unionByName(counts(site, {"site that moves": F.count_if("moves")}))


def timing_violations(df: DataFrame, runs: DataFrame, gap_s: float = 0.01, exposure_tolerance_ms: float = 1e-3, gap_tolerance_s: float = 1e-6) -> DataFrame:
    """(run_id, check, n) of the rules of time: exposures as commanded, frames in strict order with the declared gap, as many frames as the run has."""
    x = df.join(runs.select("run_id", F.col("exposure_ms").alias("commanded"), "n_frames"), "run_id")
    e = F.col("exposure_ms")
    off = e.isNotNull() & (F.isnan(e) | (F.abs(e - F.col("commanded")) > exposure_tolerance_ms))
    frame = x.groupBy("run_id", "shot_id", "frame_id").agg(F.count_if(off).alias("off"), F.count_if(e.isNull()).alias("none"), F.min("frame_elapsed_s").alias("start"), F.max("frame_elapsed_s").alias("start_hi"), F.max("commanded").alias("commanded"), F.max("n_frames").alias("n_frames"))
    w = Window.partitionBy("run_id", "shot_id").orderBy("frame_id")  # as many rows as a shot has frames
    gap = F.col("start") - (F.lag("start").over(w) + F.col("commanded") / 1000)
    frame = frame.withColumns({"back": F.col("start") <= F.lag("start").over(w), "gap": F.abs(gap - gap_s) > gap_tolerance_s, "next": F.col("frame_id") != F.row_number().over(w) - 1})
    shot = frame.groupBy("run_id", "shot_id").agg(F.sum("off").alias("off"), F.sum("none").alias("none"), F.count_if("back").alias("back"), F.count_if("gap").alias("gap"), F.count_if(F.col("start") != F.col("start_hi")).alias("several"), (F.count_if("next") > 0).alias("skips"), (F.count("*") != F.max("n_frames")).alias("short"))
    of = {"exposure not as commanded": F.sum("off"), "exposure missing": F.sum("none"), "frame not after the one before": F.sum("back"), "gap not as declared": F.sum("gap"), "several starts of a frame": F.sum("several"), "frames not numbered from 0": F.count_if("skips"), "shot without all frames": F.count_if("short")}
    row = shot.groupBy("run_id").agg(*[v.alias(f"_{i}") for i, v in enumerate(of.values())])
    return row.select("run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"_{i}").cast("bigint").alias("n")) for i, c in enumerate(of)])).alias("x")).select("run_id", "x.*")


#: The background and count columns of each way to correct a reading.
METHODS = {
    "raw": (None, "roi_sum_raw"),
    "global": ("background_global", "count_corrected_global"),
    "template": ("background_template_offset", "count_corrected_template"),
    "spatial": ("background_spatial", "count_corrected_spatial"),
    "fixed_offset": ("background_fixed_offset", "count_corrected_fixed_offset"),
    "annulus_contaminated": ("background_annulus_contaminated", "count_corrected_annulus_contaminated"),
}


def count_column(df: DataFrame, wanted: str) -> str:
    """The column that a method, a column's name or its older name stands for; an error names what there is."""
    for c in (wanted, METHODS.get(wanted, (None, wanted))[1], RENAMED.get(wanted, wanted), *[a for a, b in RENAMED.items() if b == METHODS.get(wanted, (None, wanted))[1]]):
        if c in df.columns:
            return c
    raise ValueError(f"no column for {wanted!r}; the counts there are: {', '.join(c for _, c in METHODS.values() if c in df.columns) or 'none'}")


def binary(df: DataFrame, c: str) -> DataFrame:
    """df, unless c has anything but 0 and 1."""
    n = df.where(F.col(c).isNull() | ~F.col(c).cast("double").isin(0.0, 1.0)).limit(1).count()
    if n:
        raise ValueError(f"{c!r} must be 0 or 1 in every row")
    return df


def valid_counts(df: DataFrame, successes: str = "successes", trials: str = "trials") -> DataFrame:
    """df, unless a row has no trials or more successes than trials."""
    s, n = F.col(successes), F.col(trials)
    if df.where(s.isNull() | n.isNull() | (s < 0) | (n <= 0) | (s > n)).limit(1).count():
        raise ValueError(f"{successes!r} must lie between 0 and {trials!r}, which must be positive")
    return df


def valid_times(df: DataFrame, c: str) -> DataFrame:
    """df, unless a time is missing, not finite or negative."""
    t = F.col(c).cast("double")
    if df.where(t.isNull() | F.isnan(t) | (t < 0) | (t == float("inf"))).limit(1).count():
        raise ValueError(f"{c!r} must be a finite time of zero or more")
    return df


def raise_if_broken(found: DataFrame, allowed: set[str] = frozenset()) -> None:
    bad = [f"{r['check']}: {r['n']}" for r in found.where("n > 0").collect() if r["check"] not in allowed]  # one row per check
    if bad:
        raise ValueError("; ".join(sorted(bad)))
