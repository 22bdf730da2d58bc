"""Column profiles of large tables, from one exact list of column-value counts.

``value_counts`` unpivots the wanted columns and counts every (keys, column, value) with map-side combining; all else is
an aggregate of those counts: frequencies, null shares, distinct values, ranges, broken patterns and the comparison of two loads.

Defined results: null is a value of its own and NaN is not null; a null load is a load of its own; an empty table gives an
empty profile; a column absent from the table is an error; repeated rows count as often as they are delivered; texts of
any length are counted whole; column names may clash with those used here, as every used column is renamed first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.session import cut
from shotlens.sources.tables import require_columns

#: The flags a row may carry.
FLAGS = ["roi_saturated", "roi_touches_edge", "local_bg_underdetermined", "nonfinite_count", "site_not_detected"]
#: Fixed format: a date and a time of day, with or without a fraction of up to six digits.
STAMP = r"\A\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?\z"


def value_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., column_name, value, n): how often each value, as text, stands in each column for each key."""
    require_columns(df, *by, *columns)
    ids = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    cells = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns])
    long = cells.unpivot([f"_by{i}" for i in range(len(by))], columns, "column_name", "value")
    counts = long.groupBy(*[f"_by{i}" for i in range(len(by))], "column_name", "value").agg(F.count("*").alias("n"))
    return counts.select(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], "column_name", "value", "n")


def flag_is_declared(value: Column) -> Column:
    parts = F.split(value, r"\|", -1)
    known = F.forall(parts, lambda x: x.isin(FLAGS))
    return (value == "ok") | (known & (F.size(F.array_distinct(parts)) == F.size(parts)))


def stamp_is_declared(value: Column) -> Column:
    return value.rlike(STAMP) & F.substring(value, 1, 10).try_cast("date").isNotNull()


def column_profile(counts: DataFrame, by: list[str], numeric: list[str], broken: dict[str, Column] | None = None) -> DataFrame:
    """One row for each key and column: rows, nulls, distinct values, range, most frequent value, values of broken form."""
    number = F.when(F.col("column_name").isin(numeric), F.col("value").try_cast("double"))
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    text = F.when(~F.col("column_name").isin(numeric), F.col("value"))
    bad = reduce(lambda a, c: a.when((F.col("column_name") == c[0]) & c[1], F.col("n")), (broken or {}).items(), F.when(F.lit(False), F.col("n")))
    c = counts.withColumns({"_number": number, "_text": text, "_bad": bad})
    known = F.col("value").isNotNull()
    return c.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.round(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / F.sum("n"), 9).alias("null_share"),
        F.count("value").alias("n_distinct"),
        F.min("_number").alias("least_number"), F.max("_number").alias("most_number"),
        F.min("_text").alias("first_text"), F.max("_text").alias("last_text"),
        F.max(F.when(known, F.col("n"))).alias("n_of_top_value"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_broken"),
    )


def binned(counts: DataFrame, by: list[str], numeric: list[str]) -> DataFrame:
    """Counts by bin, few for any column: numbers in half octaves by sign, texts by their shape (digits as 9, letters as a)."""
    x = F.col("value").try_cast("double")
    octave = F.floor(2 * F.log2(F.abs(x)) + 1e-9).cast("int")
    half = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").when(x == 0, "0").when(x < 0, F.concat(F.lit("-"), octave.cast("string"))).otherwise(octave.cast("string"))
    shape = F.regexp_replace(F.regexp_replace("value", r"[0-9]+", "9"), r"[A-Za-z]+", "a")
    bin_ = F.when(F.col("value").isNull(), "null").when(F.col("column_name").isin(numeric), F.coalesce(half, F.lit("text"))).otherwise(F.concat(F.lit("="), shape))
    return counts.groupBy(*by, "column_name", bin_.alias("bin")).agg(F.sum("n").alias("n"))


def load_shifts(bins: DataFrame, load: str, least: float = 0.5) -> DataFrame:
    """Each load against the load before it: population stability index and chi-square over the bins of each column.

    ``least`` is added to every count for the index, so that a bin that one of the loads lacks stays finite.
    """
    loads = bins.select(load).distinct().where(F.col(load).isNotNull())
    after = loads.select(F.col(load).alias("_before"), F.lead(load).over(Window.orderBy(load)).alias("_load")).where("_load is not null")  # as many rows as loads
    now = bins.where(F.col(load).isNotNull()).select(F.col(load).alias("_load"), "column_name", "bin", F.col("n").alias("n1"))
    then = bins.select(F.col(load).alias("_before"), "column_name", "bin", F.col("n").alias("n0")).join(after, "_before").drop("_before")
    both = now.join(after.select("_load"), "_load", "left_semi").join(then, ["_load", "column_name", "bin"], "full").fillna(0, ["n0", "n1"])
    whole = both.groupBy("_load", "column_name").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("k"))
    x = both.join(whole, ["_load", "column_name"])
    p, q = (F.col("n1") + least) / (F.col("t1") + least * F.col("k")), (F.col("n0") + least) / (F.col("t0") + least * F.col("k"))
    a, b = F.sqrt(F.try_divide("t0", "t1")), F.sqrt(F.try_divide("t1", "t0"))
    chi = F.pow(F.col("n1") * a - F.col("n0") * b, 2) / (F.col("n1") + F.col("n0"))
    return x.groupBy(F.col("_load").alias(load), "column_name").agg(F.count("*").alias("n_bins"), F.round(F.sum((p - q) * F.ln(p / q)), 6).alias("psi"), F.round(F.sum(chi), 4).alias("chi_square"))


def load_findings(rows: DataFrame, runs: DataFrame, loads: DataFrame, null_share: float = 0.1, ok_share: float = 0.7, off_share: float = 0.5, off_by: float = 0.1, highest: float = 10_000.0, days: int = 365) -> DataFrame:
    """(load_id, column_name, finding, item) where a load departs from the declared form or from what is usual.

    A run missing from ``runs`` has no commanded exposure, and a load missing from ``loads`` no date, so those values are not judged as shifted.
    """
    cols = ["quality_flag", "exposure_ms", "timestamp"]
    counts = cut(value_counts(rows, ["load_id", "run_id"], cols))  # read twice below
    counts = counts.join(runs.select("run_id", F.col("exposure_ms").alias("commanded")).dropDuplicates(["run_id"]), "run_id", "left")
    counts = counts.join(loads.select("load_id", "loaded_at").dropDuplicates(["load_id"]), "load_id", "left")
    col, value, n = F.col("column_name"), F.col("value"), F.col("n")
    x = F.when(col == "exposure_ms", value.try_cast("double"))
    formed = F.when(col == "timestamp", stamp_is_declared(value)).when(col == "quality_flag", flag_is_declared(value)).when(col == "exposure_ms", ~((x <= 0) | F.isnan(x) | (x > highest)))
    at = F.when(formed & (col == "timestamp"), value.try_cast("timestamp_ntz"))
    far = (at > F.col("loaded_at").cast("timestamp_ntz") + F.expr(f"interval {days} days")) | (at < F.col("loaded_at").cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    off = F.abs(x - F.col("commanded")) > off_by * F.col("commanded")
    shifted = F.when(col == "timestamp", far).when(col == "exposure_ms", off).when(col == "quality_flag", value != "ok")
    # one row per load, column and value; a bin of values that break the form is as small as the list of such values
    per = counts.withColumns({"formed": formed, "shifted": F.coalesce(shifted, F.lit(False))})
    whole = per.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("nulls"),
        F.sum(F.when(value.isNotNull() & ((col != "timestamp") | F.col("formed")), n).otherwise(0)).alias("judged"),
        F.sum(F.when(F.col("shifted"), n).otherwise(0)).alias("moved"),
        F.max(F.when(value.isNotNull() & ~F.col("formed"), 1).otherwise(0)).alias("broken"),
    )
    limit = F.when(col == "quality_flag", 1 - F.lit(ok_share)).otherwise(off_share)
    kinds = F.filter(
        F.array(
            F.when(F.col("nulls") > null_share * F.col("rows"), "nulls"),
            F.when((col == "exposure_ms") & (F.col("broken") == 1), "values"),
            F.when((F.col("judged") > 0) & (F.col("moved") > limit * F.col("judged") + 1e-9 * F.col("judged")), "shift"),
        ),
        lambda k: k.isNotNull(),
    )
    one = whole.select("load_id", "column_name", F.explode(kinds).alias("finding"), F.lit("").alias("item"))
    each = per.where(value.isNotNull() & ~F.col("formed") & (col != "exposure_ms")).select("load_id", "column_name", F.lit("values").alias("finding"), value.alias("item")).distinct()
    return one.unionByName(each)
