"""Column profiles and findings: forms, shares at their limits, shifts, missing values, empty tables."""

import datetime

from pyspark.sql import functions as F

from shotlens.operators.profile import binned, column_profile, flag_is_declared, load_findings, load_shifts, stamp_is_declared, value_counts


def test_forms(spark):
    good = ["ok", "roi_saturated", "roi_touches_edge|roi_saturated"]
    bad = ["", "OK", "ok|roi_saturated", "roi_saturated|roi_saturated", "roi_saturated|", "|ok", "roi_saturated,roi_touches_edge", "ok\n"]
    df = spark.createDataFrame([(x,) for x in good + bad], "v string").select("v", flag_is_declared(F.col("v")).alias("f"))
    assert {r.v for r in df.where("f").collect()} == set(good)
    good = ["2031-02-03T06:00:00", "2032-02-29T23:59:59.1", "2031-12-31T00:00:00.123456"]
    bad = ["2031-02-29T00:00:00", "2031-13-01T00:00:00", "2031-02-03T24:00:00", "2031-02-03T06:60:00", "2031-02-03 06:00:00", "2031-02-03T06:00:00Z", "2031-02-03T06:00:00.", "2031-02-03T06:00:00.1234567", "2031-02-03T06:00:00 ", "2031-02-03T06:00:00\n", "", "N/A"]
    df = spark.createDataFrame([(x,) for x in good + bad], "v string").select("v", stamp_is_declared(F.col("v")).alias("f"))
    assert {r.v for r in df.where("f").collect()} == set(good)


SCHEMA = "load_id int, run_id string, quality_flag string, exposure_ms double, timestamp string, value string, n int"


def findings(spark, rows, runs=(("r", 50.0),), loads=((1, datetime.datetime(2031, 2, 3)), (2, datetime.datetime(2031, 2, 3)))):
    df = spark.createDataFrame([(*r, "extra", 3) for r in rows], SCHEMA)
    r = spark.createDataFrame(list(runs), "run_id string, exposure_ms double")
    out = load_findings(df, r, spark.createDataFrame(list(loads), "load_id int, loaded_at timestamp_ntz"))
    return {(x.load_id, x.column_name, x.finding, x["item"]) for x in out.collect()}


OK = (1, "r", "ok", 50.0, "2031-02-03T06:00:00")


def test_limits_are_strict(spark):
    rows = [OK] * 9 + [(1, "r", None, None, None)]
    assert findings(spark, rows) == set()  # a tenth is not more than a tenth
    assert findings(spark, rows + [(1, "r", None, None, None)]) == {(1, c, "nulls", "") for c in ("quality_flag", "exposure_ms", "timestamp")}
    rows = [OK] * 7 + [(1, "r", "roi_saturated", 50.0, "2031-02-03T06:00:00")] * 3
    assert findings(spark, rows) == set()  # exactly 70 %
    assert findings(spark, rows + [(1, "r", "roi_saturated", 50.0, "2031-02-03T06:00:00")]) == {(1, "quality_flag", "shift", "")}


def test_values_and_shifts(spark):
    rows = [OK] * 4 + [(1, "r", "n/a", float("nan"), "x"), (1, "r", "n/a", 60.0, "1970-01-01T00:00:00")]
    assert findings(spark, rows) == {(1, "quality_flag", "values", "n/a"), (1, "quality_flag", "shift", ""), (1, "exposure_ms", "values", ""), (1, "timestamp", "values", "x")}
    rows = [(1, "r", "ok", 0.05, "1970-01-01T00:00:00")] * 3 + [OK] * 2
    assert findings(spark, rows) == {(1, "exposure_ms", "shift", ""), (1, "timestamp", "shift", "")}
    assert findings(spark, [(1, "none", "ok", 5.0, "2031-02-03T06:00:00")]) == set()  # a run without a commanded exposure isn't judged
    assert findings(spark, [(3, "r", "ok", 50.0, "1970-01-01T00:00:00")]) == set()  # nor a load without a date
    assert findings(spark, [(1, "r", "ok", -1.0, "2031-02-03T06:00:00"), OK, OK]) == {(1, "exposure_ms", "values", "")}
    assert findings(spark, [(None, "r", "bad" * 5000, 50.0, None)]) == {(None, "quality_flag", "values", "bad" * 5000), (None, "quality_flag", "shift", ""), (None, "timestamp", "nulls", "")}
    assert findings(spark, []) == set()


def test_profile_and_shift_table(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, float("nan"), None), (1, None, "a"), (2, 3.0, "b"), (2, 3.0, "b"), (None, 9.0, "c")], "load_id int, x double, t string")
    counts = value_counts(df, ["load_id"], ["x", "t"])
    p = {(r.load_id, r.column_name): r for r in column_profile(counts, ["load_id"], ["x"], {"t": F.col("value") == "b"}).collect()}
    assert (p[1, "x"].n_rows, p[1, "x"].n_null, p[1, "x"].n_distinct, p[1, "x"].least_number, p[1, "x"].most_number) == (3, 1, 2, 1.0, 1.0)
    assert (p[2, "t"].n_of_top_value, p[2, "t"].n_broken, p[2, "t"].first_text) == (2, 2, "b") and (None, "x") in p
    s = {(r.load_id, r.column_name): r for r in load_shifts(binned(counts, ["load_id"], ["x"]), "load_id").collect()}
    assert set(s) == {(2, "x"), (2, "t")} and s[2, "x"].psi > 0.5 and s[2, "x"].chi_square > 1
    same = value_counts(df.where("load_id = 2").unionByName(df.where("load_id = 2").withColumn("load_id", F.lit(3))), ["load_id"], ["x", "t"])
    assert all(r.psi == 0 and r.chi_square == 0 for r in load_shifts(binned(same, ["load_id"], ["x"]), "load_id").collect())
    empty = value_counts(df.where("false"), ["load_id"], ["x", "t"])
    assert column_profile(empty, ["load_id"], ["x"]).count() == 0 and load_shifts(binned(empty, ["load_id"], ["x"]), "load_id").count() == 0
