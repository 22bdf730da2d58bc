"""Contract, events, manifests, geometry and digests on small tables: each rule broken once, each edge by hand."""

import pytest
from pyspark.sql import functions as F

from shotlens.functions import numbers
from shotlens.operators import contract, events, geometry, manifests, provenance
from shotlens.operators.shots import one_delivery, occupancy_calls

ROW = {
    "run_id": "r", "shot_id": 0, "shot_order": 0, "frame_id": 0, "site_id": 0, "timestamp": "2031-02-03T00:00:00", "exposure_ms": 50.0, "frame_elapsed_s": 0.1, "site_x": 1.0, "site_y": 2.0,
    "roi_sum_raw": 9.0, "background_global": 1.0, "count_corrected_global": 8.0, "background_template_offset": 1.0, "count_corrected_template": 8.0, "raw_image_path": "a.h5", "quality_flag": "ok", "condition_id": "c", "cycle_index": 0, "split": "train", "grid_id": "g", "load_id": 1,
}
SCHEMA = "run_id string, shot_id int, shot_order int, frame_id int, site_id int, timestamp string, exposure_ms double, frame_elapsed_s double, site_x double, site_y double, roi_sum_raw double, background_global double, count_corrected_global double, background_template_offset double, count_corrected_template double, raw_image_path string, quality_flag string, condition_id string, cycle_index int, split string, grid_id string, load_id int"


def rows(spark, *changes, block=True):
    base = [ROW | {"frame_id": f, "site_id": s, "frame_elapsed_s": 0.1 * (f + 1)} for f in (0, 1) for s in (0, 1)] if block else []
    return spark.createDataFrame([tuple(r[c] for c in ROW) for r in base + [ROW | c for c in changes]], SCHEMA)


def broken(df):
    return {r["check"]: r["n"] for r in contract.violations(df).collect() if r["n"]}


def test_a_whole_block_is_fine(spark):
    assert broken(rows(spark)) == {}
    contract.raise_if_broken(contract.violations(rows(spark)))


@pytest.mark.parametrize(
    "change, check",
    [
        ({}, "key delivered more than once"), ({"site_id": 7}, "incomplete block of a shot"), ({"shot_id": 1, "split": "tr"}, "unknown split"), ({"shot_id": 1, "quality_flag": "bad"}, "unknown flag"),
        ({"shot_id": 1, "raw_image_path": "x/a.h5"}, "path in file name"), ({"shot_id": 1, "raw_image_path": "x\\a.h5"}, "path in file name"), ({"shot_id": 1, "count_corrected_global": None}, "missing count without flag"),
        ({"shot_id": 1, "count_corrected_global": float("nan")}, "missing count without flag"), ({"shot_id": 1, "site_x": 5.0}, "site that moves"), ({"shot_id": 1, "quality_flag": None}, "null quality_flag"),
    ],
)
def test_each_rule(spark, change, check):
    got = broken(rows(spark, change))
    assert got.get(check) == 1
    with pytest.raises(ValueError, match=check):
        contract.raise_if_broken(contract.violations(rows(spark, change)))
    contract.raise_if_broken(contract.violations(rows(spark, change)), set(got))


def test_mixed_shot_and_flagged_missing(spark):
    assert broken(rows(spark, {"frame_id": 1, "site_id": 1, "split": "test", "condition_id": "d", "shot_order": 5})) == {"key delivered more than once": 1, "several splits in a shot": 1, "several conditions in a shot": 1, "several orders of a shot": 1}
    assert broken(rows(spark, {"shot_id": 1, "count_corrected_global": None, "quality_flag": "nonfinite_count"})) == {}


def test_versions(spark):
    old = spark.createDataFrame([(1, 2.0, 3.0, "x")], "shot_id bigint, roi_sum double, local_background double, other string")
    new = contract.rename_old(old)
    assert new.columns == ["shot_id", "roi_sum_raw", "background_annulus_contaminated", "other"]
    c = contract.coerce(new, "2.0")
    assert c.columns[:2] == ["shot_id", "roi_sum_raw"] and dict(c.dtypes)["shot_id"] == "int" and c.columns[-1] == "other"
    assert contract.empty_table(spark, "4.0").count() == 0 and contract.key_for("2.0") == contract.KEY and contract.key_for("4.0")[0] == "dataset_id"
    with pytest.raises(ValueError):
        contract.columns_for("9")
    v3 = contract.to_version_3(rows(spark).drop("split"), "d", "dark").where("frame_id = 1").first()
    assert (v3.dataset_id, v3.split, v3.frame_name) == ("d", "unassigned", "frame_1") and v3.interframe_gap_s == pytest.approx(0.05)


def test_one_delivery_and_calls(spark):
    df = rows(spark, {"load_id": 2}, {"shot_id": 1, "count_corrected_template": 90.0}, {"shot_id": 2, "count_corrected_template": float("nan")}, {"shot_id": 3, "count_corrected_template": None})
    clean = one_delivery(df)
    assert clean.count() == 7
    calls = {(r.shot_id, r.frame_id, r.site_id): r.occupied for r in occupancy_calls(clean).collect()}
    assert calls[1, 0, 0] == 1 and calls[0, 0, 0] == 0 and (2, 0, 0) not in calls and (3, 0, 0) not in calls


def test_events(spark):
    c = spark.createDataFrame([("r", 0, 0, f, v) for f, v in ((0, 1), (2, 1), (3, 0), (10, 1))], "run_id string, shot_id int, site_id int, frame_id int, occupied int")
    assert {(r.interval, r.occupied, r.next_call) for r in events.transitions(c).collect()} == {("0->2", 1, 1), ("2->3", 1, 0), ("3->10", 0, 1)}
    assert {(r.interval, r.retained) for r in events.retention_events(c).collect()} == {("0->2", 1), ("2->3", 0)}
    names = spark.createDataFrame([("10->11",), ("2->3",), ("x",), (None,)], "i string")
    assert [r.i for r in names.orderBy(*events.interval_order(F.col("i"))).collect()][:2] == ["2->3", "10->11"]
    isl = events.islands(c.withColumn("occupied", F.when(F.col("frame_id") == 2, None).otherwise(F.col("occupied"))), ["run_id"], ["frame_id"], "occupied")
    assert sorted((r.first_at, r.last_at, r.occupied) for r in isl.collect()) == [(1, 1, 1), (2, 2, None), (3, 3, 0), (4, 4, 1)]
    states = spark.createDataFrame([("k", 1.0, "a"), ("k", 3.0, "b"), ("j", 0.0, "z")], "k string, since double, s string")
    times = spark.createDataFrame([("k", 0.5), ("k", 1.0), ("k", 2.9), ("k", 9.0), ("i", 1.0)], "k string, at double")
    assert {(r.k, r["at"], r.s) for r in events.state_at(times, states, ["k"], "at", "since", "s").collect()} == {("k", 0.5, None), ("k", 1.0, "a"), ("k", 2.9, "a"), ("k", 9.0, "b"), ("i", 1.0, None)}
    seg = spark.createDataFrame([("k", 0.0, 1.0), ("k", 1.0, 2.0), ("j", 0.0, 5.0)], "k string, start_s double, end_s double")
    assert events.overlapping(seg, seg, ["k"], 2.0).count() == 3 == events.overlapping(seg, seg, ["k"], 0.3).count()


def test_manifests(spark):
    shots = spark.createDataFrame([("r", c * 11 + i, c * 11 + i, c, f"c{i}") for c in range(10) for i in range(11)] + [("r", 500, 500, None, "c0")], "run_id string, shot_id int, shot_order int, cycle_index int, condition_id string")
    m = manifests.cycle_manifest(shots)
    n = {r.split: r.n for r in shots.join(m, ["run_id", "cycle_index"]).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": 66, "validation": 22, "test": 22}
    assert all((r.train, r.validation, r.test) == (6, 2, 2) for r in manifests.split_coverage(shots, m).collect())
    fixed = shots.where("cycle_index is not null").limit(100)
    assert {r.split: r.n for r in manifests.block_manifest(fixed).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 60, "validation": 20, "test": 20}
    man = spark.createDataFrame([("r", 0, "train"), ("r", 1, "test"), ("r", 1, "train"), ("r", 0, "train")], "run_id string, shot_id int, split string")
    out, trouble = manifests.attach_split(shots.where("shot_id < 3"), man)
    assert out.count() == 3 and {(r.shot_id, r.trouble) for r in trouble.collect()} == {(1, "ambiguous"), (2, "absent")}


def test_geometry(spark):
    sites = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (9, 0), (0, 31), (1000, 1000)])] + [("b", i, float(x), float(y)) for i, (x, y) in enumerate([(9.5, 0), (0.5, 0), (0, 30)])], "run_id string, site_id int, site_x double, site_y double")
    near = {r.site_id: (r.nearest_id, r.distance, r.n_near) for r in geometry.nearest_neighbours(sites.where("run_id = 'a'"), 40.0).collect()}
    assert near == {0: (1, 9.0, 2), 1: (0, 9.0, 2), 2: (0, 31.0, 2)}
    runs = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset_id string, run_id string")
    m = geometry.match_runs(sites, runs, 5.0).collect()
    assert [(r.run_id, r.n_matched, r.median_distance, r.most_distance) for r in m] == [("b", 3, 0.5, 1.0)]


def test_digests(spark):
    df = rows(spark, {"shot_id": 1, "quality_flag": None})
    a = provenance.digests(df, ["load_id"], ["shot_id", "quality_flag"]).first()
    b = provenance.digests(df.repartition(4).orderBy(F.desc("shot_id")), ["load_id"], ["shot_id", "quality_flag"]).first()
    c = provenance.digests(rows(spark, {"shot_id": 1, "quality_flag": ""}), ["load_id"], ["shot_id", "quality_flag"]).first()
    assert a == b and a.digest != c.digest
    twice = {r.column_name: (r.n_keys, r.n_over_loads, r.n_differ) for r in provenance.repeated_deliveries(rows(spark, {"load_id": 2}, {"site_id": 1, "roi_sum_raw": None}), ["roi_sum_raw", "split"]).collect()}
    assert twice == {"roi_sum_raw": (2, 1, 1), "split": (2, 1, 0)}


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-9), (1.0, 1.1), (None, None), (None, 1.0), (float("nan"), float("nan")), (float("inf"), float("inf")), (float("inf"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.close(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True, True, False]
    r = spark.range(1).select(numbers.bit(F.lit(6), 1).alias("b"), numbers.milliseconds(F.lit(0.05)).alias("m"), numbers.logistic(numbers.odds(F.lit(0.3))).alias("p")).first()
    assert (r.b, r.m) == (1, "50ms") and r.p == pytest.approx(0.3)


def test_export_gate(spark, tmp_path):
    from shotlens.sources.export import read_checked, write_checked

    with pytest.raises(ValueError):
        write_checked(rows(spark, {"quality_flag": "bad", "shot_id": 1}), str(tmp_path / "x"), "3.0")
    assert not (tmp_path / "x").exists()  # nothing is written
    good = rows(spark).withColumn("dataset_id", F.lit("d"))
    write_checked(good, str(tmp_path / "y"), "3.0")
    table, changed = read_checked(spark, str(tmp_path / "y"), "3.0")
    assert table.count() == 4 and changed.count() == 0
    spark.createDataFrame([("r", 5, 1)], "run_id string, n_rows bigint, digest bigint").coalesce(1).write.mode("overwrite").json(str(tmp_path / "y" / "manifest"))
    assert [r.run_id for r in read_checked(spark, str(tmp_path / "y"), "3.0")[1].collect()] == ["r"]


def test_one_delivery_is_one_copy(spark):
    from shotlens.operators.shots import one_delivery

    df = spark.createDataFrame([("r", 1, 0, 0, 2, 5.0, "b"), ("r", 1, 0, 0, 1, float("nan"), "a"), ("r", 1, 0, 0, None, 9.0, "c"), ("r", 2, 0, 0, None, 1.0, None)], "run_id string, shot_id int, frame_id int, site_id int, load_id int, v double, t string")
    got = {r.shot_id: r for r in one_delivery(df, ["v", "t"]).collect()}
    assert got[1].t == "a" and got[1].v != got[1].v and (got[2].v, got[2].t) == (1.0, None)  # no row made up of two


def test_late_events_are_dropped_and_partials_merge(spark, tmp_path):
    import datetime

    from shotlens.streaming import loads

    day = lambda d, h=0: datetime.datetime(2031, 1, d, h, 30)
    folder = str(tmp_path / "events")
    # a row is late by the watermark of the batch before
    for i, rows in enumerate([[(day(10), "a", 1.0), (day(10, 1), "a", 2.0)], [(day(14), "b", 4.0)], [(day(14, 2), "b", 5.0)], [(day(1), "late", 9.0), (day(10), "a", 7.0), (day(14), "b", 1.0)]]):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)
        import os

        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("n"):
                os.rename(f"{folder}/{f}", f"{folder}/n{i}.parquet")
                os.utime(f"{folder}/n{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    s = loads.event_windows(loads.stream_of(spark, folder, 1))
    got = {(r.window_start.day, r.window_start.hour, r.event_type): (r.n_events, r.cents) for r in loads.run_updates(s, ["window_start", "event_type"]).collect()}
    assert got == {(10, 0, "a"): (1, 100), (10, 1, "a"): (1, 200), (14, 0, "b"): (2, 500), (14, 2, "b"): (1, 500)}  # neither the late row nor the one after the window's end

    rows = str(tmp_path / "rows")
    for load in (1, 2):
        spark.createDataFrame([("r", 1, f, load) for f in range(load + 1)], "run_id string, shot_id int, frame_id int, load_id int").coalesce(1).write.mode("append").parquet(rows)
    r = loads.run_partials(loads.stream_of(spark, rows, 1), loads.shot_progress, loads.merged_progress).collect()
    assert [tuple(x) for x in r] == [("r", 1, 5, 2, 1, 2)]


def test_overlaps_against_all_pairs(spark):
    import random

    g = random.Random(3)
    seg = [("k", i, s, s + g.choice([0.0, 0.5, 3.0, 40.0])) for i in range(120) for s in [g.uniform(-50, 50)]]
    df = spark.createDataFrame(seg, "k string, i int, start_s double, end_s double")
    want = {(a[1], b[1]) for a in seg for b in seg if a[3] > b[2] + 0.1 and a[2] < b[3] - 0.1}
    for width in (1.0, 30.0):
        got = [(r.a, r.b) for r in events.overlapping(df, df, ["k"], width, 0.1).select(F.col("a.i").alias("a"), F.col("b.i").alias("b")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_count_columns_and_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, 2, 0.5)], "roi_sum double, count_corrected_template double, successes int, trials int, t double")
    assert contract.count_column(df, "template") == "count_corrected_template" and contract.count_column(df, "raw") == "roi_sum" and contract.count_column(df, "roi_sum_raw") == "roi_sum"
    with pytest.raises(ValueError, match="the counts there are: count_corrected_template"):
        contract.count_column(df, "spatial")
    assert contract.valid_counts(df).count() == contract.valid_times(df, "t").count() == contract.binary(df, "successes").count() == 1
    with pytest.raises(ValueError, match="0 or 1"):
        contract.binary(df, "trials")
    with pytest.raises(ValueError, match="between 0 and"):
        contract.valid_counts(df, "trials", "successes")
    with pytest.raises(ValueError, match="finite time"):
        contract.valid_times(df.withColumn("t", F.lit(float("nan"))), "t")


def test_plans_side_by_side(spark):
    from shotlens.operators import manifests

    a = spark.createDataFrame([("r", 1, "train"), ("r", 2, "test")], "run_id string, shot_id int, split string")
    b = spark.createDataFrame([("r", 1, "validation")], "run_id string, shot_id int, sensitivity_split string")
    assert {tuple(r) for r in manifests.beside(a, b).collect()} == {("r", 1, "train", "validation"), ("r", 2, "test", None)}
    assert {(r.shot_id, r.split) for r in manifests.replaced(a, b).collect()} == {(1, "validation"), (2, "unassigned")}
    with pytest.raises(ValueError, match="more than once"):
        manifests.beside(a.unionByName(a), b)
