"""Drifting records: changes between files, typed ingestion, rescue, promotion and replay."""

import json

from shotlens.operators import drift

RAW = "feed_id int, file_id bigint, file_no int, record_no int, payload string, name string, kind string"
ALIASES = [("roi_sum", "roi_sum_raw"), ("roi_total", "roi_sum_raw"), ("older", "roi_sum")]
TARGET = {"run_id": "string", "roi_sum_raw": "double", "shot_id": "int"}


def raw(spark, files):
    rows = []
    for feed, file_id, no, payloads in files:
        rows += [(feed, file_id, no, i, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y") for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, RAW)


def aliases(spark, rows=ALIASES):
    return spark.createDataFrame(rows, "alias_name string, current_name string")


def changes(spark, files, al=ALIASES):
    table = drift.ingest(raw(spark, files), aliases(spark, al), TARGET)
    return {tuple(r) for r in drift.field_changes(table, aliases(spark, al)).collect()}


def test_changes(spark):
    files = [
        (1, 10, 2, [{"roi_sum": 1, "a": 1, "gone": True}, {"roi_sum": None, "a": 2}]),
        (1, 11, 5, [{"ROI-Total": "1.5", "A": 2, "new": {"x": 1}}]),
        (1, 12, 4, [{"roi_sum": 3, "a": None, "gone": [1]}]),  # between the two by number
        (2, 13, 1, [{"roi_sum": 1}]),
    ]
    assert changes(spark, files) == {(12, "gone", "type", ""), (11, "ROI-Total", "renamed", "roi_sum"), (11, "ROI-Total", "type", ""), (11, "A", "renamed", "a"), (11, "gone", "removed", ""), (11, "new", "added", "")}


def test_broken_payloads_ties_and_chains(spark):
    files = [
        (1, 1, 1, ['{"older": 1', "", "#ERR", None, "[1]", "3", {"older": 1}]),
        (1, 2, 2, ["not json"]),  # no record: passed over
        (1, 3, 3, [{"roiSum": 2}, {"roiSum": 2}, {"roi_total": 2}]),  # the more frequent spelling counts
        (1, 4, 3, [{"roi sum": 2}]),  # same number: by file_id
    ]
    assert changes(spark, files) == {(3, "roiSum", "renamed", "older"), (4, "roi sum", "renamed", "roiSum")}
    assert changes(spark, []) == set() and changes(spark, files, [("x", "x")]) >= {(3, "roiSum", "added", "")}
    assert changes(spark, [(1, 1, 1, [{"k": "v" * 200_000}]), (1, 2, 2, [{"k": 1}])]) == {(2, "k", "type", "")}


def test_ingest_promote_replay(spark):
    files = [(1, 1, 1, [{"RUN_ID": "r", "roi_total": "2.5", "shot_id": [4], "temp": 3.5, "odd": {"q": 1}}, {"run id": "s", "roi_sum": {"value": 7.5, "unit": "adu"}, "shot_id": "x", "temp": "warm"}, {"run_id": None}, {"run_id": "t", "older": 1, "roi_sum_raw": 2}, "no"])]
    al = aliases(spark)
    strict = drift.ingest(raw(spark, files), al, TARGET).cache()
    got = {r.record_no: r for r in strict.collect()}
    assert len(got) == 4 and (got[0].run_id, got[0].roi_sum_raw, got[0].shot_id) == ("r", 2.5, None)
    assert json.loads(got[0].rescued) == {"shot_id": [4], "temp": 3.5, "odd": {"q": 1}} and got[2].rescued is None
    assert json.loads(got[1].rescued) == {"roi_sum": {"value": 7.5, "unit": "adu"}, "shot_id": "x", "temp": "warm"}
    assert got[3].roi_sum_raw in (1.0, 2.0) and len(json.loads(got[3].rescued)) == 1  # the second spelling is kept aside
    more = drift.promote(strict, al, {"temp": "double"}).cache()
    one = {r.record_no: r for r in more.collect()}
    assert one[0].temp == 3.5 and one[1].temp is None and "temp" in json.loads(one[1].rescued)
    last = {r.record_no: r for r in drift.replay(more, al, TARGET | {"temp": "double"}).collect()}
    assert (last[0].shot_id, last[1].roi_sum_raw) == (4, 7.5)
    assert json.loads(last[0].rescued) == {"odd": {"q": 1}} and json.loads(last[1].rescued) == {"shot_id": "x", "temp": "warm"}
    report = {r.name: r.n_records for r in drift.rescue_report(strict).collect()}
    assert report["temp"] == 2 and report["odd"] == 1
    assert drift.ingest(raw(spark, []), al, TARGET).count() == 0
    kept = {r.record_no: {(f.name, f.kind) for f in r.delivered} for r in strict.collect()}
    assert kept[0] == {("RUN_ID", "text"), ("roi_total", "text")} and kept[2] == {("run_id", "null")}
    inventory = {(r.name, r.kind): r.n for r in drift.fields(strict).collect()}  # of the ingested table: typed, null and rescued fields
    assert inventory["run_id", None] == 1 and inventory["shot_id", "array"] == 1 and inventory["roi_total", "text"] == 1 and sum(inventory.values()) == 13
