"""Multi-select against sorting, summaries within their error, and the defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlens.llm import quantiles as Q

POINTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v) - 1e-9)) - 1]


def frame(spark, groups, parts=5):
    rows = [(a, b, v, "x", 1.0) for (a, b), vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "load int, site int, y double, vals string, p double").repartition(parts)


@pytest.mark.parametrize("rest, chunk, per_part", [(0, 7, 64), (8, 7, 3), (1000, 1 << 20, 64)])
def test_against_sorting(spark, rest, chunk, per_part):
    g = np.random.default_rng(rest)
    groups = {(1, i): (g.standard_normal(300) * 10).tolist() for i in range(3)}
    groups[1, 9] = [5.0] * 200 + [1.0]  # ties
    groups[2, 0] = np.round(g.standard_normal(250)).tolist()
    groups[2, 1] = [3.0]
    groups[None, 0] = [1.0, 2.0, float("inf"), -float("inf")]
    df = frame(spark, groups)
    got = {(r.load, r.site, r.p): (r.value, r.n) for r in Q.select_ranks(Q.sorted_chunks(df, ["load", "site"], "y", chunk), ["load", "site"], POINTS, rest, per_part).collect()}
    assert got == {(*k, p): (exact(v, p), len(v)) for k, v in groups.items() for p in POINTS}


@pytest.fixture
def small_batches(spark):
    """A chunk is made of whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "16")
    yield
    spark.conf.set(key, was)


@pytest.mark.parametrize("limit", [0, 12, 10**6])
def test_pivots_reach_the_chunks_either_way(spark, small_batches, limit):
    """Broadcast or bucketed, or first the one and then the other; a constant column in many chunks is a hot group of several parts."""
    g = np.random.default_rng(8)
    groups = {(1, 1): [5.0] * 700, (1, 2): g.standard_normal(500).tolist(), (2, 1): g.integers(0, 9, 300).astype(float).tolist(), (None, 3): g.lognormal(size=90).tolist()}
    got = Q.select_ranks(Q.sorted_chunks(frame(spark, groups), ["load", "site"], "y", 16), ["load", "site"], POINTS, 2, 4, 2, limit)
    rows = got.collect()
    assert {(r.load, r.site, r.p): (r.value, r.n) for r in rows} == {(*k, p): (exact(v, p), len(v)) for k, v in groups.items() for p in POINTS} and len(rows) == 28
    assert min(r.rounds for r in rows) >= 1 and max(r.rounds for r in rows) > 4


def test_equal_chunks_of_a_hot_group_are_spread(spark, small_batches):
    groups = {(1, 1): [5.0] * 640, (1, 2): [1.0, 2.0]}
    chunks = Q.sorted_chunks(frame(spark, groups, 4), ["load", "site"], "y", 16)
    c = Q._Chunks(chunks.select(F.col("load").alias("_k0"), F.col("site").alias("_k1"), F.lit(0).cast("bigint").alias("_null"), "vals", "wts"), ["_k0", "_k1", "_null"], 4, 0)
    c._place()
    sizes = [r["count"] for r in c.df.where("_k1 = 1").groupBy("_b").count().collect()]
    assert c.salts >= 10 and len(sizes) >= 6 and max(sizes) <= 14
    c.drop()


def test_missing_values_and_empty(spark):
    df = frame(spark, {(1, 1): [None, float("nan"), 2.0], (1, 2): [None, float("nan")]})
    got = Q.percentiles(df, ["load", "site"], "y", [0.5]).collect()
    assert [(r.load, r.site, r.value, r.n) for r in got] == [(1, 1, 2.0, 1)]
    assert Q.percentiles(df.where("false"), ["load", "site"], "y", [0.5]).count() == 0
    assert Q.combined_percentiles(Q.summaries(df.where("false"), ["load", "site"], "y", 0.01), ["site"], [0.5]).count() == 0


@pytest.mark.parametrize("error", [0.002, 0.01, 0.05])
def test_combined_error(spark, error):
    g = np.random.default_rng(3)
    groups = {(i, s): (g.lognormal(size=int(n)) + i).tolist() for i, n in enumerate([10, 500, 3000, 40, 1200]) for s in (0, 1)}
    parts = Q.summaries(frame(spark, groups, 4), ["load", "site"], "y", error)
    kept = sum(len(r.vals) for r in parts.collect())
    assert kept < sum(map(len, groups.values())) or error == 0.002
    for r in Q.combined_percentiles(parts, ["site"], POINTS).collect():
        both = np.sort(np.concatenate([v for (_, s), v in groups.items() if s == r.site]))
        assert r.n == len(both)
        want = max(1, math.ceil(r.p * len(both) - 1e-9))
        lowest, highest = np.searchsorted(both, r.value, "left") + 1, np.searchsorted(both, r.value, "right")
        assert lowest - error * len(both) - 20 <= want <= highest + error * len(both) + 20  # a row for each chunk


def test_loads_against_sql(spark, folder):
    from shotlens.llm.queries import QUERIES, SQL
    from tests.helpers import assert_same

    assert_same(spark, folder, "p2_load_percentiles", QUERIES["p2_load_percentiles"], SQL["p2_load_percentiles"])


def test_combined_on_the_tables(spark, folder):
    from shotlens.llm.queries import RANK_ERROR, p2_combined_percentiles
    from tests.helpers import duck

    con = duck(folder)
    for r in p2_combined_percentiles(spark, folder).collect():
        if r.site_id < 2:
            v = np.array([x[0] for x in con.sql(f"select count_corrected_template from frame_sites where site_id = {r.site_id} and frame_id = {r.frame_id} and count_corrected_template is not null and not isnan(count_corrected_template) order by 1").fetchall()])
            want = max(1, math.ceil(r.p * len(v) - 1e-9))
            assert r.n == len(v) and np.searchsorted(v, r.value, "left") + 1 - RANK_ERROR * len(v) - 12 <= want <= np.searchsorted(v, r.value, "right") + RANK_ERROR * len(v) + 12
