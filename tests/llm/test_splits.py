"""Groups of related shots against a plain union-find, the greedy assignment against its loop, and the defined cases."""

import random

import numpy as np
import pytest

from shotlens.llm import splits

SHOTS = "run_id string, shot_id int, cycle_index int, retake_of_shot_id int, node string, root string"
ROWS = "run_id string, shot_id int, raw_image_path string, split string, file string, bit int, n int"


def tables(spark, shots, rows):
    return spark.createDataFrame([(*s, "x", "y") for s in shots], SHOTS), spark.createDataFrame([(*r, "z", 5, 6) for r in rows], ROWS)


def plain_groups(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("links_per_task", [3, 40, 10_000])
def test_union_find(spark, links_per_task):
    g = random.Random(links_per_task)
    links = [(f"n{g.randrange(900):04d}", f"n{g.randrange(900):04d}") for _ in range(420)]
    links += [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(300)]  # a long path
    links += [("hub", f"h{i:04d}") for i in range(400)]  # a hot node
    links += [("same", "same"), ("n0001", "n0001")] * 3
    df = spark.createDataFrame([*links, (None, "x"), ("x", None)], "a string, b string").repartition(7)
    got = {r.node: r.root for r in splits.connected_groups(df, links_per_task).collect()}
    assert got == plain_groups(links)
    assert splits.connected_groups(df.where("false")).count() == 0


def found(spark, shots, rows):
    a, b = tables(spark, shots, rows)
    groups = splits.shot_groups(a, b)
    hit = groups.join(splits.broken_groups(groups).select("group"), "group", "left_semi")
    return {(r.run_id, r.shot_id) for r in hit.collect()}


def test_relations(spark):
    shots = [("r", 0, 0, None), ("r", 1, 0, None), ("r", 2, 1, 1), ("r", 3, None, None), ("q", 0, 0, None), ("r", 9, 7, 55), ("q", 1, None, None), ("q", 2, None, None)]
    rows = [
        ("r", 0, "a.h5", " Train "), ("r", 1, None, "unassigned"), ("r", 2, "D:\\x\\B.H5", "te"), ("r", 3, "y/b.h5", None), ("q", 0, "c.h5", "train"), ("q", 0, "c.h5", "tr"),
        ("r", 9, "", "val"), ("q", 1, " ", "test"), ("q", 2, None, "t"), ("s", 5, "C.h5", "VALID"), (None, 1, "a.h5", "test"), ("r", None, "a.h5", "test"),
    ]
    # r0-r1 by cycle, r2 by retake, r3 by file; q0 and s5 by file across runs; blanks and single letters count for nothing
    assert found(spark, shots, rows) == {("r", 0), ("r", 1), ("r", 2), ("r", 3), ("q", 0), ("s", 5)}
    assert found(spark, shots, rows * 3) == found(spark, shots * 2, rows)
    assert found(spark, [], []) == set() and found(spark, shots, []) == set()
    assert found(spark, [], [("r", 0, "a", "train"), ("r", 0, "b", "test")]) == {("r", 0)}


def test_retakes_of_shots_known_from_rows_alone(spark):
    rows = [("r", 1, None, "train"), ("r", 2, None, "test"), ("r", 4, None, "test")]
    assert found(spark, [("r", 2, None, 1)], rows) == {("r", 1), ("r", 2)}
    assert found(spark, [("r", 2, None, 77), ("r", 1, None, 77)], rows) == set()  # a shot that isn't there relates nothing
    assert found(spark, [("r", 1, None, 4)], rows) == {("r", 1), ("r", 4)}


def test_split_names(spark):
    from pyspark.sql import functions as F

    names = {"train": 1, "TR": 1, "\tTrai ": 1, "t": 0, "trainx": 0, "validation": 2, "Va": 2, "te": 4, "test": 4, "": 0, "unassigned": 0, None: 0, "x" * 100_000: 0}
    df = spark.createDataFrame([(k,) for k in names], "x string").select("x", splits.split_bit(F.col("x")).alias("b"))
    assert {r.x: r.b for r in df.collect()} == names


def slow_greedy(sizes, shares):
    total = sum(s * c for s, c in sizes)
    need = {n: p * total for n, p in shares.items()}
    out = {}
    for s, c in sorted(sizes, reverse=True):
        for _ in range(c):
            best = max(shares, key=lambda n: need[n])
            need[best] -= s
            out[s, best] = out.get((s, best), 0) + 1
    return out, need


@pytest.mark.parametrize("seed", range(8))
def test_greedy(seed):
    g = np.random.default_rng(seed)
    sizes = [(int(s), int(c)) for s, c in zip(g.choice(400, 12, replace=False) + 1, g.integers(1, 700, 12))]
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    got = splits.greedy_counts(sizes, shares)
    _, need = slow_greedy(sizes, shares)
    total = sum(s * c for s, c in sizes)
    left = {n: p * total for n, p in shares.items()}
    for s, n, a, b in got:
        left[n] -= s * (b - a + 1)
    assert sorted(round(v, 6) for v in left.values()) == pytest.approx(sorted(need.values()), abs=max(s for s, _ in sizes) + 1e-6)
    for s, c in sizes:
        ranks = sorted(r for z, _, a, b in got if z == s for r in range(a, b + 1))
        assert ranks == list(range(1, c + 1))


def test_assignment(spark):
    g = random.Random(5)
    groups = spark.createDataFrame([(f"g{i:04d}", g.choice([0, 1, 1, 2, 5, 40])) for i in range(2000) for _ in range(2)] + [("hot", 900)], "group string, n_rows bigint")
    out = splits.assign_groups(groups, {"train": 0.6, "validation": 0.2, "test": 0.2}, rank_bins=8).toPandas()
    assert len(out) == 2001 and out.group.is_unique
    share = out.groupby("split").group_rows.sum() / out.group_rows.sum()
    assert abs(share["train"] - 0.6) < 0.001 and abs(share["test"] - 0.2) < 0.001
    assert splits.assign_groups(groups.where("false"), {"train": 1.0}).count() == 0
