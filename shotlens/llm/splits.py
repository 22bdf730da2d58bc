"""Train, validation and test splits that keep related shots together.

``connected_groups`` is a distributed union-find.  Every task joins the links of its own partition to a local forest
(each node with the least node of its tree); a node that stands in several forests links their roots, and those links
alone go up to the next level, on fewer partitions, until no forest touches another.  Each level at least halves what can
still be linked.  A relation such as "same cycle" or "same file" is a node of its own, so a group of any size costs one link
for each member and is never brought to one task; a task of a later level gets at most ``links_per_task`` links on average.

``assign_groups`` gives groups, largest first, to the split that is furthest below its target.  Groups of one size are
interchangeable, so the driver sees only how many groups there are of each size (the number of different sizes is below
the root of twice the number of rows) and answers with ranges of ranks; the groups are ranked in parallel.

Defined results: rows with a null run or shot are no shots; a null cycle, retake or file name relates nothing, nor does a
retake of a shot that isn't there; a file name is compared without folders and letter case, and blank names count as null;
repeated rows change nothing but the row counts; a shot without relations is a group of its own; empty tables give empty
results; shots without rows belong to their group with zero rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.session import cut
from shotlens.sources.tables import require_columns

SHOT = ["run_id", "shot_id"]
#: The names of the splits, as bits 1, 2 and 4.
SPLITS = ["train", "validation", "test"]
SEP = "\x01"
#: So many ranges of ranks (at most one per split and size of group) are broadcast; more are joined by a shuffle.
MOST_RANGES = 100_000


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a-b and the least node of each one's tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            return nodes, nodes[root]
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _forests(batches):
    seen: list[pd.DataFrame] = list(batches)
    if seen:
        links = pd.concat(seen, ignore_index=True)
        if len(links):
            node, root = local_forest(links["a"].to_numpy(dtype=object), links["b"].to_numpy(dtype=object))
            yield pd.DataFrame({"node": node, "root": root})


def connected_groups(links: DataFrame, links_per_task: int = 500_000) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, text): the least node that it is linked with over any way."""
    links = links.select("a", "b").where("a is not null and b is not null")
    levels: list[DataFrame] = []
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        forest = links.mapInPandas(_forests, "node string, root string")
        level = cut(forest.groupBy("node").agg(F.collect_set("root").alias("roots")).select("node", F.array_min("roots").alias("root"), F.when(F.size("roots") > 1, F.col("roots")).alias("roots")))
        levels.append(level.select("node", "root"))
        links = level.where("roots is not null").select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
        n = links.count()
        if not n:
            break
        parts = max(1, parts // 4, -(-n // links_per_task))
        links = links.repartition(parts, "b")
    at = levels[0]
    for up in levels[1:]:
        up = up.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("higher"))
        at = at.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return at


def split_bit(label: Column) -> Column:
    """1, 2 or 4 for a label that names train, validation or test in whatever case, blanks or abbreviation of two letters or more, else 0."""
    x = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    hit = F.when(F.length(x) < 2, 0)
    for i, name in enumerate(SPLITS):
        hit = hit.when(F.lit(name).startswith(x), 1 << i)
    return F.coalesce(hit, F.lit(0))


def file_name(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.when(F.trim(name) != "", name)


def _node(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.lit(SEP), p.cast("string"))])


def shot_groups(shots: DataFrame, rows: DataFrame, shots_per_part: int = 4096, links_per_task: int = 500_000) -> DataFrame:
    """(run_id, shot_id, group, n_rows, splits): the group of each shot, its rows and the splits (bits) that its rows carry."""
    require_columns(shots, *SHOT, "cycle_index", "retake_of_shot_id")
    require_columns(rows, *SHOT, "raw_image_path", "split")
    # one pass over the rows: few different file names and labels stand in a shot
    seen = rows.where("run_id is not null and shot_id is not null").groupBy(*SHOT, "raw_image_path", "split").agg(F.count("*").alias("n"))
    seen = cut(seen.select(*SHOT, file_name(F.col("raw_image_path")).alias("file"), split_bit(F.col("split")).alias("bit"), "n"))
    plan = shots.where("run_id is not null and shot_id is not null").select(*SHOT, "cycle_index", "retake_of_shot_id").distinct()
    run, shot = F.col("run_id"), F.col("shot_id")
    me = _node("s", run, shot).alias("a")
    every = plan.select(*SHOT).unionByName(seen.select(*SHOT)).distinct()  # a shot known from its rows alone is a shot too
    retake = plan.where("retake_of_shot_id is not null").join(every.select("run_id", F.col("shot_id").alias("retake_of_shot_id")), ["run_id", "retake_of_shot_id"], "left_semi")
    block = F.floor(shot / shots_per_part).alias("block")
    links = reduce(
        DataFrame.unionByName,
        [
            plan.select("run_id", block, me, _node("s", run, shot).alias("b")),
            plan.where("cycle_index is not null").select("run_id", block, me, _node("c", run, F.col("cycle_index")).alias("b")),
            retake.select("run_id", block, me, _node("s", run, F.col("retake_of_shot_id")).alias("b")),
            seen.select("run_id", block, me, F.coalesce(_node("f", F.col("file")), _node("s", run, shot)).alias("b")).distinct(),
        ],
    )
    # neighbouring shots are related most often, so a forest over a stretch of a run leaves few links to the next level
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(seen.count() + 3 * plan.count()) // links_per_task))
    group = connected_groups(links.repartition(parts, "run_id", "block"), links_per_task)
    per = seen.groupBy(*SHOT).agg(F.sum("n").alias("n_rows"), F.expr("bit_or(bit)").alias("splits"))
    return every.withColumn("node", _node("s", run, shot)).join(group, "node").join(per, SHOT, "left").select(*SHOT, F.col("root").alias("group"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce("splits", F.lit(0)).alias("splits"))


def broken_groups(groups: DataFrame) -> DataFrame:
    """(group, n_shots, group_rows, group_splits) of the groups whose rows carry several splits."""
    g = groups.groupBy("group").agg(F.count("*").alias("n_shots"), F.sum("n_rows").alias("group_rows"), F.expr("bit_or(splits)").alias("group_splits"))
    return g.where("bit_count(group_splits) > 1")


def greedy_counts(sizes: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, first rank, last rank): what largest-first assignment to the split furthest below its target does.

    ``sizes`` has (size, number of groups).  Of many equal groups most are handed out at once: those that a split gets while
    it stays the neediest whatever the order, and the few left over one by one.
    """
    total = sum(s * c for s, c in sizes)
    names = list(shares)
    need = [shares[n] * total for n in names]
    out = []
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(names)
        if size > 0:
            order = sorted(range(len(names)), key=lambda i: -need[i])
            level = -float("inf")
            for k in range(1, len(order) + 1):  # the level to which equal groups would fill the k neediest
                flat = (sum(need[i] for i in order[:k]) - count * size) / k
                if k == len(order) or flat >= need[order[k]]:
                    level = flat
                    break
            got = [max(0, int((d - level) // size) - 1) for d in need]
        heap = [(-(d - g * size), i) for i, (d, g) in enumerate(zip(need, got))]
        heapq.heapify(heap)
        left = count - sum(got)
        if size <= 0:
            got[heap[0][1]] += left
            left = 0
        for _ in range(left):
            d, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (d + size, i))
        need = [d - g * size for d, g in zip(need, got)]
        at = 0
        for name, g in zip(names, got):
            if g:
                out.append((size, name, at + 1, at + g))
                at += g
    return out


def assign_groups(groups: DataFrame, shares: dict[str, float], rank_bins: int = 1024) -> DataFrame:
    """(group, group_rows, split) for groups (group, n_rows per member) by greedy assignment, the same on every run."""
    g = cut(groups.groupBy("group").agg(F.sum("n_rows").alias("group_rows")).withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(rank_bins)).cast("int")))
    cells = cut(g.groupBy("group_rows", "bin").agg(F.count("*").alias("n")))
    sizes = [(int(r.group_rows), int(r.n)) for r in cells.groupBy("group_rows").agg(F.sum("n").alias("n")).collect()]
    spark = groups.sparkSession
    lines = greedy_counts(sizes, shares)
    ranges = spark.createDataFrame(lines, "group_rows bigint, split string, first bigint, last bigint")
    # many groups have one size, so ranges that are few are sent to the groups rather than the groups to the ranges
    ranges = F.broadcast(ranges) if len(lines) <= MOST_RANGES else ranges
    before = F.sum("n").over(Window.partitionBy("group_rows").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    offset = cells.select("group_rows", "bin", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("group_rows", "bin").orderBy("group"))
    ranked = g.withColumn("inside", inside).join(offset, ["group_rows", "bin"]).withColumn("rank", F.col("before") + F.col("inside"))
    hit = ranked.join(ranges, "group_rows").where("rank between first and last")
    return hit.select("group", "group_rows", "split")
