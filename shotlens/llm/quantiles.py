"""Percentiles per group of very large numeric columns, by distributed multi-select.

Each task turns the rows it reads into sorted chunks, one for each group and at most ``chunk_rows`` rows.  Then, for every
group, rounds are played over the chunks, which stay where they lie:

1. a chunk proposes the median of its values that are still in the running, weighted by their number,
2. the weighted median of the proposals becomes the pivot,
3. every chunk counts its values below, at and above the pivot, and proposes a median for either side,
4. the counts are added up; a wanted rank lies below or above, where it goes on, or the pivot is its answer; a side in which
   no wanted rank lies is discarded,

until every rank is found.  Ranks that lie in the same range share its pivot.  Every third round the discarded values are cut
off the chunks.  After a first round, a range that holds at most ``rest`` values is settled by reading the ranks off.  The
answer is an element of the data, the one of rank max(1, ceil(p * n)): no error.

Only pivots, counts and medians move.  While there are at most ``broadcast_ranges`` open ranges their pivots are broadcast to the
chunks.  Where there are more, the chunks are written once as a table bucketed by group, in which a group of many chunks has
several parts, and the pivots go to the buckets.  Proposals of a group of many chunks are combined in two stages.

``summaries`` keeps, of every chunk, one value for each ``2 * error`` of its rows, with the number of rows it stands for.
Summaries of any tasks, loads or days can be put together and selected from in the same rounds: each is off by at most
half a step, so the rank of a combined answer is off by at most ``error`` of all rows (and by one row in each chunk).

Defined results: null and NaN are missing; infinities are values; a group without values, and an empty table, give no rows;
null keys form a group; ties and repeated rows count as often as they stand; other columns are ignored and may have any name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlens.session import cut, ensure_checkpoint_dir, forget, forget_path
from shotlens.sources.tables import require_columns


def _slices(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in key, and the end."""
    return np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)] if len(key) else np.zeros(1, int)


def sorted_chunks(df: DataFrame, keys: list[str], value: str, chunk_rows: int = 1 << 20, error: float = 0.0) -> DataFrame:
    """(keys..., vals array<double>, wts array<bigint>): the values of each task's rows, sorted; where error > 0 thinned, with weights. Keys are whole numbers."""
    require_columns(df, *keys, value)
    x = df.select(*[F.col(k).cast("bigint").alias(k) for k in keys], F.col(value).cast("double").alias("_v"))
    x = x.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    names = [f"_k{i}" for i in range(len(keys))]
    x = x.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_v")
    schema = pa.schema([*[(n, pa.int64()) for n in names], ("vals", pa.list_(pa.float64())), ("wts", pa.list_(pa.int64()))])

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        cols = []
        for n in names:  # null keys get a flag column of their own, so that they sort as a group
            c = t.column(n)
            cols += [c.fill_null(0).to_numpy(), c.is_null().to_numpy().astype(np.int64)]
        v = t.column("_v").to_numpy()
        order = np.lexsort([v, *cols[::-1]])
        v = v[order]
        k = np.stack([c[order] for c in cols], axis=1)
        at = _slices(k)
        n = np.diff(at)
        step = np.maximum(1, np.floor(2 * error * n)).astype(np.int64)
        kept = -(-n // step)
        off = np.r_[0, np.cumsum(kept)]
        inside = np.arange(off[-1]) - np.repeat(off[:-1], kept)
        first = inside * np.repeat(step, kept)
        width = np.minimum(np.repeat(step, kept), np.repeat(n, kept) - first)
        vals = v[np.repeat(at[:-1], kept) + first + (width - 1) // 2]
        keyed = [pa.array(np.where(k[at[:-1], 2 * i + 1] == 1, 0, k[at[:-1], 2 * i]), mask=k[at[:-1], 2 * i + 1] == 1) for i in range(len(names))]
        lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(a)) for a in (vals, width)]
        if not error:  # every value stands for one row
            lists[1] = pa.nulls(len(kept), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*keyed, *lists], schema=schema)

    def build(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= chunk_rows:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    out = x.mapInArrow(build, ", ".join(f"{n} bigint" for n in names) + ", vals array<double>, wts array<bigint>")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "vals", "wts")


def _bound(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted of each x in its own slice flat[lo:hi], all at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = flat[np.minimum(mid, len(flat) - 1)]
        up = open_ & ((v <= x) if right else (v < x))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def _weights(vals: pa.ListArray, wts: pa.ListArray) -> np.ndarray:
    """The weight of each value; where a chunk has none each is 1."""
    n = np.diff(vals.offsets.to_numpy())
    w = np.ones(n.sum(), np.int64)
    w[np.repeat(np.asarray(wts.is_valid()), n)] = wts.flatten().to_numpy()
    return w


def _in_range(b: pa.RecordBatch):
    """For a batch of chunks with their open ranges: values, weights, offsets, the chunk of each range, the ranges, and the slice of values within each."""
    vals = b.column("vals")
    off = vals.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    flat, w = vals.flatten().to_numpy(), _weights(vals, b.column("wts"))
    open_ = b.column("open")
    row = np.repeat(np.arange(b.num_rows), np.diff(open_.offsets.to_numpy()))
    items = open_.flatten()
    lo, hi = items.field("lo"), items.field("hi")
    s, e = off[row], off[row + 1]
    number = lambda c: c.fill_null(0.0).to_numpy(zero_copy_only=False)
    i0 = np.where(np.asarray(lo.is_null()), s, _bound(flat, s, e, number(lo), True))
    i1 = np.maximum(i0, np.where(np.asarray(hi.is_null()), e, _bound(flat, s, e, number(hi), False)))
    return flat, w, off, row, items, i0, i1


COUNTS = "r int, lt bigint, eq bigint, gt bigint, mid_lt double, mid_gt double"


def _count_chunk(names: list[str]):
    """Of each chunk and open range: values below, at and above the pivot, and the median of either side."""

    def play(batches):
        for b in batches:
            flat, w, _, row, items, i0, i1 = _in_range(b)
            if not len(flat):
                continue
            pivot = items.field("pivot")
            w = np.r_[0, np.cumsum(w)]  # rows before each value
            free = np.asarray(pivot.is_null())  # before the first round there is no pivot: all values stand "above"
            p = pivot.fill_null(0.0).to_numpy(zero_copy_only=False)
            a = np.where(free, i0, _bound(flat, i0, i1, p, False))
            c = np.where(free, i0, _bound(flat, i0, i1, p, True))

            def middle(x, y):
                want = (w[x] + w[y]) / 2
                m = _bound(w, x, y, want, False)  # the first value with as many rows before it
                m = np.clip(np.where(w[np.minimum(m, len(w) - 1)] > want, m - 1, m), x, np.maximum(y - 1, x))
                return np.where(y > x, flat[np.minimum(m, len(flat) - 1)], 0.0)

            lt, eq, gt = w[a] - w[i0], w[c] - w[a], w[i1] - w[c]
            pick = np.flatnonzero(lt + eq + gt > 0)
            keyed = [b.column(n).take(pa.array(row[pick])) for n in names]
            out = [*keyed, items.field("r").take(pa.array(pick)), pa.array(lt[pick]), pa.array(eq[pick]), pa.array(gt[pick]), pa.array(middle(i0, a)[pick], mask=lt[pick] == 0), pa.array(middle(c, i1)[pick], mask=gt[pick] == 0)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "r", "lt", "eq", "gt", "mid_lt", "mid_gt"])

    return play


def _read_rest(names: list[str], weighted: bool):
    """Of each chunk and open range: the values left in it, with their weights if any chunk has some."""

    def read(batches):
        for b in batches:
            flat, w, _, row, items, i0, i1 = _in_range(b)
            some = np.flatnonzero(i1 > i0)
            n = (i1 - i0)[some]
            off = np.r_[0, np.cumsum(n)]
            at = np.repeat(i0[some] - off[:-1], n) + np.arange(off[-1])
            ends = pa.array(off.astype(np.int32))
            ws = pa.ListArray.from_arrays(ends, pa.array(w[at])) if weighted else pa.nulls(len(some), pa.list_(pa.int64()))
            keyed = [b.column(k).take(pa.array(row[some])) for k in names]
            yield pa.RecordBatch.from_arrays([*keyed, items.field("r").take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(flat[at])), ws], names=[*names, "r", "vs", "ws"])

    return read


def _trim(names: list[str]):
    """Chunks without the values that no open rank can be any more."""

    def cut_off(batches):
        for b in batches:
            flat, w, off, _, _, i0, i1 = _in_range(b)
            step = np.zeros(len(flat) + 1, np.int64)
            np.add.at(step, i0, 1)
            np.add.at(step, i1, -1)
            keep = np.cumsum(step)[:-1] > 0
            left = np.r_[0, np.cumsum(keep)][off]
            rows = np.flatnonzero(np.diff(left) > 0)
            ends = pa.array(np.r_[0, left[1:][rows]].astype(np.int32))
            same = b.column("wts").null_count == b.num_rows
            wts = pa.nulls(len(rows), pa.list_(pa.int64())) if same else pa.ListArray.from_arrays(ends, pa.array(w[keep]))
            yield pa.RecordBatch.from_arrays([*[b.column(n).take(pa.array(rows)) for n in names], pa.ListArray.from_arrays(ends, pa.array(flat[keep])), wts], names=[*names, "vals", "wts"])

    return cut_off


def _weighted_median(proposals: Column, total: Column) -> Column:
    """The value at half of the weight of a list of (v, n)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v"))

    def step(acc, x):
        n = acc["n"] + x["n"]
        return F.struct(n.alias("n"), F.when(acc["v"].isNull() & (2 * n >= total), x["v"]).otherwise(acc["v"]).alias("v"))

    return F.aggregate(F.array_sort(proposals), zero, step, lambda acc: acc["v"])


class _Chunks:
    """The chunks of one selection, and how open ranges get to them."""

    def __init__(self, chunks: DataFrame, names: list[str], chunks_per_part: int, broadcast_ranges: int):
        self.names, self.limit = names, broadcast_ranges
        self.kinds = ", ".join(f"{n} bigint" for n in names)
        self.df = cut(chunks.withColumn("_id", F.monotonically_increasing_id()))
        self.path = None  # of the bucketed table, where there is one
        n = F.coalesce(F.expr("aggregate(wts, 0L, (a, x) -> a + x)"), F.size("vals").cast("bigint"))
        self.groups = cut(self.df.groupBy(*names).agg(F.sum(n).alias("n"), F.ceil(F.count("*") / chunks_per_part).cast("int").alias("salts"), F.max(F.col("wts").isNotNull()).alias("w")))
        top = self.groups.agg(F.max("salts").alias("s"), F.max("w").alias("w")).first()
        self.salts, self.weighted = top.s or 1, bool(top.w)

    def _place(self) -> None:
        """Writes the chunks bucketed by group and part of the group, so that they move once and never again."""
        spark, before = self.df.sparkSession, (self.df, self.path)
        df = self.df
        if "_b" not in df.columns:
            hot = self.groups.where("salts > 1").select(*self.names, "salts")
            df = df.join(hot, self.names, "left").withColumn("_b", F.pmod(F.xxhash64("_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
            self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.repartition(self.parts, *self.names, "_b")
        name = f"chunks_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark)}/{name}"
        df.write.bucketBy(self.parts, *self.names, "_b").format("parquet").option("path", self.path).saveAsTable(name)
        self.df = spark.table(name)
        forget_path(spark, before[1]) if before[1] else forget(before[0])

    def small(self, ranges: int) -> bool:
        return ranges <= self.limit

    def with_open(self, state: DataFrame, ranges: int) -> DataFrame:
        """names, _s, vals, wts and the open ranges of each chunk; _s is its part of a group of many chunks."""
        lists = state.groupBy(*self.names, "salts").agg(F.collect_list(F.struct("r", "lo", "hi", "pivot")).alias("open"))  # no more than there are points
        if self.path is None and not self.small(ranges):
            self._place()
        if self.path is None:
            return self.df.join(F.broadcast(lists), self.names).withColumn("_s", F.pmod(F.xxhash64("_id"), F.col("salts")).cast("int")).drop("salts")
        if self.small(ranges):
            return self.df.withColumn("_s", F.col("_b")).join(F.broadcast(lists), self.names).drop("salts")
        lists = lists.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        return self.df.join(lists.hint("shuffle_hash"), [*self.names, "_b"]).withColumn("_s", F.col("_b"))

    def trim(self, state: DataFrame, ranges: int) -> None:
        """What is discarded is no longer carried along."""
        at = self.with_open(state, ranges)
        own = "_id" if self.path is None else "_b"
        kind = "bigint" if self.path is None else "int"
        new = at.mapInArrow(_trim([*self.names, own]), f"{self.kinds}, {own} {kind}, vals array<double>, wts array<bigint>")
        if self.path is None:
            old, self.df = self.df, cut(new)
            forget(old)
        else:
            self.df = new
            self._place()

    def drop(self) -> None:
        forget_path(self.df.sparkSession, self.path) if self.path else forget(self.df)


def select_ranks(chunks: DataFrame, keys: list[str], points: list[float], rest: int = 32, chunks_per_part: int = 1024, trim_every: int = 3, broadcast_ranges: int = 500_000) -> DataFrame:
    """(keys..., p, value, n, rounds): for each group and point p the value of rank max(1, ceil(p * n)) by multi-select over chunks."""
    # null keys become a number of flags, so that plain equality holds
    names = [*[f"_k{i}" for i in range(len(keys))], "_null"]
    flags = sum((F.col(k).isNull().cast("bigint") * (1 << i) for i, k in enumerate(keys)), F.lit(0).cast("bigint"))
    c = _Chunks(chunks.select(*[F.coalesce(k, F.lit(0)).cast("bigint").alias(n) for k, n in zip(keys, names)], flags.alias("_null"), "vals", "wts"), names, chunks_per_part, broadcast_ranges)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.ceil(F.lit(float(p)) * F.col("n") - 1e-9), F.lit(1)).cast("bigint").alias("k")) for i, p in enumerate(points)])
    none = F.lit(None).cast("double")
    # a row for each open range: its ends (null where it is open to that side), its pivot, its number of rows, and the ranks in it, counted within it
    state = c.groups.select(*names, "n", "salts", F.lit(0).alias("r"), none.alias("lo"), none.alias("hi"), none.alias("pivot"), F.col("n").alias("left"), wanted.alias("ps"), none.alias("value"), F.lit(-1).alias("round"))
    cols, done, turn = state.columns, [], 0
    settles = (F.col("round") > 0) & (F.col("left") <= rest)
    ranges, n_rest = state.count(), 0

    def next_to(small: bool, s: DataFrame) -> DataFrame:
        return F.broadcast(s) if small else s

    while ranges:
        few = c.small(ranges)
        if n_rest:
            rests = state.where(settles)
            left = c.with_open(rests, n_rest).mapInArrow(_read_rest(names, c.weighted), f"{c.kinds}, r int, vs array<double>, ws array<bigint>")
            lists = left.groupBy(*names, "r").agg(F.flatten(F.collect_list("vs")).alias("vs"), *([F.flatten(F.collect_list("ws")).alias("ws")] if c.weighted else []))  # at most rest values
            if c.weighted:
                lists = lists.withColumn("vs", F.array_sort(F.arrays_zip("vs", "ws")))
                zero = F.struct(F.lit(0).cast("bigint").alias("n"), none.alias("v"))

                def pass_(k: Column):
                    return lambda acc, x: F.struct((acc["n"] + x["ws"]).alias("n"), F.when(acc["v"].isNull() & (acc["n"] + x["ws"] >= k), x["vs"]).otherwise(acc["v"]).alias("v"))

                value = F.aggregate("vs", zero, pass_(F.col("q.k")), lambda a: a["v"])
            else:
                lists = lists.withColumn("vs", F.array_sort("vs"))
                value = F.element_at("vs", F.col("q.k").cast("int"))
            got = lists.join(next_to(c.small(n_rest), rests), [*names, "r"]).withColumn("q", F.explode("ps"))
            done.append(cut(got.select(*names, F.col("q.i").alias("i"), value.alias("value"), "n", "round")))
            state = state.where(~settles)
            if not (ranges := ranges - n_rest):
                break
        if turn and turn % trim_every == 0:
            c.trim(state, ranges)
        turn += 1
        at = [*names, "_s"]
        counted = c.with_open(state, ranges).mapInArrow(_count_chunk(at), f"{c.kinds}, _s int, {COUNTS}")
        lt, gt = F.sum("lt").alias("lt"), F.sum("gt").alias("gt")
        pair = lambda v, n: F.collect_list(F.when(F.col(n) > 0, F.struct(F.col(v).alias("v"), F.col(n).alias("n"))))
        medians = [_weighted_median(F.col("below"), F.col("lt")).alias("mid_lt"), _weighted_median(F.col("above"), F.col("gt")).alias("mid_gt")]
        for by in ([at, names] if c.salts > 1 else [names]):  # many proposals of a group in two stages
            counted = counted.groupBy(*by, "r").agg(lt, F.sum("eq").alias("eq"), gt, pair("mid_lt", "lt").alias("below"), pair("mid_gt", "gt").alias("above")).select(*by, "r", "lt", "eq", "gt", *medians)
        s = counted.join(next_to(few, state), [*names, "r"])
        lt, le = F.col("lt"), F.col("lt") + F.col("eq")
        ps = lambda f: F.filter("ps", f)

        def side(lo, hi, pivot, left, those, value) -> Column:
            return F.struct(lo.alias("lo"), hi.alias("hi"), pivot.alias("pivot"), left.alias("left"), those.alias("ps"), value.alias("value"))

        sides = F.array(
            side(F.col("lo"), F.col("pivot"), F.col("mid_lt"), lt, ps(lambda q: q["k"] <= lt), none),
            side(none, none, none, F.lit(0).cast("bigint"), ps(lambda q: (q["k"] > lt) & (q["k"] <= le)), F.col("pivot")),
            side(F.coalesce("pivot", "lo"), F.col("hi"), F.col("mid_gt"), F.col("gt"), F.transform(ps(lambda q: q["k"] > le), lambda q: F.struct(q["i"].alias("i"), (q["k"] - le).alias("k"))), none),
        )
        new = s.select(*names, "n", "salts", (F.col("round") + 1).alias("round"), F.explode(sides).alias("x")).where("size(x.ps) > 0")
        new = cut(new.select(*names, "n", "salts", F.col("x.ps")[0]["i"].alias("r"), *[f"x.{k}" for k in ("lo", "hi", "pivot", "left", "ps", "value")], "round").select(*cols))
        done.append(new.where("value is not null").select(*names, F.explode("ps").alias("q"), "value", "n", "round").select(*names, "q.i", "value", "n", "round"))
        state = new.where("value is null")
        ranges, n_rest = state.agg(F.count("*"), F.count_if(settles)).first()
    c.drop()
    out = done[0] if done else state.select(*names, F.lit(0).alias("i"), "value", "n", "round")
    for x in done[1:]:
        out = out.unionByName(x)
    back = [F.when(F.col("_null").bitwiseAND(1 << i) == 0, F.col(m)).alias(k) for i, (m, k) in enumerate(zip(names, keys))]
    p = F.element_at(F.array(*[F.lit(float(x)) for x in points]), F.col("i") + 1)
    return out.select(*back, p.alias("p"), "value", "n", F.col("round").alias("rounds"))


def percentiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact percentiles of value per group."""
    return select_ranks(sorted_chunks(df, keys, value), keys, points)


def summaries(df: DataFrame, keys: list[str], value: str, error: float) -> DataFrame:
    """Mergeable summaries per group and chunk, within ``error`` of the rank."""
    return sorted_chunks(df, keys, value, error=error)


def combined_percentiles(parts: DataFrame, keys: list[str], points: list[float]) -> DataFrame:
    """Percentiles per group of ``keys`` out of summaries that were made by these or finer keys; no raw row is read again."""
    return select_ranks(parts, keys, points)
