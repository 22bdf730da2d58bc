"""Implausible readings of a measured field, found with a Kalman filter per series.

A series is what one site of one run reads in one frame and one field, in shot order.  It is forecast by a state-space
model with two local levels (an empty and an occupied site), each a random walk seen through noise:

* a reading updates the level to which its standardised innovation is smaller; beyond ``threshold`` it is flagged and
  the update withheld, so a spike never moves the forecast,
* flagged readings above and below the levels are followed apart.  Where ``settle`` of them in a row agree the nearer level
  is moved there (a lasting step), and so it is where they agree over several bursts (a level seldom taken), not only one,
* where the variance of the innovations, against a forecast frozen at the first of them, vanishes over ``stuck``
  successive readings the sensor is stuck,
* a reading of zero or less, infinite, or beyond ``full_scale`` for each pixel of the site, is impossible and not filtered.

Levels and noise start from the first ``warm`` readings of a block.  Nothing but what the filter flags can be a spike, and
nothing but what it accepts makes the range to begin with.  An exact check of the flagged readings follows: one that is no
farther from the range of the ordinary readings than the range is wide joins them; what is left outside is a spike.  Runs
of vanishing variance are checked for equal values.

Layout: rows are shuffled once, by (run, group of sites, block of shots).  A block carries ``context`` shots of its
neighbours to warm up the filter and to see runs that cross its border, so a run of any length is spread over many tasks,
and one task holds ``block_shots + 2 * context`` shots of ``sites_per_task`` sites.  The ranges of a series' blocks are
combined by an aggregate, and the flagged readings (a small share of all rows) are checked against the combined range.

Defined results: null, NaN and repeated deliveries of a key are dropped (of copies that differ, the one of the least
load_id stays); rows with a null key or shot order are no readings, and shot orders count from zero; a site missing from ``sites`` has no upper limit;
a series too short for a range (fewer than two ordinary readings) has no spikes; an empty table gives an empty result;
other columns are ignored.  A stuck run is seen across a border between blocks as long as fewer than ``context - 3``
shots in a row are missing there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.session import cut
from shotlens.sources.tables import require_columns

SERIES = ["run_id", "site_id", "frame_id", "field_name"]


@dataclass(frozen=True)
class ReadingModel:
    full_scale: float = 65535.0
    threshold: float = 4.0
    settle: int = 5
    stuck: int = 4
    drift: float = 0.05
    agree: float = 2.0
    seldom: float = 0.03
    warm: int = 64
    block_shots: int = 2048
    context: int = 64
    sites_per_task: int = 64


def start(x: np.ndarray, ok: np.ndarray, warm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two levels and the noise variance of every column of x (shots by series) from its first ``warm`` readings in ok.

    Readings far outside of the 15-85 % range are left aside; the rest is cut in two where that leaves the least variance.
    Two normal levels leave far less than a fifth of the variance, a single one about a third: then both levels are the mean.
    """
    first = ok & (np.cumsum(ok, 0) <= warm)
    n = first.sum(0)
    cols = np.arange(x.shape[1])
    s = np.sort(np.where(first, x, np.inf), axis=0)[:warm]
    low, high = (s[np.clip(np.rint(q * (n - 1)).astype(int), 0, None), cols] for q in (0.15, 0.85))
    with np.errstate(invalid="ignore"):
        wide = high - low
        keep = np.isfinite(s) & (s >= low - wide) & (s <= high + wide)
    base = np.where(n > 0, low, 0.0)
    y = np.where(keep, s - base, 0.0)
    k, t, tt = np.cumsum(keep, 0), np.cumsum(y, 0), np.cumsum(y * y, 0)
    m = np.maximum(k[-1], 1)
    left, right = np.maximum(k, 1), np.maximum(m - k, 1)
    apart = np.where(keep & (k < m), tt - t * t / left + (tt[-1] - tt) - (t[-1] - t) ** 2 / right, np.inf)
    at = np.argmin(apart, 0)
    two, one = apart[at, cols], tt[-1] - t[-1] ** 2 / m
    split = two < 0.2 * one
    a = base + np.where(split, t[at, cols] / left[at, cols], t[-1] / m)
    b = base + np.where(split, (t[-1] - t[at, cols]) / right[at, cols], t[-1] / m)
    noise = np.where(split, two, one) / np.maximum(m - 1, 1)
    return a, b, np.where(n > 0, np.maximum(noise, np.maximum((0.02 * np.where(n > 0, wide, 0.0)) ** 2, 1e-12)), 1.0)


class _Aside:
    """Flagged readings on one side of the levels: their common value, how many agree in a row and over how many bursts more than one."""

    def __init__(self, k: int):
        self.value, self.hits, self.bursts, self.since = np.full(k, np.nan), np.zeros(k, int), np.zeros(k, int), np.full(k, -(1 << 30))

    def see(self, flag: np.ndarray, v: np.ndarray, at: np.ndarray, reach: np.ndarray) -> None:
        with np.errstate(invalid="ignore"):
            same = flag & (np.abs(v - self.value) <= reach)
        fresh = flag & ~same
        again = same & (at - self.since > 4)  # the spikes of one burst stand within four readings
        self.hits = np.where(same, self.hits + 1, np.where(fresh, 1, self.hits))
        self.bursts = np.where(fresh, 0, self.bursts + again)
        self.value = np.where(same, self.value + (v - self.value) / np.maximum(self.hits, 1), np.where(fresh, v, self.value))
        self.since = np.where(again | fresh, at, self.since)

    def forget(self, which: np.ndarray) -> None:
        self.hits, self.bursts = np.where(which, 0, self.hits), np.where(which, 0, self.bursts)


def filtered(x: np.ndarray, seen: np.ndarray, plausible: np.ndarray, m: ReadingModel) -> tuple[np.ndarray, np.ndarray]:
    """The filter over all columns at once, one shot after the other: readings that it accepts, and those of vanishing innovation variance."""
    a, b, r = start(x, plausible, m.warm)
    sd = np.sqrt(r)
    q = m.drift**2 * r
    pa_, pb = r.copy(), r.copy()
    k = x.shape[1]
    rare = np.maximum(1, m.seldom * plausible.sum(0))
    sides = (_Aside(k), _Aside(k))
    at, row = np.zeros(k, int), np.zeros(k, int)  # readings so far; readings flagged in a row
    frozen, before, length = a.copy(), np.full(k, np.nan), np.zeros(k, int)
    out, still = np.zeros_like(seen), np.zeros(x.shape, int)
    for t in range(x.shape[0]):
        use = plausible[t]
        at = at + use
        v = np.where(use, x[t], a)
        pa_, pb = pa_ + q, pb + q
        da, db = v - a, v - b
        za, zb = da * da / (pa_ + r), db * db / (pb + r)
        second = zb < za
        here = seen[t]
        with np.errstate(invalid="ignore"):
            gone = here & (np.abs(x[t] - frozen - before) <= 1e-13 * np.abs(x[t]))  # no variance of the innovations since the forecast was frozen
        fresh = here & ~gone
        length = np.where(gone, length + 1, np.where(fresh, 1, length))
        frozen = np.where(fresh, np.where(second, b, a), frozen)
        before = np.where(fresh, x[t] - frozen, before)
        still[t] = np.where(here, length, 0)
        take = use & (np.minimum(za, zb) <= m.threshold**2)
        flag = use & ~take
        row = np.where(take, 0, row + use)
        if flag.any():
            above = v > (a + b) / 2
            for side, which in zip(sides, (flag & ~above, flag & above)):
                side.see(which, v, at, m.agree * np.sqrt(2.0) * sd)
                level = which & (((side.hits >= m.settle) & (row >= m.settle)) | (side.bursts >= rare))
                if level.any():
                    to_b = level & ((np.abs(a - b) < 3 * sd) | (np.abs(v - b) < np.abs(v - a)))
                    to_a = level & ~to_b
                    a, pa_ = np.where(to_a, side.value, a), np.where(to_a, r, pa_)
                    b, pb = np.where(to_b, side.value, b), np.where(to_b, r, pb)
                    out[t] |= level
                    row = np.where(level, 0, row)
                    side.forget(level)
        ka = np.where(take & ~second, pa_ / (pa_ + r), 0.0)
        kb = np.where(take & second, pb / (pb + r), 0.0)
        a, b = a + ka * da, b + kb * db
        pa_, pb = pa_ * (1 - ka), pb * (1 - kb)
        out[t] |= take
    quiet, more = np.zeros_like(seen), np.zeros(k, bool)
    for t in range(x.shape[0] - 1, -1, -1):  # all readings of a run, not only those after the variance has been gone for long enough
        quiet[t] = seen[t] & (more | (still[t] >= m.stuck))
        more = np.where(seen[t], quiet[t] & (still[t] > 1), more)
    return out, quiet


def stuck_mask(x: np.ndarray, seen: np.ndarray, least: int) -> np.ndarray:
    """Readings in runs of at least ``least`` successive readings that don't vary; unseen readings are skipped."""
    out = np.zeros_like(seen)
    with np.errstate(invalid="ignore"):
        rough = ((x[1:] == x[:-1]) & seen[1:] & seen[:-1]).any(0) | ~seen.all(0)
    for j in np.flatnonzero(rough):
        rows = np.flatnonzero(seen[:, j])
        v = x[rows, j]
        if len(v) < least or not (v[1:] == v[:-1]).any():
            continue
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        length = np.diff(np.r_[first, len(v)])
        out[rows[np.repeat(length >= least, length)], j] = True
    return out


def widened(x: np.ndarray, flagged: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges grown by every flagged reading within one width, until none is left there."""
    while True:
        w = np.where(hi >= lo, hi - lo, 0.0)
        with np.errstate(invalid="ignore"):
            near = flagged & (x >= lo - w) & (x <= hi + w)
        lo2 = np.minimum(lo, np.where(near, x, np.inf).min(0))
        hi2 = np.maximum(hi, np.where(near, x, -np.inf).max(0))
        if (lo2 == lo).all() and (hi2 == hi).all():
            return lo, hi
        lo, hi = lo2, hi2


OUT = "run_id string, site_id int, frame_id int, field_name string, shot_id int, value double, reason string, lo double, hi double"


def judge_block(fields: list[str], m: ReadingModel):
    """For one block: a row for each candidate of its own shots, and one row without shot for each series with its ordinary range."""
    schema = pa.schema([("run_id", pa.string()), ("site_id", pa.int32()), ("frame_id", pa.int32()), ("field_name", pa.string()), ("shot_id", pa.int32()), ("value", pa.float64()), ("reason", pa.string()), ("lo", pa.float64()), ("hi", pa.float64())])

    def judge(rows: pa.Table, pixels: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        run = rows.column("run_id")[0].as_py()
        col = {c: rows.column(c).to_numpy() for c in ("shot_id", "shot_order", "frame_id", "site_id", "load_id", "home")}
        order = np.argsort(-np.nan_to_num(col["load_id"].astype(float), nan=np.inf), kind="stable")  # the least load_id is written last
        shot = (col["shot_order"].astype(np.int64) << 32) + col["shot_id"]
        shots, t = np.unique(shot, return_inverse=True)
        key = (col["site_id"].astype(np.int64) << 32) + col["frame_id"]
        keys, j = np.unique(key, return_inverse=True)
        own = np.zeros(len(shots), bool)
        own[t] = col["home"].astype(bool)
        if not own.any():
            return schema.empty_table()
        site = keys >> 32
        limits = dict(zip(pixels.column("site_id").to_pylist(), pixels.column("roi_n_pixels").to_pylist()))
        limit = np.array([m.full_scale * limits[s] if limits.get(s) else np.inf for s in site.tolist()])
        k = len(keys)
        x = np.full((len(shots), k * len(fields)), np.nan)
        for i, f in enumerate(fields):
            x[t[order], i * k + j[order]] = rows.column(f).to_numpy()[order]
        seen = ~np.isnan(x)
        with np.errstate(invalid="ignore"):
            bad = seen & ((x <= 0) | (x > np.tile(limit, len(fields))) | np.isinf(x))
        fine, quiet = filtered(x, seen, seen & ~bad, m)
        still = quiet & stuck_mask(x, quiet, m.stuck)
        plausible = seen & ~bad & ~still
        fine &= plausible
        flagged = plausible & ~fine
        lo, hi = widened(x, flagged, np.where(fine, x, np.inf).min(0), np.where(fine, x, -np.inf).max(0))
        w = hi - lo
        with np.errstate(invalid="ignore"):
            far = flagged & ((x > hi + w) | (x < lo - w))
        at, ser = np.nonzero((bad | still | far) & own[:, None])
        some = np.flatnonzero(plausible.any(0))
        s = np.r_[ser, some]
        n, names = len(ser), np.array(fields, dtype=object)
        shot_id = (shots[at] & 0xFFFFFFFF).astype(np.int32)
        blank = np.full(len(some), None)
        return pa.Table.from_arrays(
            [
                pa.array([run] * len(s), pa.string()),
                pa.array(site[s % k].astype(np.int32)),
                pa.array((keys[s % k] & 0xFFFFFFFF).astype(np.int32)),
                pa.array(names[s // k], pa.string()),
                pa.array(np.r_[shot_id.astype(object), blank], pa.int32()),
                pa.array(np.r_[x[at, ser].astype(object), blank], pa.float64()),
                pa.array(np.r_[np.where(bad[at, ser], "impossible", np.where(still[at, ser], "stuck", "spike")).astype(object), blank], pa.string()),
                pa.array(np.r_[np.full(n, None), np.where(np.isfinite(lo[some]), lo[some], np.nan)], pa.float64(), from_pandas=True),
                pa.array(np.r_[np.full(n, None), np.where(np.isfinite(hi[some]), hi[some], np.nan)], pa.float64(), from_pandas=True),
            ],
            schema=schema,
        )

    return judge


def implausible_readings(rows: DataFrame, sites: DataFrame, fields: list[str], model: ReadingModel = ReadingModel()) -> DataFrame:
    """(run_id, site_id, frame_id, field_name, shot_id, value, reason) of every implausible reading; reason is impossible, stuck or spike."""
    require_columns(rows, "run_id", "shot_id", "shot_order", "frame_id", "site_id", *fields)
    m = model
    load = F.col("load_id").cast("int") if "load_id" in rows.columns else F.lit(0)
    x = rows.select(
        "run_id", F.col("shot_id").cast("int").alias("shot_id"), F.col("shot_order").cast("int").alias("shot_order"), F.col("frame_id").cast("int").alias("frame_id"), F.col("site_id").cast("int").alias("site_id"),
        F.coalesce(load, F.lit(2**31 - 1)).alias("load_id"), *[F.col(f).cast("double").alias(f) for f in fields],
    ).dropna(subset=["run_id", "shot_id", "shot_order", "frame_id", "site_id"])
    mine = F.floor(F.col("shot_order") / m.block_shots).cast("int")
    part = F.floor(F.col("site_id") / m.sites_per_task).cast("int")
    inside = F.pmod("shot_order", F.lit(m.block_shots))
    # a shot near a border also goes to the block beyond it, as context
    blocks = F.when((inside < m.context) & (mine > 0), F.array(mine, mine - 1)).when(inside >= m.block_shots - m.context, F.array(mine, mine + 1)).otherwise(F.array(mine))
    px = sites.select("run_id", F.col("site_id").cast("int").alias("site_id"), F.col("roi_n_pixels").cast("int").alias("roi_n_pixels")).dropna().groupBy("run_id", "site_id").agg(F.max("roi_n_pixels").alias("roi_n_pixels"))
    occur = x.select("run_id", part.alias("part"), mine.alias("block")).distinct()  # the blocks that have shots of their own
    px = px.withColumn("part", part).join(occur, ["run_id", "part"])
    x = x.withColumns({"part": part, "mine": mine}).withColumn("block", F.explode(blocks)).withColumn("home", (F.col("block") == F.col("mine")).cast("int")).drop("mine")
    keys = ["run_id", "part", "block"]
    judged = cut(x.groupBy(*keys).cogroup(px.groupBy(*keys)).applyInArrow(judge_block(list(fields), m), OUT))
    ranges = judged.where("shot_id is null").groupBy(*SERIES).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("blocks"))
    found = judged.where("shot_id is not null").select(*SERIES, "shot_id", "value", "reason")
    # series of one block are settled; those of several are checked against their common range until no spike lies within it
    spikes = found.where("reason = 'spike'").join(ranges.withColumnRenamed("blocks", "n"), SERIES, "left")
    settled = spikes.where("n is null or n = 1").select(*found.columns)
    open_ = spikes.where("n > 1").select(*found.columns, "lo", "hi")
    outside = (F.col("value") > F.col("hi") + (F.col("hi") - F.col("lo"))) | (F.col("value") < F.col("lo") - (F.col("hi") - F.col("lo")))
    while True:
        open_ = cut(open_)
        back = open_.where(~outside).groupBy(*SERIES).agg(F.min("value").alias("blo"), F.max("value").alias("bhi"))
        if back.isEmpty():
            break
        open_ = open_.where(outside).join(back, SERIES, "left").select(*found.columns, F.least("lo", "blo").alias("lo"), F.greatest("hi", "bhi").alias("hi"))
    return found.where("reason <> 'spike'").unionByName(settled).unionByName(open_.select(*found.columns))


def reading_rates(found: DataFrame) -> DataFrame:
    """How many readings of each run and field were flagged, by reason."""
    return found.groupBy("run_id", "field_name", "reason").agg(F.count("*").alias("n_readings"), F.countDistinct("site_id").alias("n_sites"))
