"""Hidden two-state chains over the frames of a site: filtering, smoothing and Baum-Welch over all trajectories.

A trajectory is one short array per site and shot. A run that fits a task is fitted there, from all starts, until each has settled.
For larger runs the E-step runs on chunks of trajectories and returns sums for each run and start; the sums are added up and the
M-step works on one row per run, so nothing grows on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.operators.shots import finite
from shotlens.session import cut


def trajectories(clean: DataFrame, value: str) -> DataFrame:
    """(run_id, shot_id, site_id, y): the values of all frames in order, null where missing."""
    x = clean.groupBy("run_id", "shot_id", "site_id").agg(F.array_sort(F.collect_list(F.struct("frame_id", finite(value).alias("v")))).alias("s"))
    return x.select("run_id", "shot_id", "site_id", F.col("s.v").alias("y")).where(F.exists("y", lambda v: v.isNotNull()))


def emission_logs(y: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = (y - mean) / sd
    return np.where(np.isnan(y), 0.0, -0.5 * z * z - np.log(sd) - 0.9189385332046727)


def forward_backward(y: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y (n, frames); p: start (n), stay and gain (n, frames - 1), mean0, mean1, sd0, sd1 (n, frames). Log-likelihood (n), occupied (n, frames), pairs (n, frames - 1, 2, 2)."""
    n, k = y.shape
    e = np.stack([emission_logs(y, p["mean0"], p["sd0"]), emission_logs(y, p["mean1"], p["sd1"])], axis=2)
    top = e.max(axis=2, keepdims=True)
    b = np.exp(e - top)
    a = np.empty((n, k - 1, 2, 2))
    a[:, :, 1, 1], a[:, :, 1, 0], a[:, :, 0, 1], a[:, :, 0, 0] = p["stay"], 1 - p["stay"], p["gain"], 1 - p["gain"]
    f, scale = np.empty((n, k, 2)), np.empty((n, k))
    f[:, 0] = np.stack([1 - p["start"], p["start"]], axis=1) * b[:, 0]
    for t in range(k):
        if t:
            f[:, t] = np.einsum("ni,nij->nj", f[:, t - 1], a[:, t - 1]) * b[:, t]
        scale[:, t] = np.maximum(f[:, t].sum(1), 1e-300)
        f[:, t] /= scale[:, t, None]
    back = np.ones((n, k, 2))
    pairs = np.empty((n, k - 1, 2, 2))
    for t in range(k - 2, -1, -1):
        right = b[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None]
        pairs[:, t] = f[:, t, :, None] * a[:, t] * right[:, None, :]
        back[:, t] = np.einsum("nij,nj->ni", a[:, t], right)
    post = f * back
    post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
    return np.log(scale).sum(1) + top[:, :, 0].sum(1), post[:, :, 1], pairs


PARAMS = ["start", "stay", "gain", "mean0", "mean1", "sd0", "sd1"]


def _by_length(b: pa.RecordBatch):
    """The trajectories of a batch by number of frames k, as matrices: (k, rows, y, parameters)."""
    lists = {c: b.column(c) for c in ["y", *PARAMS[1:]]}
    off = {c: x.offsets.to_numpy() for c, x in lists.items()}
    flat = {c: x.values.to_numpy(zero_copy_only=False).astype(float) for c, x in lists.items()}
    length = np.diff(off["y"])
    start = b.column("start").to_numpy(zero_copy_only=False).astype(float)
    for k in np.unique(length):
        rows = np.flatnonzero(length == k)
        take = lambda c, n: flat[c][off[c][rows][:, None] + np.arange(n)]  # noqa: E731,B023
        yield int(k), rows, take("y", k), {"start": start[rows]} | {c: take(c, k - 1 if c in ("stay", "gain") else k) for c in PARAMS[1:]}


def first_guess(traj: DataFrame) -> DataFrame:
    """One row per run: quartiles of each frame as levels."""
    x = traj.select("run_id", F.posexplode("y").alias("frame", "v"))
    q = x.groupBy("run_id", "frame").agg(F.percentile_approx("v", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias("q"), F.stddev_pop("v").alias("s"))
    sd = F.greatest(F.coalesce("s", F.lit(1.0)) / 2, F.lit(1e-6))
    q = q.select("run_id", "frame", F.coalesce(F.col("q")[0], F.lit(0.0)).alias("m0"), F.coalesce(F.greatest(F.col("q")[1], F.col("q")[0] + 1e-6), F.lit(1.0)).alias("m1"), sd.alias("sd"))
    arr = q.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("frame", "m0", "m1", "sd"))).alias("a"))
    return arr.select("run_id", F.lit(0.5).alias("start"), F.transform("a", lambda x: F.lit(0.9)).alias("stay"), F.transform("a", lambda x: F.lit(0.02)).alias("gain"), F.col("a.m0").alias("mean0"), F.col("a.m1").alias("mean1"), F.col("a.sd").alias("sd0"), F.col("a.sd").alias("sd1"), F.lit(None).cast("double").alias("log_likelihood"), F.lit(0).cast("bigint").alias("n"))


STARTS, ROUNDS, TOLERANCE, IN_TASK, CHUNK = 8, 300, 1e-7, 250_000, 25_000
FLOOR = 1e-3  # least sd of a level, as a part of the distance of the quartiles
RUNNING, SETTLED, FAILED, SPENT = 0.0, 1.0, 2.0, 3.0
# A run's fits are one matrix, a row for each start: log-likelihood, state, rounds, start, then stay, gain, mean0, mean1, sd0, sd1 of all frames; the means are from the run's centre.
HEAD = 4


def begin(guess: dict[str, np.ndarray], starts: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The fits before the first round, the centre of each frame and the least sd. The first start is the guess, the others are moved from it as in the reference."""
    m0, m1, k, g = guess["mean0"], guess["mean1"], len(guess["mean0"]), np.random.default_rng(0)
    scale = max(float((m1 - m0).mean()), 1e-6)
    moved = lambda p, by, *n: 1 / (1 + np.exp(-(np.log(p / (1 - p)) + g.normal(0, by, *n))))
    rows = [[-np.inf, RUNNING, 0, guess["start"], *guess["stay"], *guess["gain"], *np.zeros(k), *(m1 - m0), *guess["sd0"], *guess["sd1"]]]
    for _ in range(starts - 1):
        low = g.normal(0, 0.08 * scale, k)
        high = low + np.maximum((m1 - m0) * np.exp(g.normal(0, 0.2, k)), 0.02 * scale)
        rows.append([-np.inf, RUNNING, 0, moved(guess["start"], 0.5), *moved(guess["stay"], 0.6, k), *moved(guess["gain"], 0.5, k), *low, *high, *(guess["sd0"] * np.exp(g.normal(0, 0.2, k))), *(guess["sd1"] * np.exp(g.normal(0, 0.2, k)))])
    return np.array(rows, float), m0, FLOOR * scale


def expected(y: np.ndarray, length: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """E-step of some starts over the trajectories y (frames, n; from the centre, NaN where missing or past the length): per start the log-likelihood, the sites that start occupied, and per frame g, gx, gxx, h, hx, hxx, p11, p10, p01, p00."""
    k, n = y.shape
    start, (stay, gain, m0, m1, s0, s1) = fits[:, 3, None], fits[:, HEAD:].reshape(len(fits), 6, k).transpose(1, 2, 0)[..., None]
    out = np.zeros((len(fits), 2 + 10 * k))
    sums = out[:, 2:].reshape(len(fits), k, 10)
    ragged = length.min() < k
    width = max(256, 16_384 // len(fits))
    for at in range(0, n, width):
        v = y[:, at : at + width]
        seen = ~np.isnan(v)
        v, seen, f, prior = np.where(seen, v, 0.0), seen.astype(float), [], []
        for t in range(k):
            z0, z1 = (v[t] - m0[t]) / s0[t], (v[t] - m1[t]) / s1[t]
            l0 = (-0.5 * z0 * z0 - np.log(s0[t]) - 0.9189385332046727) * seen[t]
            odds = np.exp(np.clip(0.5 * (z0 * z0 - z1 * z1) + np.log(s0[t] / s1[t]), -700, 700) * seen[t])
            a = np.broadcast_to(start, z0.shape) if not t else gain[t - 1] + f[-1] * (stay[t - 1] - gain[t - 1])
            up = a * odds
            scale = 1 - a + up
            out[:, 0] += (np.log(scale) + l0).sum(1)
            prior.append(a)
            f.append(up / scale)
        post = f[-1]
        for t in range(k - 1, -1, -1):
            if t < k - 1:
                p11 = post * (f[t] * stay[t] / prior[t + 1])
                p10 = (1 - post) * (f[t] * (1 - stay[t]) / (1 - prior[t + 1]))
                within = (length[at : at + width] > t + 1).astype(float) if ragged else np.ones(v.shape[1])
                to = post @ within
                sums[:, t, 6] += (c11 := p11 @ within)
                sums[:, t, 7] += (c10 := p10 @ within)
                sums[:, t, 8] += to - c11
                sums[:, t, 9] += within.sum() - to - c10
                post = p11 + p10
            parts = np.stack([seen[t], v[t], v[t] * v[t]], 1)
            sums[:, t, 0:3] += post @ parts
            sums[:, t, 3:6] += (1 - post) @ parts
        out[:, 1] += post.sum(1)
    return out


def advance(fits: np.ndarray, active: np.ndarray, sums: np.ndarray, n: int, floor: float, rounds: int, tolerance: float) -> None:
    """Ends the starts whose log-likelihood gained no more than the tolerance for each trajectory, that lost a level or have had all their rounds; M-step of the others."""
    k = (sums.shape[1] - 2) // 10
    grown = sums[:, 0] - fits[active, 0]
    fits[active, 0] = sums[:, 0]
    fits[active, 1] = np.where(~np.isfinite(sums[:, 0]) | (grown < -np.maximum(1e-7, 1e-9 * np.abs(sums[:, 0]))), FAILED, np.where(grown <= tolerance * n, SETTLED, np.where(fits[active, 2] >= rounds, SPENT, RUNNING)))
    go = fits[active, 1] == RUNNING
    active, first, s = active[go], sums[go, 1], sums[go, 2:].reshape(-1, k, 10)
    g, gx, gxx, h, hx, hxx, p11, p10, p01, p00 = s.transpose(2, 0, 1)
    old = fits[active, HEAD:].reshape(-1, 6, k)
    empty = g + h <= 0  # a frame without values keeps its levels
    lost = ((np.minimum(g, h) <= 1e-8) & ~empty).any(1)
    over = lambda a, b: a / np.maximum(b, 1e-12)
    keep = lambda x: np.clip(x, 1e-6, 1 - 1e-6)
    m0, m1 = over(hx, h), over(gx, g)
    new = np.stack([keep(over(p11, p11 + p10)), keep(over(p01, p01 + p00)), m0, m1, np.maximum(np.sqrt(np.maximum(over(hxx, h) - m0 * m0, 0)), floor), np.maximum(np.sqrt(np.maximum(over(gxx, g) - m1 * m1, 0)), floor)], 1)
    new[:, 2:] = np.where(empty[:, None], old[:, 2:], new[:, 2:])
    lost |= (new[:, 3] <= new[:, 2]).any(1)
    fits[active[lost], 1] = FAILED
    ok = active[~lost]
    fits[ok, 2] += 1
    fits[ok, 3] = keep(first[~lost] / n)
    fits[ok, HEAD:] = new[~lost].reshape(len(ok), 6 * k)


def best(fits: np.ndarray, centre: np.ndarray) -> tuple:
    """The likeliest of the settled starts, or of all if none settled: parameters, log-likelihood, settled, rounds, number of the start, settled starts."""
    settled = fits[:, 1] == SETTLED
    i = int(np.where(settled | ~settled.any(), np.nan_to_num(fits[:, 0], nan=-np.inf, posinf=-np.inf), -np.inf).argmax())
    stay, gain, m0, m1, s0, s1 = fits[i, HEAD:].reshape(6, -1)
    return (float(fits[i, 3]), stay, gain, m0 + centre, m1 + centre, s0, s1, float(fits[i, 0]), bool(settled[i]), int(fits[i, 2]), i, int(settled.sum()))


def matrix(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, n) with NaN where missing or past the end, and the lengths."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, off = lists.values.to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
    length, y = np.diff(off), np.full((k, len(lists)), np.nan)
    for t in range(k):
        y[t, length > t] = flat[off[:-1][length > t] + t]
    y[~np.isfinite(y)] = np.nan
    return y, length


def _guess(row: dict) -> dict[str, np.ndarray]:
    return {c: row[c] if c == "start" else np.array(row[c], float) for c in PARAMS}


FITS = "run_id string, start double, stay array<double>, gain array<double>, mean0 array<double>, mean1 array<double>, sd0 array<double>, sd1 array<double>, log_likelihood double, converged boolean, rounds int, best_start int, n_converged int, n bigint"
FIT_TYPES = pa.schema([("run_id", pa.string()), ("start", pa.float64()), *[(c, pa.list_(pa.float64())) for c in PARAMS[1:]], ("log_likelihood", pa.float64()), ("converged", pa.bool_()), ("rounds", pa.int32()), ("best_start", pa.int32()), ("n_converged", pa.int32()), ("n", pa.int64())])


def _table(run_id: str, fits: np.ndarray, centre: np.ndarray, n: int) -> pa.Table:
    row = [run_id, *best(fits, centre), n]
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, FIT_TYPES)], schema=FIT_TYPES)


def baum_welch(traj: DataFrame, rounds: int = ROUNDS, starts: int = STARTS, tolerance: float = TOLERANCE, in_task: int = IN_TASK) -> DataFrame:
    """The likeliest chain of each run over several starts: parameters, their log-likelihood, whether it settled, after how many rounds, the start and how many starts settled.

    A start settles when a round gains no more than the tolerance for each trajectory; it then leaves the rounds. It ends unsettled
    after all rounds, or when a level loses its weight or falls below the other; such a start is only taken if none settled.
    Runs of up to in_task trajectories are fitted whole, each in a task; larger ones by rounds of sums over chunks of trajectories.
    """
    traj = cut(traj.select("run_id", "y"))
    guess = cut(first_guess(traj).drop("n", "log_likelihood").join(traj.groupBy("run_id").agg(F.count("*").alias("n")), "run_id"))
    small, large = guess.where(F.col("n") <= in_task), guess.where(F.col("n") > in_task)

    def fit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return FIT_TYPES.empty_table()
        row = right.to_pylist()[0]
        fits, centre, floor = begin(_guess(row), starts)
        y, length = matrix(left.column("y"), len(centre))
        y -= centre[:, None]
        while len(active := np.flatnonzero(fits[:, 1] == RUNNING)):
            advance(fits, active, expected(y, length, fits[active]), row["n"], floor, rounds, tolerance)
        return _table(row["id"], fits, centre, row["n"])

    fitted = traj.join(small.select("run_id"), "run_id", "left_semi").groupBy("run_id").cogroup(small.withColumnRenamed("run_id", "id").groupBy("id")).applyInArrow(fit, FITS)
    return cut(fitted if large.isEmpty() else fitted.unionByName(_by_rounds(traj, large, rounds, starts, tolerance)))


def _by_rounds(traj: DataFrame, guess: DataFrame, rounds: int, starts: int, tolerance: float) -> DataFrame:
    """The same fits for runs of which a task can't hold all trajectories."""
    state_kinds = "run_id string, n bigint, floor double, centre array<double>, fits binary, active int"
    state_types = pa.schema([("run_id", pa.string()), ("n", pa.int64()), ("floor", pa.float64()), ("centre", pa.list_(pa.float64())), ("fits", pa.binary()), ("active", pa.int32())])
    unpack = lambda b, k: np.frombuffer(b, float).reshape(-1, HEAD + 6 * k).copy()

    def row_of(run_id: str, n: int, floor: float, centre: np.ndarray, fits: np.ndarray) -> list:
        return [run_id, n, floor, centre, fits.tobytes(), int((fits[:, 1] == RUNNING).sum())]

    def start(batches):
        for b in batches:
            for row in b.to_pylist():
                fits, centre, floor = begin(_guess(row), starts)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row_of(row["run_id"], row["n"], floor, centre, fits), state_types)], schema=state_types)

    def pack(key: tuple, x: pa.Table) -> pa.Table:
        k = int(np.diff(x.column("y").combine_chunks().offsets.to_numpy()).max())
        y, length = matrix(x.column("y"), k)
        return pa.table({"run_id": [key[0].as_py()], "k": pa.array([k], pa.int32()), "y": pa.array([y.tobytes()], pa.binary()), "length": pa.array([length.astype(np.int64).tobytes()], pa.binary())})

    def e_step(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                centre = np.array(row["centre"])
                length = np.frombuffer(row["length"], np.int64)
                y = np.full((len(centre), len(length)), np.nan)
                y[: row["k"]] = np.frombuffer(row["y"], float).reshape(row["k"], -1)
                fits = unpack(row["fits"], len(centre))
                total[row["run_id"]] = total.get(row["run_id"], 0.0) + expected(y - centre[:, None], length, fits[fits[:, 1] == RUNNING])
        for run_id, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([run_id]), pa.array([s.tobytes()], pa.binary())], names=["run_id", "sums"])

    def m_step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        fits = unpack(row["fits"], len(row["centre"]))
        active = np.flatnonzero(fits[:, 1] == RUNNING)
        if len(active):
            sums = sum(np.frombuffer(b, float) for b in left.column("sums").to_pylist()).reshape(len(active), -1)
            advance(fits, active, sums, row["n"], row["floor"], rounds, tolerance)
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row_of(row["id"], row["n"], row["floor"], row["centre"], fits), state_types)], schema=state_types)

    def done(batches):
        for b in batches:
            for row in b.to_pylist():
                centre = np.array(row["centre"])
                yield from _table(row["run_id"], unpack(row["fits"], len(centre)), centre, row["n"]).to_batches()

    salted = traj.join(guess.select("run_id", "n"), "run_id").withColumn("chunk", F.floor(F.rand(0) * F.ceil(F.col("n") / CHUNK)))
    chunks = cut(salted.groupBy("run_id", "chunk").applyInArrow(pack, "run_id string, k int, y binary, length binary"))
    state = cut(guess.mapInArrow(start, state_kinds))
    for _ in range(rounds + 1):
        running = state.where("active > 0")
        if running.isEmpty():
            break
        sums = chunks.join(running.select("run_id", "centre", "fits"), "run_id").mapInArrow(e_step, "run_id string, sums binary")
        state = cut(sums.groupBy("run_id").cogroup(state.withColumnRenamed("run_id", "id").groupBy("id")).applyInArrow(m_step, state_kinds))
    return state.mapInArrow(done, FITS)


def smoothed(traj: DataFrame, params: DataFrame) -> DataFrame:
    """Each trajectory with its log-likelihood and the probability that the site is occupied, frame by frame."""

    def run(batches):
        for b in batches:
            for k, rows, y, p in _by_length(b):
                ll, post, _ = forward_backward(y, p)
                pick = pa.array(rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(post.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pick) for c in ("run_id", "shot_id", "site_id")], pa.array(ll), lists], names=["run_id", "shot_id", "site_id", "log_likelihood", "occupied"])

    x = traj.join(params.select("run_id", *PARAMS), "run_id").select("run_id", "shot_id", "site_id", "y", *PARAMS)
    return x.mapInArrow(run, "run_id string, shot_id int, site_id int, log_likelihood double, occupied array<double>")
