"""Queries of models that are fitted to training shots, chosen on validation shots and resampled by shots, cycles or blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators import chains, events, holds, retention, survival
from shotlens.operators import summaries as S
from shotlens.operators.sensitivity import shot_blocks
from shotlens.plans.core import _CALLS, _PAIRS, BRIGHT_RATE, DARK_RATE, VALUE, _calls, _clean, half_up
from shotlens.session import cut
from shotlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
GAP_S = 0.01


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = half_up(sql)
        return f

    return keep


def _cells(spark: SparkSession, d: str, family: str, calls: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(dataset_id, run_id, shot_id, split, cycle_index, interval, t, exposure_s, pulses, known, successes, trials) of a family of models."""
    calls = _calls(spark, d) if calls is None and counts is None else calls
    total = lambda x, by, s, n: x.groupBy("run_id", "shot_id", *by).agg(F.sum(s).alias("successes"), F.sum(n).alias("trials"))
    runs = table(spark, d, "runs").select("run_id", "dataset_id", "sweep_axis", "sequence_type", (F.col("exposure_ms") / 1000.0).alias("exposure_s"))
    shots = table(spark, d, "shots").select("run_id", "shot_id", "split", "cycle_index", F.col("sweep_value_s").alias("t"))
    if family == "repeated":
        runs, shots = runs.where("sequence_type = 'repeated_imaging' and exposure_s > 0"), shots.withColumn("t", F.lit(0.0))
        if counts is None:
            c = S.binomial_cells(calls.withColumn("interval", F.lit("all")), "occupied", ["interval", "frame_id"])
        else:
            c = total(counts.withColumn("interval", F.lit("all")), ["interval", "frame_id"], "occupied", "called")
        c = c.withColumn("pulses", F.col("frame_id") + 1)
        known = -(BRIGHT_RATE * F.col("exposure_s") * F.col("pulses") + DARK_RATE * GAP_S * (F.col("pulses") - 1))
    else:
        runs, known = runs.where(F.col("sweep_axis") == ("dark_hold_s" if family == "dark" else "bright_wait_s")), F.lit(0.0)
        if family == "bright" and counts is not None:
            c = total(counts.where("frame_id = 0").withColumn("interval", F.lit("first")), ["interval"], "occupied", "called")
        elif family == "bright":
            c = S.binomial_cells(calls.where("frame_id = 0").withColumn("interval", F.lit("first")), "occupied", ["interval"])
        else:
            if counts is None:
                c = S.binomial_cells(events.retention_events(calls), "retained", ["interval"])
            else:
                c = total(counts.where("at_risk > 0").withColumn("interval", events.interval_name("frame_id", "next_frame")), ["interval"], "retained", "at_risk")
            c = c.where("interval = '0->1'") if family == "control" else c
        c = c.withColumn("pulses", F.lit(1))
    x = c.join(runs, "run_id").join(shots, ["run_id", "shot_id"])
    return x.select("dataset_id", "run_id", "shot_id", "split", "cycle_index", "interval", "t", "exposure_s", F.col("pulses").cast("int").alias("pulses"), known.alias("known"), "successes", "trials")


def _group(family: str) -> list[str]:
    return ["dataset_id"] if family == "repeated" else ["run_id"]


def _models(spark: SparkSession, d: str, family: str) -> DataFrame:
    cells, by = cut(_cells(spark, d, family)), _group(family)
    return retention.compare(cells, cut(retention.fit_candidates(cells, by, family)), by, family)


@query()
def dark_models(spark: SparkSession, d: str) -> DataFrame:
    """One rate in the dark, one for the first interval and one for the others, or one for each: fitted on train, chosen on validation."""
    return _models(spark, d, "dark")


@query()
def bright_models(spark: SparkSession, d: str) -> DataFrame:
    """Decay over the wait in light without or with a floor."""
    return _models(spark, d, "bright")


@query()
def control_models(spark: SparkSession, d: str) -> DataFrame:
    """Retention after a wait, flat or falling."""
    return _models(spark, d, "control")


@query()
def repeated_models(spark: SparkSession, d: str) -> DataFrame:
    """What further pulses cost beyond the known losses, for all repeated-imaging runs of a data set together."""
    return _models(spark, d, "repeated")


_SHOT = "sh as (select run_id, shot_id, split, cycle_index, sweep_value_s as t from shots), ru as (select run_id, dataset_id, sweep_axis, sequence_type, exposure_ms / 1000.0 as exposure_s from runs)"
_TIMED = "t is not null and not isnan(t)"
_FAMILY_ROWS = f"""{_PAIRS}, {_SHOT},
fr as (select 'dark' as family, p.run_id as group_id, split, count(*) as n from pairs p join ru using (run_id) join sh using (run_id, shot_id) where occupied = 1 and sweep_axis = 'dark_hold_s' and {_TIMED} group by all
 union all select 'control', p.run_id, split, count(*) from pairs p join ru using (run_id) join sh using (run_id, shot_id) where occupied = 1 and "interval" = '0->1' and sweep_axis = 'bright_wait_s' and {_TIMED} group by all
 union all select 'bright', c.run_id, split, count(*) from calls c join ru using (run_id) join sh using (run_id, shot_id) where frame_id = 0 and sweep_axis = 'bright_wait_s' and {_TIMED} group by all
 union all select 'repeated', dataset_id, split, count(*) from calls c join ru using (run_id) join sh using (run_id, shot_id) where sequence_type = 'repeated_imaging' and exposure_s > 0 group by all)"""


@query(f"""with {_FAMILY_ROWS} select family, group_id, coalesce(sum(n) filter (split = 'train'), 0)::bigint as n_train, coalesce(sum(n) filter (split = 'validation'), 0)::bigint as n_validation, true as richer_fits_as_well, true as one_selected, true as as_by_grid from fr group by all""")
def model_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every comparison must keep: all rows counted, a richer model fits its training rows at least as well, one model is selected, and the optimum is that of an independent search."""
    calls = cut(_calls(spark, d))
    out = None
    for family, names in retention.FAMILIES.items():
        cells, by = cut(_cells(spark, d, family, calls)), _group(family)
        fits = cut(retention.fit_candidates(cells, by, family))
        best = retention.compare(cells, fits, by, family).groupBy(*by).agg(F.count_if("selected").alias("k"))
        # each candidate of the dark family holds the one before; so do the others, but for the boundaries and exposures
        inner = {"factor_by_boundary": "common_factor"} | {b: a for a, b in zip(names, names[1:]) if b != "factor_by_boundary"}
        nll = fits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("candidate", F.coalesce("train_nll", F.lit(float("nan")))))).alias("m"))
        worse = [F.coalesce(F.col("m")[b] > F.col("m")[a] + 1e-5 * F.abs(F.col("m")[a]) + 1e-6, F.lit(False)) & ~F.isnan(F.col("m")[b]) & ~F.isnan(F.col("m")[a]) for b, a in inner.items()]
        nll = nll.select(*by, "m", (~F.greatest(*worse, F.lit(False))).alias("richer"))
        n = cells.where("t is not null and not isnan(t)").groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("split") == x, F.col("trials"))), F.lit(0)).alias(f"n_{x}") for x in ("train", "validation")])
        x = n.join(nll, by, "left").join(best, by, "left")
        if family in ("dark", "bright"):
            grid = survival.fit_groups(cells.where("split = 'train'"), by, "t", "interval").select(*by, "nll", "at_edge")
            x = x.join(grid, by, "left").withColumn("same", F.coalesce(F.abs(F.col("nll") - F.col("m")[names[0]]) <= 1e-4 * F.col("nll") + 1e-3, F.lit(True)) | F.isnan(F.col("m")[names[0]]))
        else:
            x = x.withColumn("same", F.lit(True))
        x = x.select(F.lit(family).alias("family"), F.col(by[0]).alias("group_id"), "n_train", "n_validation", F.coalesce("richer", F.lit(True)).alias("richer_fits_as_well"), (F.coalesce("k", F.lit(1)) == 1).alias("one_selected"), F.col("same").alias("as_by_grid"))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"""with {_PAIRS}, {_SHOT}, c as (select p.run_id, split, sum(next_call) as s, count(*) as n from pairs p join ru using (run_id) join sh using (run_id, shot_id) where occupied = 1 and "interval" = '0->1' and sweep_axis = 'bright_wait_s' and {_TIMED} group by all),
t as (select run_id, s, n, greatest(s / n, 1e-9) as q from c where split = 'train'), v as (select run_id, s, n from c where split = 'validation')
select run_id, round(q, 5) as level, round(-(t.s * ln(least(q, 1 - 1e-9)) + (t.n - t.s) * ln(1 - least(q, 1 - 1e-9))), 3) as train_nll, round(-(v.s * ln(least(q, 1 - 1e-9)) + (v.n - v.s) * ln(1 - least(q, 1 - 1e-9))) / v.n, 5) as validation_mean_nll from t left join v using (run_id)""")
def control_levels(spark: SparkSession, d: str) -> DataFrame:
    """The flat model has a closed form."""
    cells = cut(_cells(spark, d, "control"))
    fits = cut(retention.fit_candidates(cells, ["run_id"], "control"))
    flat = fits.where("candidate = 'flat' and parameters is not null").select("run_id", rounded(F.col("parameters")["level__0->1"], 5).alias("level"), rounded("train_nll", 3).alias("train_nll"))
    v = retention.scored(cells.where("split = 'validation'"), fits, ["run_id"]).where("candidate = 'flat'").groupBy("run_id").agg(rounded(F.sum("nll") / F.sum("trials"), 5).alias("validation_mean_nll"))
    return flat.join(v, "run_id", "left")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, shot_id, frame_id, next_frame, occupied, called, retained, at_risk): all that the cells of the families need, from one pass over the calls."""
    w = Window.partitionBy("run_id", "shot_id", "site_id").orderBy("frame_id")
    x = _calls(spark, d).select("run_id", "shot_id", "site_id", "frame_id", "occupied").withColumns({"next_frame": F.lead("frame_id").over(w), "next_call": F.lead("occupied").over(w)})
    held = F.when(F.col("occupied") == 1, F.col("next_call"))
    return cut(x.groupBy("run_id", "shot_id", "frame_id", "next_frame").agg(F.sum("occupied").alias("occupied"), F.count("occupied").alias("called"), F.sum(held).alias("retained"), F.count(held).alias("at_risk")))


def _training(spark: SparkSession, d: str, family: str, counts: DataFrame) -> DataFrame:
    cells = _cells(spark, d, family, counts=counts).where("split = 'train'")
    return cut(cells.join(shot_blocks(table(spark, d, "shots")), ["run_id", "shot_id"])) if family == "repeated" else cut(cells)


RESAMPLED = [("dark", "shared", ["run_id", "shot_id"]), ("dark", "shared", ["run_id", "cycle_index"]), ("bright", "no_floor", ["run_id", "shot_id"]), ("bright", "no_floor", ["run_id", "cycle_index"]), ("control", "flat", ["run_id", "shot_id"]), ("repeated", "common_factor", ["run_id", "shot_id"]), ("repeated", "common_factor", ["run_id", "shot_block"])]


@query()
def model_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the plain models' parameters from 1,000 replicates of whole shots, whole cycles, or blocks of 20 shots."""
    counts, out, known = _counts(spark, d), None, {}
    for family, candidate, unit in RESAMPLED:
        by = _group(family)
        if family not in known:
            cells = _training(spark, d, family, counts)
            known[family] = cells, cut(retention.fit_candidates(cells, by, family, candidate))
        cells, fits = known[family]
        x = retention.resampled_intervals(cells, fits, by, candidate, unit)
        x = x.select(F.lit(family).alias("family"), F.lit(unit[-1]).alias("unit"), F.col(by[0]).alias("group_id"), *[c for c in x.columns if c not in by])
        out = x if out is None else out.unionByName(x)
    return out


@query()
def draw_correlations(spark: SparkSession, d: str) -> DataFrame:
    """How the parameters of the dark model go together over its replicates."""
    draws = cut(retention.resampled_parameters(_training(spark, d, "dark", _counts(spark, d)), ["run_id"], "shared", ["run_id", "shot_id"]))
    return retention.parameter_correlations(draws, ["run_id"])


@query()
def retention_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of the dark model over 60 and of the bright model over 80 times."""
    counts, unit = _counts(spark, d), ["run_id", "shot_id"]
    a = retention.resampled_bands(_training(spark, d, "dark", counts), ["run_id"], "shared", unit, "level__0->1", "rate", [2.5 * i / 59 for i in range(60)]).withColumn("family", F.lit("dark"))
    b = retention.resampled_bands(_training(spark, d, "bright", counts), ["run_id"], "no_floor", unit, "level__first", "rate", [2.0 * i / 79 for i in range(80)]).withColumn("family", F.lit("bright"))
    return a.unionByName(b).select("family", "run_id", rounded("t", 6).alias("t"), "lower", "median", "upper")


def _by_dataset(spark: SparkSession, d: str, family: str, candidate: str, parameter: str, name: str, counts: DataFrame) -> DataFrame:
    """(dataset_id, replicate, name): the mean over a data set's runs, and over those of all data sets ("all"), in each replicate."""
    runs = table(spark, d, "runs").select("run_id", "dataset_id")
    own = cut(retention.resampled_values(_training(spark, d, family, counts), _group(family), candidate, ["run_id", "shot_id"], parameter))
    own = own.select(own.columns[0], F.posexplode("v").alias("replicate", "v")).where(~F.isnan("v"))
    own = own if "dataset_id" in own.columns else own.join(runs, "run_id")
    own = own.select("dataset_id", "replicate", "v")
    return own.unionByName(own.withColumn("dataset_id", F.lit("all"))).groupBy("dataset_id", "replicate").agg(F.avg("v").alias(name))


@query()
def rate_ratio_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The rate in light against the rate in the dark in each data set that has runs of both, resampled apart."""
    counts = _counts(spark, d)
    return retention.rate_ratios(_by_dataset(spark, d, "bright", "no_floor", "rate", "rate", counts), _by_dataset(spark, d, "dark", "shared", "rate", "rate", counts), ["dataset_id"])


@query()
def loss_budget_intervals(spark: SparkSession, d: str) -> DataFrame:
    """What light, gaps and further readouts cost over five frames, with intervals from independent draws of the two rates and the factor."""
    counts, runs = _counts(spark, d), table(spark, d, "runs")
    parts = [("bright", "no_floor", "rate", "bright"), ("dark", "shared", "rate", "dark"), ("repeated", "common_factor", "factor__common", "factor")]
    lists = [_by_dataset(spark, d, *x, counts).groupBy("dataset_id").agg(F.array_sort(F.collect_list(x[-1])).alias(x[-1])) for x in parts]  # as many as replicates
    e = runs.where("sequence_type = 'repeated_imaging' and exposure_ms > 0").select("dataset_id", (F.col("exposure_ms") / 1000.0).alias("exposure_s"))
    x = e.unionByName(e.withColumn("dataset_id", F.lit("all"))).distinct()
    for y in lists:
        x = x.join(y, "dataset_id")
    return retention.budget_intervals(x, ["dataset_id"])


@query(f"""with r as (select distinct dataset_id, exposure_ms / 1000.0 as exposure_s, n_frames from runs where exposure_ms > 0 and n_frames >= 1), t as (select unnest([0.1, 0.2, 0.4]::double[]) as total_s),
x as (select dataset_id, total_s, exposure_s, round_even(total_s / exposure_s, 0)::int as pulses, max(n_frames) as n_frames from r, t where abs(round_even(total_s / exposure_s, 0) * exposure_s - total_s) < 1e-9 group by all),
s as (select dataset_id, total_s, exposure_s, pulses, exp(-{BRIGHT_RATE} * total_s - {DARK_RATE} * {GAP_S} * (pulses - 1)) as survival from x where pulses between 1 and n_frames),
b as (select *, arg_min(survival, pulses) over (partition by dataset_id, total_s) as base from s)
select dataset_id, total_s, exposure_s, pulses, round(survival, 9) as survival, round(survival - base, 9) as difference, round(survival / base, 9) as ratio from b""")
def matched_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Survival of the exposures of a data set at equal light, against the one with the fewest pulses."""
    runs = table(spark, d, "runs").where("exposure_ms > 0 and n_frames >= 1").select("dataset_id", (F.col("exposure_ms") / 1000.0).alias("exposure_s"), "n_frames")
    return retention.matched_contrasts(runs, ["dataset_id"], BRIGHT_RATE, DARK_RATE, GAP_S)


@query()
def hold_chains(spark: SparkSession, d: str) -> DataFrame:
    """Hidden chains of the runs with dark holds: the switch-off rate with its profile interval, a level per interval, levels of the counts per frame."""
    runs = table(spark, d, "runs").where("sweep_axis = 'dark_hold_s'").select("run_id")
    shots = table(spark, d, "shots").select("run_id", "shot_id", F.col("sweep_value_s").alias("t"))
    traj = chains.trajectories(_clean(spark, d).where("quality_flag = 'ok'").join(runs, "run_id", "left_semi"), VALUE)
    return holds.fit_holds(traj.join(shots, ["run_id", "shot_id"]).select("run_id", "y", "t"))
