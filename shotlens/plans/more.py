"""Further queries: sensitivities, metadata of runs, whole-cycle resampling, variances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.functions.numbers import milliseconds, rounded
from shotlens.operators import contract, events, geometry, resample, sensitivity
from shotlens.operators import summaries as S
from shotlens.operators.shots import finite, occupancy_calls, one_delivery, site_thresholds
from shotlens.plans.core import _CALLS, _CLEAN, _FIN, _MIX, _PAIRS, _THR, _TIMING, VALUE, _calls, _clean, _rows, half_up
from shotlens.session import cut
from shotlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, half_up(sql)
        return f

    return keep


@query(f"""with {_CALLS}, h as (select run_id, shot_id, case when row_number() over (partition by run_id order by shot_order, shot_id) <= floor(count(*) over (partition by run_id) / 2) then 'early' else 'late' end as half from shots)
select run_id, half, frame_id, count(*) as n_rows, round(avg(occupied), 6) as occupied from calls join h using (run_id, shot_id) group by all""")
def occupancy_by_half(spark: SparkSession, d: str) -> DataFrame:
    x = _calls(spark, d).join(sensitivity.halves(table(spark, d, "shots")), ["run_id", "shot_id"])
    return x.groupBy("run_id", "half", "frame_id").agg(F.count("*").alias("n_rows"), rounded(F.avg("occupied"), 6).alias("occupied"))


_SWEPT = "s as (select run_id, shot_id, sweep_value_s as w from shots where sweep_value_s is not null and not isnan(sweep_value_s))"


@query(f"""with {_PAIRS}, {_SWEPT}, e as (select p.run_id, "interval", next_call, w from pairs p join s using (run_id, shot_id) where occupied = 1), l as (select run_id, min(w) as lo, max(w) as hi from e group by all),
v as (select e.*, unnest(list_filter(['all', case when w > lo then 'without least' end, case when w < hi then 'without greatest' end, case when w > lo and w < hi then 'without both' end], lambda x: x is not null)) as variant from e join l using (run_id))
select run_id, variant, count(*) as n_events, round(avg(next_call), 6) as retention from v group by all""")
def endpoint_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    shots = table(spark, d, "shots").where("sweep_value_s is not null and not isnan(sweep_value_s)").select("run_id", "shot_id", F.col("sweep_value_s").alias("w"))
    x = cut(events.retention_events(_calls(spark, d)).join(shots, ["run_id", "shot_id"]).select("run_id", "interval", "retained", "w"))
    return sensitivity.endpoint_variants(x, ["run_id"], "w").groupBy("run_id", "variant").agg(F.count("*").alias("n_events"), rounded(F.avg("retained"), 6).alias("retention"))


@query(f"""with {_PAIRS}, nz as (select run_id, site_id, frame_id, sqrt(avg((v - m) * (v - m))) as noise from (select run_id, site_id, frame_id, v, avg(v) over (partition by run_id, site_id, frame_id, occupied) as m from calls) group by all having noise > 0),
weak as (select run_id, site_id from thr join nz using (run_id, site_id, frame_id) group by all having min((high - low) / noise) < 2)
select run_id, count(*) as n_events, round(avg(next_call), 6) as retention from pairs p where occupied = 1 and not exists (select 1 from weak w where w.run_id = p.run_id and w.site_id = p.site_id) group by all""")
def without_weak_sites(spark: SparkSession, d: str) -> DataFrame:
    clean = _clean(spark, d)
    calls = cut(occupancy_calls(clean))
    level = calls.groupBy("run_id", "site_id", "frame_id", "occupied").agg(F.avg("v").alias("m"))
    noise = calls.join(level, ["run_id", "site_id", "frame_id", "occupied"]).groupBy("run_id", "site_id", "frame_id").agg(F.sqrt(F.avg((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("noise")).where("noise > 0")
    keep = sensitivity.without(events.retention_events(calls), sensitivity.weak_sites(site_thresholds(clean), noise))
    return keep.groupBy("run_id").agg(F.count("*").alias("n_events"), rounded(F.avg("retained"), 6).alias("retention"))


@query(f"""with {_CLEAN}, {_SWEPT}, c as (select run_id, frame_id, w, avg(b) as b from (select c.run_id, shot_id, frame_id, w, avg({_FIN("background_global")}) as b from clean c join s using (run_id, shot_id) group by all) group by all having b is not null)
select run_id, frame_id, w, round(b, 4) as background, round(b - arg_min(b, w) over (partition by run_id, frame_id), 4) as change from c""")
def relative_background(spark: SparkSession, d: str) -> DataFrame:
    shots = table(spark, d, "shots").where("sweep_value_s is not null and not isnan(sweep_value_s)").select("run_id", "shot_id", F.col("sweep_value_s").alias("w"))
    b = _clean(spark, d).join(shots, ["run_id", "shot_id"]).groupBy("run_id", "shot_id", "frame_id", "w").agg(F.avg(finite("background_global")).alias("b"))
    curve = b.groupBy("run_id", "frame_id", "w").agg(F.avg("b").alias("b")).where("b is not null")
    return sensitivity.relative_to_shortest(curve, ["run_id", "frame_id"], "w", "b").select("run_id", "frame_id", "w", rounded("b", 4).alias("background"), rounded("change", 4).alias("change"))


def _method_sql(c: str) -> str:
    return f"""select '{c}' as method, run_id, ({c} > t)::int as o from clean join (select run_id, site_id, frame_id, (quantile_cont({c}, 0.1) + quantile_cont({c}, 0.9)) / 2 as t from clean where {c} is not null and not isnan({c}) group by all) using (run_id, site_id, frame_id) where {c} is not null and not isnan({c})"""


_COLUMNS = ["count_corrected_template", "count_corrected_global", "roi_sum_raw"]


@query(f"""with {_CLEAN}, u as ({' union all '.join(_method_sql(c) for c in _COLUMNS)}), m as (select run_id, method, count(*) as n_rows, avg(o) as m from u group by all)
select m.run_id, m.method, m.n_rows, round(m.m, 6) as estimate, round(m.m - b.m, 6) as difference from m left join m b on b.run_id = m.run_id and b.method = 'count_corrected_template'""")
def occupancy_by_method(spark: SparkSession, d: str) -> DataFrame:
    clean = cut(_clean(spark, d))
    return sensitivity.by_method({c: occupancy_calls(clean, c) for c in _COLUMNS}, ["run_id"], "occupied")


@query("""with x as (select run_id, shot_id, row_number() over (partition by run_id order by shot_order, shot_id) - 1 as k, count(*) over (partition by run_id) as n from shots),
w as (select distinct run_id, floor(i * (n - 1) / 4)::bigint as k from x, (select unnest(generate_series(0, 4)) as i)) select x.run_id, shot_id, x.k::int as "at" from x join w on x.run_id = w.run_id and x.k = w.k""")
def spaced_shots(spark: SparkSession, d: str) -> DataFrame:
    return sensitivity.spaced(table(spark, d, "shots"))


@query(f"""with {_CALLS}, {_TIMING}, g as (select *, round(sum(coalesce(exposure_s, 0)) over (partition by run_id, shot_id order by frame_id rows unbounded preceding), 3) as b from t),
l as (select run_id, shot_id, total_s, max(frame_id) as frame_id from g, (select unnest([0.1, 0.2, 0.4]::double[]) as total_s) where b <= total_s group by all),
s as (select run_id, total_s, shot_id, avg(occupied) as m from calls join l using (run_id, shot_id, frame_id) group by all)
select run_id, total_s, count(*) as n_shots, round(avg(m), 6) as occupied from s group by all""")
def matched_prefixes(spark: SparkSession, d: str) -> DataFrame:
    t = events.prefix_timing(contract.add_timing(_rows(spark, d))).withColumn("bright_s", F.col("bright_s") + 1e-6)
    return sensitivity.matched_prefixes(_calls(spark, d), t, [0.1, 0.2, 0.4])


@query(f"""with {_PAIRS}, st as (select run_id, cycle_index, avg(next_call) as m from pairs where occupied = 1 and cycle_index is not null group by all),
pl as (select *, row_number() over (partition by run_id order by cycle_index) - 1 as place, count(*) over (partition by run_id) as size from st),
x0 as (select run_id, size, b, (b * 1000003 + place * 7919 + ('0x' || substr(md5(run_id), 1, 7))::bigint) % 2147483648 as x from pl, (select unnest(generate_series(1::bigint, 1000::bigint)) as b)),
x1 as (select * replace ({_MIX.format(x="x")} as x) from x0), x2 as (select * replace ({_MIX.format(x="x")} as x) from x1), x3 as (select * replace ({_MIX.format(x="x")} as x) from x2),
rep as (select d.run_id, d.b, avg(p.m) as m from (select run_id, b, (x >> 8) % size as pick from x3) d join pl p on d.run_id = p.run_id and d.pick = p.place group by all)
select run_id, n_units, n_replicates, round(estimate, 6) as estimate, lower, upper from (select run_id, count(*) as n_units, avg(m) as estimate from st group by all)
join (select run_id, count(*) as n_replicates, round(quantile_cont(m, 0.025), 6) as lower, round(quantile_cont(m, 0.975), 6) as upper from rep group by all) using (run_id)""")
def bootstrap_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Whole cycles are drawn instead of shots."""
    c = cut(events.retention_events(_calls(spark, d)).where("cycle_index is not null").groupBy("run_id", "cycle_index").agg(F.avg("retained").alias("m")))
    return resample.bootstrap_mean(c, ["run_id"], "cycle_index", ["run_id"], "m", 1000)


@query("""select run_id, count(distinct shot_id) as n_shots, count(distinct case when not isnan(f.exposure_ms) then floor(f.exposure_ms + 0.5) end) as n_exposures, min(timestamp) as first_timestamp, max(timestamp) as last_timestamp, (rint_ms::int)::varchar || 'ms' as exposure_name, count(distinct load_id) as n_loads
from frame_sites f join (select run_id, round_even(exposure_ms, 0) as rint_ms from runs) r using (run_id) group by run_id, rint_ms""")
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    x = _rows(spark, d).groupBy("run_id").agg(
        F.countDistinct("shot_id").alias("n_shots"), F.countDistinct(F.floor(finite("exposure_ms") + 0.5)).alias("n_exposures"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.countDistinct("load_id").alias("n_loads")
    )
    return x.join(table(spark, d, "runs").select("run_id", milliseconds(F.col("exposure_ms") / 1000.0).alias("exposure_name")), "run_id")


@query(f"""with {_CLEAN} select run_id, site_id, frame_id, count(v) as n, round(greatest(avg(v * v) - avg(v) * avg(v), 0), 3) as variance from (select *, {_FIN("roi_sum_raw")} / 1000 as v from clean) group by all having count(v) >= 2""")
def site_variance(spark: SparkSession, d: str) -> DataFrame:
    """Variance from two running sums, as over frames that arrive one by one (in thousands of counts)."""
    v = finite("roi_sum_raw") / 1000
    x = _clean(spark, d).groupBy("run_id", "site_id", "frame_id").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")).where("n >= 2")
    return x.select("run_id", "site_id", "frame_id", "n", rounded(F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(0.0)), 3).alias("variance"))


@query(f"""with {_THR}, sh as (select run_id, shot_id, condition_id, cycle_index, shot_order from shots), o as (select run_id, cycle_index, string_agg(condition_id, ',' order by shot_order, shot_id) as seq, count(*) as n, count(distinct condition_id) as k from sh where cycle_index is not null group by all),
r as (select run_id, count(*) as n_cycles, count(distinct seq) as n_orders, count(*) filter (n <> k) as n_repeating, max(k) as n_conditions from o group by all)
select run_id, n_cycles, n_orders, n_repeating, n_conditions, (select count(*) from thr where thr.run_id = r.run_id) as n_series from r""")
def design_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of a run: whether their conditions come in one fixed order, each once, and how many series the run has."""
    s = table(spark, d, "shots").where("cycle_index is not null")
    o = s.groupBy("run_id", "cycle_index").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("shot_order", "shot_id", "condition_id"))), lambda x: x["condition_id"])).alias("seq"), F.count("*").alias("n"), F.countDistinct("condition_id").alias("k"))
    r = o.groupBy("run_id").agg(F.count("*").alias("n_cycles"), F.countDistinct("seq").alias("n_orders"), F.count_if(F.col("n") != F.col("k")).alias("n_repeating"), F.max("k").alias("n_conditions"))
    t = site_thresholds(one_delivery(_rows(spark, d)), VALUE).groupBy("run_id").agg(F.count("*").alias("n_series"))
    return r.join(t, "run_id", "left").fillna(0, ["n_series"])


_TIME_CHECKS = {
    "exposure not as commanded": "sum(n_off)", "exposure missing": "sum(n_none)", "frame not after the one before": "sum(back)", "gap not as declared": "sum(gap)",
    "several starts of a frame": "sum(several)", "frames not numbered from 0": "count(*) filter (skips > 0)", "shot without all frames": "count(*) filter (n <> n_frames)",
}


@query(f"""with x as (select f.run_id, shot_id, frame_id, frame_elapsed_s, f.exposure_ms as e, r.exposure_ms as commanded, n_frames from frame_sites f join runs r using (run_id)),
fr as (select run_id, shot_id, frame_id, count(*) filter (e is not null and (isnan(e) or abs(e - commanded) > 1e-3)) as n_off, count(*) filter (e is null) as n_none, min(frame_elapsed_s) as s0, max(frame_elapsed_s) as s1, max(commanded) as commanded, max(n_frames) as n_frames from x group by all),
g as (select *, lag(s0) over w as prior_s, row_number() over w - 1 as place from fr window w as (partition by run_id, shot_id order by frame_id)),
sh as (select run_id, shot_id, sum(n_off) as n_off, sum(n_none) as n_none, count(*) filter (s0 <= prior_s) as back, count(*) filter (abs(s0 - (prior_s + lc / 1000) - 0.01) > 1e-6) as gap, count(*) filter (s0 <> s1) as several, count(*) filter (frame_id <> place) as skips, count(*) as n, max(n_frames) as n_frames
  from (select *, commanded as lc from g) group by all)
{" union all ".join(f"""select run_id, '{c}' as "check", ({v})::bigint as n from sh group by run_id""" for c, v in _TIME_CHECKS.items())}""")
def timing_violations(spark: SparkSession, d: str) -> DataFrame:
    return contract.timing_violations(_rows(spark, d), table(spark, d, "runs"))


@query(f"""with {_CLEAN}, g as (select c.run_id, grid_id, shot_id, c.site_id, {_FIN(VALUE)} / 1000 as v from clean c join (select run_id, site_id, grid_id from sites) using (run_id, site_id) where frame_id = 0),
p as (select a.run_id, a.grid_id, a.site_id, b.site_id as other, count(*) as n, corr(a.v, b.v) as r, var_pop(a.v) as va, var_pop(b.v) as vb from g a join g b on a.run_id = b.run_id and a.grid_id is not distinct from b.grid_id and a.shot_id = b.shot_id and a.site_id < b.site_id where a.v is not null and b.v is not null group by all having count(*) >= 3)
select run_id, grid_id, count(*) as n_pairs, round(quantile_cont(r, 0.5), 4) as median, round(quantile_cont(r, 0.95), 4) as p95 from p where va > 0 and vb > 0 group by all""")
def grid_correlations(spark: SparkSession, d: str) -> DataFrame:
    """How the counts of all sites of a grid go together over the shots of a run: median and 95th percentile over the pairs."""
    x = _clean(spark, d).where("frame_id = 0").join(table(spark, d, "sites").select("run_id", "site_id", "grid_id"), ["run_id", "site_id"])
    return S.grid_correlations(x.withColumn("y", finite(VALUE) / 1000), ["run_id", "grid_id"], "y")


@query("""with o as (select run_id, lag(run_id) over (partition by dataset_id order by run_id) as before from (select distinct dataset_id, run_id from runs)),
near as (select o.run_id, a.site_id as a_id, b.site_id as b_id from o join sites a on a.run_id = o.run_id join sites b on b.run_id = o.before where sqrt((a.site_x - b.site_x) ** 2 + (a.site_y - b.site_y) ** 2) <= 60)
select o.run_id, (select count(*) from sites s where s.run_id = o.run_id and not exists (select 1 from near n where n.run_id = o.run_id and n.a_id = s.site_id)) as n_new,
  (select count(*) from sites s where s.run_id = o.before and not exists (select 1 from near n where n.run_id = o.run_id and n.b_id = s.site_id)) as n_gone from o where before is not null""")
def unmatched_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites of a run without any of the run before near by, and the other way round."""
    return geometry.unmatched(table(spark, d, "sites"), table(spark, d, "runs"))


@query(f"""with {_CALLS}, f as (select c.run_id, c.shot_id, c.site_id, -avg(posterior * ln(greatest(posterior, 1e-15)) + (1 - posterior) * ln(greatest(1 - posterior, 1e-15))) as e from calls c group by all),
m as (select run_id, quantile_cont(round(e, 6), 0.5) as m from f group by all)
select run_id, shot_id, site_id, round(e, 6) as entropy from f join m using (run_id) qualify row_number() over (partition by run_id order by round(abs(round(e, 6) - m), 6), shot_id, site_id) = 1""")
def typical_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """The trajectory of each run whose mean entropy is nearest to the median of all."""
    p = F.col("posterior")
    low = lambda c: F.ln(F.greatest(c, F.lit(1e-15)))
    e = _calls(spark, d).groupBy("run_id", "shot_id", "site_id").agg(rounded(-F.avg(p * low(p) + (1 - p) * low(1 - p)), 6).alias("entropy"))
    e = cut(e)
    m = e.groupBy("run_id").agg(F.percentile("entropy", 0.5).alias("m"))
    best = e.join(m, "run_id").groupBy("run_id").agg(F.min(F.struct(rounded(F.abs(F.col("entropy") - F.col("m")), 6).alias("off"), "shot_id", "site_id", "entropy")).alias("x"))
    return best.select("run_id", "x.shot_id", "x.site_id", "x.entropy")


@query("""with p as (select run_id, shot_id, split from shots), m as (select run_id, cycle_index, case when k < floor(n * 0.6) then 'train' when k < floor(n * 0.6) + floor(n * 0.2) then 'validation' else 'test' end as other
  from (select run_id, cycle_index, row_number() over (partition by run_id order by cycle_index) - 1 as k, count(*) over (partition by run_id) as n from (select distinct run_id, cycle_index from shots where cycle_index is not null))),
x as (select s.run_id, s.shot_id, s.split, m.other from shots s left join m using (run_id, cycle_index))
select run_id, split, coalesce(other, 'none') as sensitivity_split, count(*) as n_shots from x group by all""")
def sensitivity_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each shot's planned split beside that of an alternate plan by cycles: one row per shot on either side."""
    from shotlens.operators import manifests

    shots = table(spark, d, "shots")
    x = manifests.beside(shots.select("run_id", "shot_id", "split"), shots.join(manifests.cycle_manifest(shots).withColumnRenamed("split", "sensitivity_split"), ["run_id", "cycle_index"]).select("run_id", "shot_id", "sensitivity_split"))
    return x.groupBy("run_id", "split", F.coalesce("sensitivity_split", F.lit("none")).alias("sensitivity_split")).agg(F.count("*").alias("n_shots"))
