"""The queries of the project's own operators over frame_sites and its side tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators import chains, contract, events, geometry, manifests, mixture, provenance, resample, surfaces, survival
from shotlens.operators import summaries as S
from shotlens.operators.shots import occupancy_calls, one_delivery, site_thresholds
from shotlens.session import cut
from shotlens.sources.tables import table
from shotlens.streaming import loads as streams

VALUE = "count_corrected_template"
BRIGHT_RATE, DARK_RATE = 0.049250, 0.027984


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_sites")


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return one_delivery(_rows(spark, d))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return occupancy_calls(_clean(spark, d))


# Common parts of the SQL: one delivery per key, thresholds, calls.
_CLEAN = """clean as (select run_id, shot_id, frame_id, site_id, max(shot_order) as shot_order, max(condition_id) as condition_id, max(cycle_index) as cycle_index, max(exposure_ms) as exposure_ms,
  max(frame_elapsed_s) as frame_elapsed_s, max(roi_sum_raw) as roi_sum_raw, max(background_global) as background_global, max(count_corrected_global) as count_corrected_global,
  max(count_corrected_template) as count_corrected_template, max(quality_flag) as quality_flag from frame_sites group by all)"""
_THR = f"""{_CLEAN}, thr as (select run_id, site_id, frame_id, quantile_cont(count_corrected_template, 0.1) as low, quantile_cont(count_corrected_template, 0.9) as high from clean
  where count_corrected_template is not null and not isnan(count_corrected_template) group by all)"""
_CALLS = f"""{_THR}, calls as (select c.*, count_corrected_template as v, (low + high) / 2 as threshold, (count_corrected_template > (low + high) / 2)::int as occupied,
  1 / (1 + exp(-(count_corrected_template - (low + high) / 2) / greatest((high - low) / 12, 1e-9))) as posterior from clean c join thr using (run_id, site_id, frame_id)
  where count_corrected_template is not null and not isnan(count_corrected_template))"""
_PAIRS = f"""{_CALLS}, pairs as (select *, frame_id::varchar || '->' || next_frame::varchar as "interval" from (select *, lead(frame_id) over w as next_frame, lead(occupied) over w as next_call
  from calls window w as (partition by run_id, shot_id, site_id order by frame_id)) where next_frame is not null)"""
_FIN = lambda c: f"case when not isnan({c}) then {c} end"
_R = lambda num, den: f"round({num}::double / nullif({den}, 0), 6)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def half_up(sql: str) -> str:
    """Every round(x, n) with the slack that rounded() has."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        digits = int(sql[comma + 1 : j - 1])
        r = f"round(({half_up(sql[i + 6 : comma])}) + 1e-{digits + 3}, {digits})"
        out += sql[at:i] + f"(case when {r} = 0 then 0.0::double else {r} end)"
        at = j
    return out + sql[at:]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = half_up(sql)
        return f

    return keep


@query(f"""with {_PAIRS}, shots as (select run_id, "interval", shot_id, avg(next_call) as m, count(*) as n from pairs where occupied = 1 group by all)
select run_id, "interval", count(m) as n_shots, sum(n)::bigint as n_rows, round(avg(m), 6) as estimate, round(stddev_samp(m) / sqrt(count(m)), 6) as std_error from shots group by all""")
def retention_by_interval(spark: SparkSession, d: str) -> DataFrame:
    return S.equal_shot_curve(events.retention_events(_calls(spark, d)), "retained", ["run_id", "interval"])


@query(f"""with {_PAIRS} select run_id, "interval", count(*) as n_pairs, round(avg((occupied = next_call)::int), 6) as agreement, count(*) filter (occupied = 1 and next_call = 0) as n_lost,
 count(*) filter (occupied = 0 and next_call = 1) as n_gained, {_R("count(*) filter (occupied = 1 and next_call = 1)", "count(*) filter (occupied = 1)")} as retention, count(*) filter (occupied = 1) as n_at_risk from pairs group by all""")
def transition_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.transition_summary(events.transitions(_calls(spark, d)), ["run_id"])


_Q = "least(greatest(posterior, 1e-15), 1 - 1e-15)"


@query(f"""with {_CALLS} select run_id, condition_id, frame_id, count(*) as n_rows, count(distinct shot_id) as n_shots, round(avg(occupied), 6) as mean_call, round(avg(posterior), 6) as mean_posterior,
 round(avg(-({_Q} * ln({_Q}) + (1 - {_Q}) * ln(1 - {_Q}))), 6) as mean_entropy from calls group by all""")
def occupancy_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.occupancy_summary(_calls(spark, d), ["run_id", "condition_id", "frame_id"])


@query(f"""with {_PAIRS} select run_id, shot_id, condition_id, "interval", sum(next_call)::bigint as successes, count(next_call) as trials from pairs where occupied = 1 group by all""")
def binomial_cells(spark: SparkSession, d: str) -> DataFrame:
    return S.binomial_cells(events.retention_events(_calls(spark, d)), "retained", ["condition_id", "interval"])


_TIMING = "t as (select run_id, shot_id, frame_id, max(frame_elapsed_s) as start_s, max(exposure_ms) / 1000.0 as exposure_s from frame_sites group by all)"


@query(f"""with {_TIMING} select run_id, shot_id, frame_id, round(start_s, 6) as start_s, round(exposure_s, 7) as exposure_s, round(start_s - (lag(start_s) over w + lag(exposure_s) over w), 6) as gap_s from t window w as (partition by run_id, shot_id order by frame_id)""")
def interframe_gaps(spark: SparkSession, d: str) -> DataFrame:
    return contract.add_timing(_rows(spark, d)).withColumns({"start_s": rounded("start_s", 6), "exposure_s": rounded("exposure_s", 7), "gap_s": rounded("gap_s", 6)})


@query(f"""with {_TIMING}, g as (select *, start_s - (lag(start_s) over w + lag(exposure_s) over w) as gap_s from t window w as (partition by run_id, shot_id order by frame_id))
select run_id, shot_id, frame_id, round(sum(coalesce(exposure_s, 0)) over w, 6) as bright_s, round(sum(coalesce(gap_s, 0)) over w, 6) as dark_s, (row_number() over w)::int as pulses from g
window w as (partition by run_id, shot_id order by frame_id rows between unbounded preceding and current row)""")
def prefix_timing(spark: SparkSession, d: str) -> DataFrame:
    p = events.prefix_timing(contract.add_timing(_rows(spark, d)))
    return p.select("run_id", "shot_id", "frame_id", rounded("bright_s", 6).alias("bright_s"), rounded("dark_s", 6).alias("dark_s"), "pulses")


@query("""with c as (select distinct run_id, cycle_index from shots where cycle_index is not null), x as (select *, row_number() over (partition by run_id order by cycle_index) - 1 as k, count(*) over (partition by run_id) as n from c)
select run_id, cycle_index, case when k < floor(n * 0.6) then 'train' when k < floor(n * 0.6) + floor(n * 0.2) then 'validation' else 'test' end as split from x""")
def cycle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifests.cycle_manifest(table(spark, d, "shots"))


@query("""with x as (select run_id, shot_id, row_number() over (partition by run_id order by shot_order, shot_id) - 1 as k, count(*) over (partition by run_id) as n from shots)
select run_id, shot_id, floor(k * 5 / n)::int as block, case when floor(k * 5 / n) < 3 then 'train' when floor(k * 5 / n) = 3 then 'validation' else 'test' end as split from x""")
def block_manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifests.block_manifest(table(spark, d, "shots"))


@query("""with c as (select distinct run_id, cycle_index from shots where cycle_index is not null), x as (select *, row_number() over (partition by run_id order by cycle_index) - 1 as k, count(*) over (partition by run_id) as n from c),
m as (select run_id, cycle_index, case when k < floor(n * 0.6) then 'train' when k < floor(n * 0.6) + floor(n * 0.2) then 'validation' else 'test' end as split from x)
select run_id, condition_id, count(*) filter (m.split = 'train') as train, count(*) filter (m.split = 'validation') as validation, count(*) filter (m.split = 'test') as test
from (select run_id, shot_id, condition_id, cycle_index from shots) join m using (run_id, cycle_index) group by all""")
def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    shots = table(spark, d, "shots")
    return manifests.split_coverage(shots, manifests.cycle_manifest(shots))


@query("""with f as (select run_id, split, count(*) as n_rows, count(distinct shot_id) as n_shots from (select f.run_id, f.shot_id, s.split from frame_sites f left join (select run_id, shot_id, min(split) as split from shots group by all) s using (run_id, shot_id)) group by all)
select run_id, split, n_rows, n_shots from f""")
def attached_splits(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = manifests.attach_split(_rows(spark, d).select("run_id", "shot_id", "split"), table(spark, d, "shots").select("run_id", "shot_id", "split"))
    return rows.groupBy("run_id", "split").agg(F.count("*").alias("n_rows"), F.countDistinct("shot_id").alias("n_shots"))


_KNOWN = "['roi_saturated', 'roi_touches_edge', 'local_bg_underdetermined', 'nonfinite_count', 'site_not_detected']"
_NULLS = " union all ".join(f"select 'null {c}' as \"check\", count(*) filter ({c} is null) as n from frame_sites" for c in ("run_id", "shot_id", "frame_id", "site_id", "quality_flag", "split"))


@query(f"""with k as (select run_id, shot_id, frame_id, site_id, count(*) as n from frame_sites group by all), b as (select run_id, shot_id, count(distinct frame_id) f, count(distinct site_id) s, count(*) k from k group by all),
s as (select run_id, shot_id, count(distinct split) a, count(distinct condition_id) b, count(distinct shot_order) c from frame_sites group by all), p as (select run_id, site_id, min(site_x) x0, max(site_x) x1, min(site_y) y0, max(site_y) y1 from frame_sites group by all)
{_NULLS}
union all select 'missing count without flag', count(*) filter ((count_corrected_global is null or isnan(count_corrected_global)) and not contains(quality_flag, 'nonfinite_count')) from frame_sites
union all select 'unknown flag', count(*) filter (quality_flag <> 'ok' and not list_has_all({_KNOWN}, string_split(quality_flag, '|'))) from frame_sites
union all select 'path in file name', count(*) filter (regexp_matches(raw_image_path, '[/\\\\]')) from frame_sites
union all select 'unknown split', count(*) filter (split not in ('train', 'validation', 'test', 'unassigned')) from frame_sites
union all select 'key delivered more than once', count(*) filter (n > 1) from k
union all select 'incomplete block of a shot', count(*) filter (f * s <> k) from b
union all select 'several splits in a shot', count(*) filter (a > 1) from s union all select 'several conditions in a shot', count(*) filter (b > 1) from s union all select 'several orders of a shot', count(*) filter (c > 1) from s
union all select 'site that moves', count(*) filter (x0 <> x1 or y0 <> y1) from p""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return contract.violations(_rows(spark, d))


@query(f"""with {_CLEAN} select run_id, site_id, frame_id, count(v) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as sd, round(quantile_cont(v, 0.1), 4) as p10, round(quantile_cont(v, 0.9), 4) as p90,
 round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 4) as spread, round(avg(b), 4) as mean_background, count(*) filter (quality_flag <> 'ok') as n_flagged
from (select *, {_FIN(VALUE)} as v, {_FIN("background_global")} as b from clean) group by all""")
def site_statistics(spark: SparkSession, d: str) -> DataFrame:
    return S.site_statistics(_clean(spark, d), VALUE, "background_global")


@query(f"""with {_CLEAN}, st as (select run_id, site_id, frame_id, round(avg(v), 4) as mean from (select *, {_FIN(VALUE)} as v from clean) group by all)
select run_id, grid_id, frame_id, count(*) as n_sites, round(quantile_cont(mean, 0.0), 3) as least, round(quantile_cont(mean, 0.25), 3) as p25, round(quantile_cont(mean, 0.5), 3) as median, round(quantile_cont(mean, 0.75), 3) as p75,
 round(quantile_cont(mean, 1.0), 3) as most, round(stddev_pop(mean) / nullif(abs(avg(mean)), 0), 6) as variation from st left join (select run_id, site_id, grid_id from sites) using (run_id, site_id) where mean is not null group by all""")
def heterogeneity(spark: SparkSession, d: str) -> DataFrame:
    return S.heterogeneity(S.site_statistics(_clean(spark, d), VALUE, "background_global"), table(spark, d, "sites"))


_PAIRED = f"""{_CLEAN}, paired as (select run_id, shot_id, site_id, max(case when frame_id = 0 then {_FIN(VALUE)} end) as f0, max(case when frame_id = 1 then {_FIN(VALUE)} end) as f1,
 max((coalesce(quality_flag, '') <> 'ok')::int) as any_flag from clean where frame_id in (0, 1) group by all having f0 is not null and f1 is not null)"""


@query(f"""with {_PAIRED} select run_id, count(*) as n_pairs, round(avg(f1 - f0), 4) as mean_shift, round(stddev_samp(f1 - f0), 4) as sd_shift, sum(any_flag)::bigint as n_flagged from paired group by all""")
def paired_shift(spark: SparkSession, d: str) -> DataFrame:
    p = S.paired_frames(_clean(spark, d), VALUE)
    return p.groupBy("run_id").agg(F.count("*").alias("n_pairs"), rounded(F.avg(F.col("f1") - F.col("f0")), 4).alias("mean_shift"), rounded(F.stddev_samp(F.col("f1") - F.col("f0")), 4).alias("sd_shift"), F.sum("any_flag").alias("n_flagged"))


@query(f"""with {_PAIRED}, th as (select run_id, site_id, frame_id, (quantile_cont({VALUE}, 0.1) + quantile_cont({VALUE}, 0.9)) / 2 as t from clean where {VALUE} is not null and not isnan({VALUE}) group by all),
x as (select p.*, f0 > a.t as a, f1 > b.t as b from paired p join th a on p.run_id = a.run_id and p.site_id = a.site_id and a.frame_id = 0 join th b on p.run_id = b.run_id and p.site_id = b.site_id and b.frame_id = 1)
select run_id, count(*) as n, count(*) filter (a and b) as n11, count(*) filter (a and not b) as n10, count(*) filter (not a and b) as n01, count(*) filter (not a and not b) as n00, round(avg((a = b)::int), 6) as agreement,
 {_R("count(*) filter (a and b)", "count(*) filter (a)")} as stay_rate, {_R("count(*) filter (not a and b)", "count(*) filter (not a)")} as gain_rate, sum(any_flag)::bigint as n_flagged from x group by all""")
def paired_agreement(spark: SparkSession, d: str) -> DataFrame:
    clean = _clean(spark, d)
    return S.agreement(S.paired_frames(clean, VALUE), site_thresholds(clean, VALUE))


_SHOTMEANS = f"""{_CLEAN}, sm as (select run_id, shot_id, frame_id, max(shot_order) as shot_order, avg({_FIN("background_global")}) as b, avg({_FIN(VALUE)}) as y, avg({_FIN("roi_sum_raw")}) as r, avg({_FIN("count_corrected_global")}) as g from clean group by all)"""


def _slope_sql(x: str, y: str, by: str, src: str) -> str:
    return f"""select {by}, n, round(slope, 6) as slope, round(my - slope * mx, 4) as intercept, round(case when n > 2 and sxx > 0 then sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx) end, 6) as slope_error,
 round(case when n >= 3 and sxx > 0 and syy > 0 then sxy / sqrt(sxx * syy) end, 6) as r from (select *, case when sxx > 0 then sxy / sxx end as slope from
 (select {by}, count(*) as n, regr_sxx({y}, {x}) as sxx, regr_sxy({y}, {x}) as sxy, regr_syy({y}, {x}) as syy, avg({x}) as mx, avg({y}) as my from {src} where {x} is not null and {y} is not null group by all))"""


@query(f"with {_SHOTMEANS} {_slope_sql('shot_order', 'b', 'run_id, frame_id', 'sm')}")
def background_drift(spark: SparkSession, d: str) -> DataFrame:
    return S.slopes(S.shot_means(_clean(spark, d), ["background_global"]), ["run_id", "frame_id"], "shot_order", "background_global")


@query(f"""with {_CALLS}, c as (select run_id, shot_id, frame_id, avg({_FIN("background_global")}) as b, avg(occupied) as y from calls group by all) {_slope_sql('b', 'y', 'run_id, frame_id', 'c')}""")
def background_coupling(spark: SparkSession, d: str) -> DataFrame:
    x = _calls(spark, d).groupBy("run_id", "shot_id", "frame_id").agg(F.avg(F.when(~F.isnan("background_global"), F.col("background_global"))).alias("b"), F.avg("occupied").alias("y"))
    return S.slopes(x, ["run_id", "frame_id"], "b", "y")


@query("""select run_id, flag, count(*) as n from (select run_id, unnest(string_split(quality_flag, '|')) as flag from frame_sites where quality_flag is not null) group by all""")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.flag_counts(_rows(spark, d), ["run_id"])


@query(f"""with {_CLEAN}, s as (select run_id, shot_id, frame_id, avg({_FIN("background_global")}) as b from clean group by all)
select run_id, frame_id, count(b) as n_shots, round(quantile_cont(b, 0.5), 4) as median, round(avg(b), 4) as mean, round(stddev_samp(b), 4) as sd from s group by all""")
def pedestal_summary(spark: SparkSession, d: str) -> DataFrame:
    s = S.shot_means(_clean(spark, d), ["background_global"])
    return s.groupBy("run_id", "frame_id").agg(F.count("background_global").alias("n_shots"), rounded(F.percentile("background_global", 0.5), 4).alias("median"), rounded(F.avg("background_global"), 4).alias("mean"), rounded(F.stddev_samp("background_global"), 4).alias("sd"))


def _methods_sql() -> str:
    long = " union all ".join(f"select run_id, shot_id, frame_id, shot_order, b, '{m}' as method, {c} as y from sm" for m, c in (("raw", "r"), ("global", "g"), ("template", "y")))
    return f"""{_SHOTMEANS}, long as ({long}), mm as (select run_id, frame_id, method, count(*) as n_shots, avg(y) as mean, stddev_samp(y) as sd, regr_sxx(y, b) as bxx, regr_sxy(y, b) as bxy, regr_syy(y, b) as yy, regr_sxx(y, shot_order) as oxx, regr_sxy(y, shot_order) as oxy
 from long where y is not null and b is not null group by all),
stats as (select run_id, frame_id, method, n_shots, round(mean, 4) as mean, round(sd, 4) as sd, round(case when n_shots >= 3 and bxx > 0 and yy > 0 then bxy / sqrt(bxx * yy) end, 6) as r_background, round(case when oxx > 0 then oxy / oxx end, 6) as drift from mm)"""


_METHODS = {"raw": "roi_sum_raw", "global": "count_corrected_global", "template": "count_corrected_template"}


@query(f"with {_methods_sql()} select * from stats")
def background_methods(spark: SparkSession, d: str) -> DataFrame:
    return S.background_methods(_clean(spark, d), _METHODS)


@query(f"""with {_methods_sql()}, m as (select run_id, method, round(avg(abs(r_background)), 6) as coupling, round(avg(abs(drift)), 6) as drift, max(abs(r_background)) as worst from stats group by all)
select run_id, method, coupling, drift from m where coupling is not null and worst <= 0.5 qualify row_number() over (partition by run_id order by coupling, drift, method) = 1""")
def best_background(spark: SparkSession, d: str) -> DataFrame:
    return S.best_method(S.background_methods(_clean(spark, d), _METHODS))


_HIST = f"""{_CLEAN}, x as (select run_id, frame_id, {VALUE} as v from clean where {VALUE} is not null and not isnan({VALUE})), e as (select run_id, frame_id, quantile_cont(v, 0.0025) as lo, quantile_cont(v, 0.9975) as hi from x group by all),
h as (select run_id, frame_id, least(floor((v - lo) / ((hi - lo) / 60)), 59)::int as bin, count(*) as n, max(lo) as lo, max(hi) as hi from x join e using (run_id, frame_id) where hi > lo and v >= lo and v <= hi group by all)"""


@query(f"""with {_HIST} select run_id, frame_id, bin, n, round(n / ((sum(n) over (partition by run_id, frame_id)) * (hi - lo) / 60), 9) as density from h""")
def density_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(_clean(spark, d), ["run_id", "frame_id"], VALUE)


@query(f"""with {_CLEAN}, z as (select run_id, frame_id, floor({VALUE} / 50)::bigint as cell, shot_id % 2 as half from clean where {VALUE} is not null and not isnan({VALUE})),
c as (select run_id, frame_id, cell, count(*) filter (half = 0)::double as x, count(*) filter (half = 1)::double as y from z group by all),
p as (select run_id, frame_id, x / sum(x) over w as p, y / sum(y) over w as q from c window w as (partition by run_id, frame_id))
select run_id, frame_id, round(sum((case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) + (case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end)) / 2, 6) as divergence from p group by all""")
def half_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How far the counts of even and odd shots of a run differ."""
    z = _clean(spark, d).where(F.col(VALUE).isNotNull() & ~F.isnan(VALUE)).groupBy("run_id", "frame_id", F.floor(F.col(VALUE) / 50).alias("cell"), (F.col("shot_id") % 2).alias("half")).agg(F.count("*").cast("double").alias("n"))
    z = cut(z)
    return S.js_divergence(z.where("half = 0"), z.where("half = 1"), ["run_id", "frame_id"], ["cell"])


@query(f"""with {_CLEAN}, s as (select run_id, shot_id, avg({_FIN(VALUE)}) as m from clean group by all having m is not null), md as (select run_id, quantile_cont(m, 0.5) as median from s group by all)
select run_id, shot_id, round(abs(m - median), 6) as off, round(median, 6) as median from s join md using (run_id) qualify row_number() over (partition by run_id order by round(abs(m - median), 6), shot_id) = 1""")
def representative_shot(spark: SparkSession, d: str) -> DataFrame:
    s = _clean(spark, d).groupBy("run_id", "shot_id").agg(F.avg(F.when(~F.isnan(VALUE), F.col(VALUE))).alias("m")).where("m is not null")
    return S.nearest_to_median(s, ["run_id"], "m", "shot_id")


_SITED = f"""{_CLEAN}, g as (select c.run_id, shot_id, c.site_id, s.grid_id, s.site_row, s.site_col, {_FIN(VALUE)} as v from clean c join sites s on c.run_id = s.run_id and c.site_id = s.site_id where frame_id = 0)"""


@query(f"""with {_SITED}, n as (select a.run_id, a.site_id, b.site_id as right_id, a.v as v, b.v as u from g a join g b on a.run_id = b.run_id and a.shot_id = b.shot_id and a.grid_id = b.grid_id and a.site_row = b.site_row and b.site_col = a.site_col + 1 where a.v is not null and b.v is not null),
m as (select run_id, site_id, right_id, count(*) as n, regr_sxx(v, u) as sxx, regr_sxy(v, u) as sxy, regr_syy(v, u) as syy from n group by all)
select run_id, site_id, right_id, n, round(case when n >= 3 and sxx > 0 and syy > 0 then sxy / sqrt(sxx * syy) end, 6) as r from m""")
def neighbour_correlation(spark: SparkSession, d: str) -> DataFrame:
    clean = _clean(spark, d).join(table(spark, d, "sites").select("run_id", "site_id", "grid_id", "site_row", "site_col"), ["run_id", "site_id"])
    return S.site_correlations(clean, VALUE)


@query(f"""with {_CALLS}, f as (select run_id, site_id, shot_order, shot_id, occupied from calls where frame_id = 0), w as (select *, case when lag(occupied) over (partition by run_id, site_id order by shot_order, shot_id) = occupied then 0 else 1 end as change from f),
i as (select *, sum(change) over (partition by run_id, site_id order by shot_order, shot_id rows unbounded preceding) as island from w), s as (select run_id, site_id, island, max(occupied) as occupied, count(*) as n from i group by all)
select run_id, occupied, count(*) as n_islands, max(n) as longest, round(avg(n), 6) as mean_length from s group by all""")
def occupancy_islands(spark: SparkSession, d: str) -> DataFrame:
    i = events.islands(_calls(spark, d).where("frame_id = 0"), ["run_id", "site_id"], ["shot_order", "shot_id"], "occupied")
    return i.groupBy("run_id", "occupied").agg(F.count("*").alias("n_islands"), F.max("n").alias("longest"), rounded(F.avg("n"), 6).alias("mean_length"))


@query("""with e as (select user_id, event_id, epoch_us(ts) as t, event_type from events), s as (select user_id, t as start_s, coalesce(lead(t) over (partition by user_id order by t, event_id), t + 60000000) as end_s, event_type from e)
select a.event_type, count(*) as n_overlaps from s a join s b on a.user_id = b.user_id and a.end_s > b.start_s and a.start_s < b.end_s where a.event_type = b.event_type group by all""")
def event_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Stretches between a user's events against each other: an interval join within the user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("start_s", "event_id")
    s = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_s"), "event_type").withColumn("end_s", F.coalesce(F.lead("start_s").over(w), F.col("start_s") + 60_000_000))
    return events.overlapping(s, s, ["user_id"], 86_400_000_000).where("a.event_type = b.event_type").groupBy(F.col("a.event_type").alias("event_type")).agg(F.count("*").alias("n_overlaps"))


@query("""select o.o_orderkey, l.station from (select o_orderkey, ts from (select o_orderkey, cast('2031-02-03' as timestamp) + (o_orderdate - cast('1992-01-01' as timestamp)) / 1000 as ts from orders)) o asof left join loads l on o.ts >= l.loaded_at""")
def station_at_order(spark: SparkSession, d: str) -> DataFrame:
    """As-of join: the station of the last load before each (rescaled) order time."""
    t0, base = F.lit("1992-01-01").cast("timestamp_ntz"), F.lit("2031-02-03").cast("timestamp_ntz")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    o = table(spark, d, "orders").select("o_orderkey", (us(base) + F.floor((us(F.col("o_orderdate")) - us(t0)) / 1000)).alias("at"))
    s = table(spark, d, "loads").select(us(F.col("loaded_at")).alias("since"), "station")
    # times and states meet on the day, and each day begins with the state that it inherits
    day = 86_400_000_000
    o, s = o.withColumn("day", F.floor(F.col("at") / day)), s.withColumn("day", F.floor(F.col("since") / day))
    last = s.groupBy("day").agg(F.max(F.struct("since", "station")).alias("x")).select("day", "x.station")
    days = o.select("day").distinct()
    inherited = events.state_at(days.withColumns({"one": F.lit(1), "at": F.col("day") - 1}), last.withColumns({"one": F.lit(1), "since": F.col("day")}).drop("day"), ["one"], "at", "since", "station")
    begin = inherited.select((F.col("day") * day).alias("since"), "station", "day").where("station is not null")
    return events.state_at(o, s.select("since", "station", "day").unionByName(begin), ["day"], "at", "since", "station").select("o_orderkey", "station")


@query(f"""with p as (select a.run_id, a.site_id, b.site_id as b_id, sqrt((a.site_x - b.site_x) ** 2 + (a.site_y - b.site_y) ** 2) as d from sites a join sites b on a.run_id = b.run_id and a.site_id <> b.site_id), q as (select * from p where d <= 150)
select run_id, site_id, b_id as nearest_id, round(d, 6) as distance, (count(*) over (partition by run_id, site_id)) as n_near from q qualify row_number() over (partition by run_id, site_id order by round(d, 6), b_id) = 1""")
def nearest_sites(spark: SparkSession, d: str) -> DataFrame:
    return geometry.nearest_neighbours(table(spark, d, "sites"))


@query("""with o as (select dataset_id, run_id, lag(run_id) over (partition by dataset_id order by run_id) as before from (select distinct dataset_id, run_id from runs)),
p as (select o.run_id, a.site_id as a_id, b.site_id as b_id, round(sqrt((a.site_x - b.site_x) ** 2 + (a.site_y - b.site_y) ** 2), 6) as d from o join sites a on a.run_id = o.run_id join sites b on b.run_id = o.before where o.before is not null and sqrt((a.site_x - b.site_x) ** 2 + (a.site_y - b.site_y) ** 2) <= 60),
m as (select * from (select * from p qualify row_number() over (partition by run_id, a_id order by d, b_id) = 1) join (select run_id, b_id, a_id from p qualify row_number() over (partition by run_id, b_id order by d, a_id) = 1) using (run_id, a_id, b_id))
select run_id, count(*) as n_matched, round(quantile_cont(d, 0.5), 6) as median_distance, max(d) as most_distance from m group by all""")
def matched_sites(spark: SparkSession, d: str) -> DataFrame:
    return geometry.match_runs(table(spark, d, "sites"), table(spark, d, "runs"))


@query(f"""with {_CLEAN}, p as (select a.run_id, a.site_id, b.site_id as b_id from sites a join sites b on a.run_id = b.run_id and a.site_id <> b.site_id where sqrt((a.site_x - b.site_x) ** 2 + (a.site_y - b.site_y) ** 2) <= 150),
x as (select p.run_id, c.shot_id, c.frame_id, p.site_id, count(*) as n_around, round(avg(c.background_global), 4) as around from clean c join p on c.run_id = p.run_id and c.site_id = p.b_id where c.background_global is not null and not isnan(c.background_global) group by all)
select run_id, frame_id, count(*) as n_rows, sum(n_around)::bigint as n_around, round(avg(around), 3) as around from x group by all""")
def local_backgrounds(spark: SparkSession, d: str) -> DataFrame:
    x = geometry.local_background(_clean(spark, d), table(spark, d, "sites"), "background_global")
    return x.groupBy("run_id", "frame_id").agg(F.count("*").alias("n_rows"), F.sum("n_around").alias("n_around"), rounded(F.avg("around"), 3).alias("around"))


_H, _K = f"({BRIGHT_RATE} * exposure_s)", f"({DARK_RATE} * 0.01)"


@query(f"""with s as (select run_id, exposure_ms / 1000.0 as exposure_s, unnest(generate_series(1, 2 * n_frames - 1)) as segment from runs where n_frames >= 1 and exposure_ms is not null),
b as (select *, ceil((segment - 1) / 2) * {_H} + floor((segment - 1) / 2) * {_K} as h, case when segment % 2 = 1 then {_H} else {_K} end as own from s)
select run_id, segment::int as segment, case when segment % 2 = 1 then 'exposure' else 'gap' end as kind, round(exp(-h), 9) as before, round(1 - exp(-own), 9) as loss, round(exp(-h) * (1 - exp(-own)), 9) as part from b""")
def loss_budget(spark: SparkSession, d: str) -> DataFrame:
    return survival.loss_budget(table(spark, d, "runs"), BRIGHT_RATE, DARK_RATE)


_MIX = "(xor({x}, {x} >> 15) * 1103515245 + 12345) % 2147483648"


@query(f"""with {_PAIRS}, st as (select run_id, shot_id, condition_id, avg(next_call) as m from pairs where occupied = 1 group by all),
pl as (select *, row_number() over (partition by run_id, condition_id order by shot_id) - 1 as place, count(*) over (partition by run_id, condition_id) as size from st),
x0 as (select run_id, condition_id, size, b, (b * 1000003 + place * 7919 + ('0x' || substr(md5(run_id || '|' || condition_id), 1, 7))::bigint) % 2147483648 as x from pl, (select unnest(generate_series(1::bigint, 1000::bigint)) as b)),
x1 as (select * replace ({_MIX.format(x="x")} as x) from x0), x2 as (select * replace ({_MIX.format(x="x")} as x) from x1), x3 as (select * replace ({_MIX.format(x="x")} as x) from x2),
dr as (select run_id, condition_id, b, (x >> 8) % size as pick from x3),
rep as (select d.run_id, d.b, avg(p.m) as m from dr d join pl p on d.run_id = p.run_id and d.condition_id = p.condition_id and d.pick = p.place group by all)
select run_id, n_units, n_replicates, round(estimate, 6) as estimate, lower, upper from (select run_id, count(*) as n_units, avg(m) as estimate from st group by all)
join (select run_id, count(*) as n_replicates, round(quantile_cont(m, 0.025), 6) as lower, round(quantile_cont(m, 0.975), 6) as upper from rep group by all) using (run_id)""")
def bootstrap_retention(spark: SparkSession, d: str) -> DataFrame:
    shots = cut(events.retention_events(_calls(spark, d)).groupBy("run_id", "shot_id", "condition_id").agg(F.avg("retained").alias("m")))
    return resample.bootstrap_mean(shots, ["run_id", "condition_id"], "shot_id", ["run_id"], "m", 1000)


@query(f"""with {_CALLS}, sh as (select run_id, shot_id, avg(-ln(greatest(case when occupied = 1 then p else 1 - p end, 1e-9))) as flat, avg(-ln(greatest(case when occupied = 1 then pf else 1 - pf end, 1e-9))) as framed
 from (select c.*, avg(occupied) over (partition by run_id) as p, avg(occupied) over (partition by run_id, frame_id) as pf from calls c) group by all)
select run_id, count(*) as n_shots, round(avg(flat - framed), 6) as gain, round(avg(flat - framed) - 1.959964 * stddev_samp(flat - framed) / sqrt(count(*)), 6) as lower, round(avg(flat - framed) + 1.959964 * stddev_samp(flat - framed) / sqrt(count(*)), 6) as upper,
 (coalesce(avg(flat - framed) - 1.959964 * stddev_samp(flat - framed) / sqrt(count(*)) > 0, false))::int as passes from sh group by all""")
def frame_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether occupancy by frame describes a run's shots better than one occupancy for all frames."""
    calls = cut(_calls(spark, d).select("run_id", "shot_id", "frame_id", "occupied"))
    per = calls.groupBy("run_id", "frame_id").agg(F.sum("occupied").alias("s"), F.count("*").alias("n"))
    run = per.groupBy("run_id").agg((F.sum("s") / F.sum("n")).alias("p"))
    x = calls.join(per.select("run_id", "frame_id", (F.col("s") / F.col("n")).alias("pf")), ["run_id", "frame_id"]).join(run, "run_id")
    nll = lambda p: F.avg(-F.ln(F.greatest(F.when(F.col("occupied") == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(1e-9))))
    return survival.paired_gate(x.groupBy("run_id", "shot_id").agg(nll("p").alias("flat"), nll("pf").alias("framed")), ["run_id"], "flat", "framed")


_DIGEST = ["run_id", "shot_id", "frame_id", "site_id", "quality_flag", "split", "raw_image_path", "timestamp"]


@query(f"""select load_id, count(*) as n_rows, sum(('0x' || substr(md5(concat_ws('|', {', '.join(f"coalesce({chr(34)}{c}{chr(34)}::varchar, chr(92) || 'N')" for c in _DIGEST)})), 1, 8))::bigint)::bigint as digest from frame_sites group by all""")
def load_digests(spark: SparkSession, d: str) -> DataFrame:
    return provenance.digests(_rows(spark, d), ["load_id"], _DIGEST)


_COPIED = ["roi_sum_raw", "background_global", "quality_flag", "split", "timestamp", "exposure_ms"]


@query(f"""with g as (select run_id, shot_id, frame_id, site_id, count(*) as n, count(distinct load_id) as loads, {', '.join(f'(min("{c}") is not distinct from max("{c}") and count("{c}") in (0, count(*))) as "{c}"' for c in _COPIED)} from frame_sites group by 1, 2, 3, 4 having count(*) > 1),
s as (select count(*) as n_keys, count(*) filter (loads > 1) as n_over_loads from g)
{' union all '.join(f'''select n_keys, n_over_loads, '{c}' as column_name, (select count(*) filter (not "{c}") from g) as n_differ from s''' for c in _COPIED)}""")
def repeated_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return provenance.repeated_deliveries(_rows(spark, d), _COPIED)


@query("""select l.load_id, station, rows_announced, coalesce(n, 0) as n_rows, coalesce(r, 0) as n_runs, case when rows_announced is null then 'not announced' when rows_announced = coalesce(n, 0) then 'as announced' else 'differs' end as verdict
from loads l left join (select load_id, count(*) as n, count(distinct run_id) as r from frame_sites group by all) f on l.load_id = f.load_id""")
def load_audit(spark: SparkSession, d: str) -> DataFrame:
    return provenance.load_audit(_rows(spark, d), table(spark, d, "loads"))


@query()
def mixture_fits(spark: SparkSession, d: str) -> DataFrame:
    return mixture.fit_mixtures(_clean(spark, d), ["run_id", "frame_id"], VALUE)


@query()
def mixture_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures per run, per frame and per site, fitted to the first 60 % of each run's cycles and ranked on the next 20 %."""
    m = manifests.cycle_manifest(table(spark, d, "shots"))
    rows = cut(_clean(spark, d).join(m, ["run_id", "cycle_index"]).select("run_id", "site_id", "frame_id", "split", VALUE))
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")
    kinds = {"run": ["run_id"], "frame": ["run_id", "frame_id"], "site": ["run_id", "site_id"]}
    return mixture.rank_models({k: mixture.score(held, mixture.fit_mixtures(train, by, VALUE), by, VALUE) for k, by in kinds.items()}, ["run_id"])


@query()
def dark_rates(spark: SparkSession, d: str) -> DataFrame:
    """Retention over dark holds: a rate per run and a level per interval."""
    shots = table(spark, d, "shots").select("run_id", "shot_id", "sweep_value_s").where("sweep_value_s is not null and not isnan(sweep_value_s)")
    cells = S.binomial_cells(events.retention_events(_calls(spark, d)), "retained", ["interval"]).join(shots, ["run_id", "shot_id"])
    return survival.fit_groups(cells, ["run_id"], "sweep_value_s", "interval")


@query()
def dark_rate_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Dark rates with intervals from 1,000 replicates of whole shots, drawn within run and condition."""
    shots = table(spark, d, "shots").where("sweep_value_s is not null and not isnan(sweep_value_s)").select("run_id", "shot_id", "condition_id", "sweep_value_s")
    cells = cut(S.binomial_cells(events.retention_events(_calls(spark, d)), "retained", ["interval"]).join(shots, ["run_id", "shot_id"]))
    return survival.resampled_rates(cells, ["run_id", "condition_id"], "shot_id", "sweep_value_s", "interval", 1000)


@query()
def background_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """A robust plane through the readings of all sites of a frame, and what it leaves."""
    return surfaces.frame_surfaces(_clean(spark, d), table(spark, d, "sites"), "background_global")


@query()
def bright_rates(spark: SparkSession, d: str) -> DataFrame:
    """Decay of first-frame occupancy over the wait in light."""
    shots = table(spark, d, "shots").select("run_id", "shot_id", "sweep_value_s").where("sweep_value_s is not null and not isnan(sweep_value_s)")
    first = _calls(spark, d).where("frame_id = 0").withColumn("interval", F.lit("first"))
    return survival.fit_groups(S.binomial_cells(first, "occupied", ["interval"]).join(shots, ["run_id", "shot_id"]), ["run_id"], "sweep_value_s", "interval")


@query()
def imaging_losses(spark: SparkSession, d: str) -> DataFrame:
    """Repeated imaging: known losses in light and dark as an offset, and what each further pulse costs on top."""
    t = events.prefix_timing(contract.add_timing(_rows(spark, d))).select("run_id", "shot_id", "frame_id", (-(rounded("bright_s", 3) * BRIGHT_RATE + rounded("dark_s", 3) * DARK_RATE)).alias("known"), (F.col("pulses") - 1).cast("double").alias("earlier"))
    cells = S.binomial_cells(_calls(spark, d).withColumn("interval", F.lit("all")), "occupied", ["frame_id", "interval"]).join(t.where("known is not null and not isnan(known)"), ["run_id", "shot_id", "frame_id"])
    return survival.fit_groups(cells, ["run_id"], "earlier", "interval", "known")


@query()
def held_out_dark(spark: SparkSession, d: str) -> DataFrame:
    """Dark rates fitted to the train cycles, scored once on the test cycles."""
    shots = table(spark, d, "shots")
    plan = shots.where("sweep_value_s is not null and not isnan(sweep_value_s)").join(manifests.cycle_manifest(shots).withColumnRenamed("split", "part"), ["run_id", "cycle_index"]).select("run_id", "shot_id", "sweep_value_s", "part")
    cells = cut(S.binomial_cells(events.retention_events(_calls(spark, d)), "retained", ["interval"]).join(plan, ["run_id", "shot_id"]))
    fits = survival.fit_groups(cells.where("part = 'train'"), ["run_id"], "sweep_value_s", "interval")
    return survival.held_out_nll(cells.where("part = 'test'"), fits.where("rate is not null"), ["run_id"], "sweep_value_s", "interval")


@query()
def chain_fits(spark: SparkSession, d: str) -> DataFrame:
    return chains.baum_welch(chains.trajectories(_clean(spark, d), VALUE))


@query()
def chain_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed occupancy per run and frame under the fitted chains."""
    traj = cut(chains.trajectories(_clean(spark, d), VALUE))
    x = chains.smoothed(traj, chains.baum_welch(traj)).select("run_id", F.posexplode("occupied").alias("frame", "p"))
    return x.groupBy("run_id", "frame").agg(F.count("*").alias("n"), rounded(F.avg("p"), 5).alias("occupied"))


@query("""select run_id, shot_id, count(*) as n_rows, max(frame_id)::int as last_frame, min(load_id) as first_load, max(load_id) as last_load from frame_sites group by all""")
def streamed_shots(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_partials(streams.stream_of(spark, f"{d}/frame_sites.parquet"), streams.shot_progress, streams.merged_progress)


@query("""select time_bucket(interval '1 hour', ts)::timestamp as window_start, event_type, count(*) as n_events, sum(floor(value * 100 + 0.5)::bigint)::bigint as cents from events group by all""")
def streamed_event_windows(spark: SparkSession, d: str) -> DataFrame:
    x = streams.run_updates(streams.event_windows(streams.stream_of(spark, f"{d}/events.parquet")), ["window_start", "event_type"])
    return x.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
