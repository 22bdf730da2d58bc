"""The queries of problems 3, 4 and 5 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.operators import drift, profile
from shotlens.operators.readings import implausible_readings, reading_rates
from shotlens.session import cut
from shotlens.sources.tables import table

READING_FIELDS = ["roi_sum_raw", "background_global"]

NUMERIC = (
    "shot_id shot_order frame_id site_id exposure_ms frame_elapsed_s site_x site_y roi_sum_raw background_global count_corrected_global "
    "background_template_offset count_corrected_template roi_max_pixel cycle_index"
).split()
TEXT = "dataset_id run_id timestamp raw_image_path quality_flag condition_id split grid_id".split()

TARGET = {
    "run_id": "string", "shot_id": "int", "frame_id": "int", "site_id": "int", "timestamp": "string", "exposure_ms": "double", "site_x": "double", "site_y": "double",
    "roi_sum_raw": "double", "background_annulus_contaminated": "double", "background_global": "double", "count_corrected_annulus_contaminated": "double", "count_corrected_global": "double", "quality_flag": "string",
}
APPROVED = {"grid": "string", "camera_temp_c": "double", "operator_note": "string", "shutter_ok": "boolean", "site_row": "int", "gain_setting": "double", "background_spatial": "double", "site_detected": "boolean", "frame_elapsed_s": "double", "roi_max_pixel": "double"}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = implausible_readings(table(spark, d, "frame_sites"), table(spark, d, "sites"), READING_FIELDS)
    return found.select("run_id", "shot_id", "frame_id", "site_id", "field_name")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return reading_rates(implausible_readings(table(spark, d, "frame_sites"), table(spark, d, "sites"), READING_FIELDS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_findings(table(spark, d, "frame_sites"), table(spark, d, "runs"), table(spark, d, "loads"))


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.value_counts(table(spark, d, "frame_sites"), ["load_id"], [*NUMERIC, *TEXT])
    v = F.col("value")
    broken = {"quality_flag": v.isNotNull() & ~profile.flag_is_declared(v), "timestamp": v.isNotNull() & ~profile.stamp_is_declared(v)}
    return profile.column_profile(counts, ["load_id"], NUMERIC, broken)


def p4_shifts(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.value_counts(table(spark, d, "frame_sites"), ["load_id"], [*NUMERIC, *TEXT])
    return profile.load_shifts(profile.binned(counts, ["load_id"], NUMERIC), "load_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    aliases = table(spark, d, "field_aliases")
    return drift.field_changes(drift.ingest(table(spark, d, "raw_exports"), aliases, TARGET), aliases)


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    """Three loads of the same table: as enforced, with the approved fields, with the rescued values; each reads what the one before wrote."""
    aliases = table(spark, d, "field_aliases")
    strict = cut(drift.ingest(table(spark, d, "raw_exports"), aliases, TARGET))
    return drift.replay(cut(drift.promote(strict, aliases, APPROVED)), aliases, TARGET | APPROVED)


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).drop("delivered")


def p5_rescued(spark: SparkSession, d: str) -> DataFrame:
    return drift.rescue_report(cut(drift.ingest(table(spark, d, "raw_exports"), table(spark, d, "field_aliases"), TARGET)))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_profile": p4_profile, "p4_shifts": p4_shifts, "p5_found": p5_found, "p5_table": p5_table, "p5_rescued": p5_rescued}

_FLAG = "(roi_saturated|roi_touches_edge|local_bg_underdetermined|nonfinite_count|site_not_detected)"
_FORMED = rf"""(case column_name
  when 'quality_flag' then value = 'ok' or (regexp_full_match(value, '{_FLAG}(\|{_FLAG})*') and len(list_distinct(string_split(value, '|'))) = len(string_split(value, '|')))
  when 'timestamp' then regexp_full_match(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{{1,6}})?') and try_cast(substr(value, 1, 10) as date) is not null
  else not (x <= 0 or isnan(x) or x > 10000) end)"""

_P4_FOUND = f"""
with cells as (
  select load_id, run_id, 'quality_flag' as column_name, quality_flag as value, null::double as x from frame_sites
  union all select load_id, run_id, 'exposure_ms', exposure_ms::varchar, exposure_ms from frame_sites
  union all select load_id, run_id, 'timestamp', "timestamp", null from frame_sites),
c as (select c.*, {_FORMED} as formed, r.exposure_ms as commanded, l.loaded_at from cells c left join runs r using (run_id) left join loads l using (load_id)),
per as (select *, case column_name
    when 'quality_flag' then value <> 'ok'
    when 'exposure_ms' then isnan(x) or abs(x - commanded) > 0.1 * commanded
    else formed and (try_cast(value as timestamp) > loaded_at + interval 365 days or try_cast(value as timestamp) < loaded_at - interval 365 days) end as moved from c),
w as (select load_id, column_name, count(*) n, count(*) - count(value) nulls,
    count(*) filter (value is not null and (column_name <> 'timestamp' or formed)) judged, count(*) filter (moved) moved,
    count(*) filter (value is not null and not formed) broken from per group by all)
select load_id, column_name, 'nulls' as finding, '' as item from w where nulls > 0.1 * n
union all select load_id, column_name, 'values', '' from w where column_name = 'exposure_ms' and broken > 0
union all select load_id, column_name, 'shift', '' from w where judged > 0 and moved > (case when column_name = 'quality_flag' then 0.3 else 0.5 end) * judged + 1e-9 * judged
union all select distinct load_id, column_name, 'values', value from per where column_name <> 'exposure_ms' and value is not null and not formed
"""


def _cells_sql() -> str:
    cells = []
    for c in NUMERIC + TEXT:
        num = f'case when isfinite("{c}"::double) then "{c}"::double end' if c in NUMERIC else "null::double"
        txt = f'"{c}"' if c in TEXT else "null::varchar"
        cells.append(f"select load_id, '{c}' as column_name, \"{c}\"::varchar as value, {num} as x, {txt} as t from frame_sites")
    return " union all ".join(cells)


def _profile_sql() -> str:
    formed = _FORMED.replace("else not (x <= 0 or isnan(x) or x > 10000)", "else true")
    return f"""
with cells as ({_cells_sql()}),
v as (select load_id, column_name, value, x, t, count(*) as n, any_value({formed}) as formed from cells group by 1, 2, 3, 4, 5)
select load_id, column_name, sum(n)::bigint as n_rows, coalesce(sum(n) filter (value is null), 0)::bigint as n_null,
  round(coalesce(sum(n) filter (value is null), 0) / sum(n), 9) as null_share, count(value) as n_distinct,
  min(x) as least_number, max(x) as most_number, min(t) as first_text, max(t) as last_text,
  (max(n) filter (value is not null))::bigint as n_of_top_value, coalesce(sum(n) filter (value is not null and not formed), 0)::bigint as n_broken
from v group by 1, 2
"""


_OCTAVE = "floor(2 * log2(abs(y)) + 1e-9)::int::varchar"
_P4_SHIFTS = f"""
with cells as ({_cells_sql()}), y as (select load_id, column_name, value, try_cast(value as double) as y, column_name in ({', '.join(f"'{c}'" for c in NUMERIC)}) as num from cells),
b as (select load_id, column_name, case when value is null then 'null' when num then case when isnan(y) then 'nan' when isinf(y) then 'inf' when y = 0 then '0' when y < 0 then '-' || {_OCTAVE} else {_OCTAVE} end
  else '=' || regexp_replace(regexp_replace(value, '[0-9]+', '9', 'g'), '[A-Za-z]+', 'a', 'g') end as bin, count(*) as n from y group by all),
l as (select load_id as old, lead(load_id) over (order by load_id) as load_id from (select distinct load_id from b where load_id is not null)),
k as (select l.load_id, column_name, bin, n from b join l on b.load_id = l.old where l.load_id is not null),
c as (select load_id, column_name, bin, coalesce(a.n, 0) as n1, coalesce(k.n, 0) as n0 from (select * from b where load_id in (select load_id from l)) a full join k using (load_id, column_name, bin)),
w as (select *, sum(n1) over v as t1, sum(n0) over v as t0, count(*) over v as m from c window v as (partition by load_id, column_name)),
p as (select *, (n1 + 0.5) / (t1 + 0.5 * m) as p, (n0 + 0.5) / (t0 + 0.5 * m) as q from w)
select load_id, column_name, count(*) as n_bins, round(sum((p - q) * ln(p / q)), 6) as psi, round(sum(pow(n1 * sqrt(t0 / t1) - n0 * sqrt(t1 / t0), 2) / (n1 + n0)), 4) as chi_square from p group by all
"""

_P5_FOUND = """
with alias as (select lower(regexp_replace(alias_name, '[^a-zA-Z0-9]', '', 'g')) a, lower(regexp_replace(current_name, '[^a-zA-Z0-9]', '', 'g')) b from field_aliases),
recs as (select feed_id, file_id, file_no, payload::json as j from raw_exports where json_valid(payload) and json_type(case when json_valid(payload) then payload else 'null' end) = 'OBJECT'),
cells as (select feed_id, file_id, file_no, k as name, json_type(j, '$."' || k || '"') as s from (select *, unnest(json_keys(j)) as k from recs)),
typed as (select feed_id, file_id, file_no, name, coalesce(b, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g'))) as class,
    case s when 'NULL' then null when 'VARCHAR' then 'text' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind
  from cells left join alias on a = lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g'))),
per as (select feed_id, file_id, file_no, class, mode(name) as name, mode(kind) as kind from typed group by 1, 2, 3, 4),
files as (select *, lead(file_id) over (partition by feed_id order by file_no, file_id) as nxt, row_number() over (partition by feed_id order by file_no, file_id) as rn from (select distinct feed_id, file_id, file_no from per)),
bef as (select nxt as file_id, class, name as old, kind as old_kind from per join files using (feed_id, file_id, file_no) where nxt is not null),
aft as (select file_id, class, name, kind from per join files using (feed_id, file_id, file_no) where rn > 1),
b as (select * from aft full join bef using (file_id, class))
select file_id, name as field_name, 'added' as change_kind, '' as old_name from b where old is null
union all select file_id, old, 'removed', '' from b where name is null
union all select file_id, name, 'renamed', old from b where name <> old
union all select file_id, name, 'type', '' from b where name is not null and kind <> old_kind
"""

#: The stated definition by itself: the range starts from the middle three quarters of a series and takes in whatever is within one width, until nothing is.
_P3_FOUND = """
with recursive d as (select run_id, shot_id, frame_id, site_id, field_name, min(shot_order) as shot_order, arg_min(v, coalesce(load_id, 2147483647)) as v from (
    select run_id, shot_id, frame_id, site_id, shot_order, load_id, unnest(['roi_sum_raw', 'background_global']) as field_name, unnest([roi_sum_raw, background_global]) as v from frame_sites)
  where v is not null and not isnan(v) group by all),
o as (select d.*, lag(v) over w is distinct from v as fresh, v <= 0 or isinf(v) or v > 65535.0 * px as bad from d left join (select run_id, site_id, max(roi_n_pixels) as px from sites group by all) using (run_id, site_id)
  window w as (partition by run_id, site_id, frame_id, field_name order by shot_order, shot_id)),
i as (select *, sum(fresh::int) over (partition by run_id, site_id, frame_id, field_name order by shot_order, shot_id rows unbounded preceding) as island from o),
c as (select *, coalesce(bad, false) or count(*) over (partition by run_id, site_id, frame_id, field_name, island) >= 4 as sure from i),
x as (select * from c where not sure),
grow(run_id, site_id, frame_id, field_name, lo, hi, step) as (
  select run_id, site_id, frame_id, field_name, quantile_cont(v, 0.12), quantile_cont(v, 0.88), 0 from x group by all
  union all
  select g.run_id, g.site_id, g.frame_id, g.field_name, least(g.lo, min(x.v)), greatest(g.hi, max(x.v)), g.step + 1
  from grow g join x on g.run_id = x.run_id and g.site_id = x.site_id and g.frame_id = x.frame_id and g.field_name = x.field_name
  where x.v between g.lo - (g.hi - g.lo) and g.hi + (g.hi - g.lo) group by g.run_id, g.site_id, g.frame_id, g.field_name, g.lo, g.hi, g.step having least(g.lo, min(x.v)) < g.lo or greatest(g.hi, max(x.v)) > g.hi),
r as (select run_id, site_id, frame_id, field_name, min(lo) as lo, max(hi) as hi from grow group by all)
select run_id, shot_id, frame_id::int as frame_id, site_id, field_name from c where sure
union all select run_id, shot_id, frame_id::int, site_id, field_name from x join r using (run_id, site_id, frame_id, field_name) where v > hi + (hi - lo) or v < lo - (hi - lo)
"""

_PLAIN = lambda x: f"lower(regexp_replace({x}, '[^a-zA-Z0-9]', '', 'g'))"
#: Each record with its fields in the order of their names: name, class, value as JSON.
_ENTRIES = f"""al as (select map_from_entries(list((a, b))) as m from (select distinct {_PLAIN("alias_name")} as a, {_PLAIN("current_name")} as b from field_aliases) where a <> b),
rec as (select feed_id, file_id, file_no, record_no, payload::json as j from raw_exports where json_valid(payload) and json_type(case when json_valid(payload) then payload else 'null' end) = 'OBJECT'),
ent as (select * exclude (j), list_transform(list_sort(json_keys(j)), lambda k: {{'k': k, 'c': coalesce(m[{_PLAIN("k")}], {_PLAIN("k")}), 'v': json_extract(j, '$."' || k || '"')}}) as e from rec, al)"""
_DUCK = {"string": "varchar", "int": "int", "double": "double", "boolean": "boolean"}


def _first_sql(name: str) -> str:
    return f"list_filter(e, lambda x: x.c = coalesce(m['{name.replace('_', '')}'], '{name.replace('_', '')}'))[1]"


def _strict_sql(v: str, kind: str) -> str:
    return f"(case when json_type({v}) in ('OBJECT', 'ARRAY', 'NULL') then null else try_cast({v} ->> '$' as {_DUCK[kind]}) end)"


def _loose_sql(v: str, kind: str) -> str:
    inner = f"(case json_type({v}) when 'OBJECT' then json_extract({v}, '$.value') when 'ARRAY' then case when json_array_length({v}) = 1 then json_extract({v}, '$[0]') end else {v} end)"
    return _strict_sql(inner, kind)


_P5_FIRST = f"""with {_ENTRIES}, f as (select feed_id, file_id, file_no, record_no, e, {", ".join(f'{_first_sql(n)} as "_{n}"' for n in (TARGET | APPROVED))} from ent)"""
_P5_TABLE = f"""{_P5_FIRST}, t as (select feed_id, file_id, file_no, record_no, e, {", ".join(f'{_loose_sql(f"_{n}.v", k)} as "{n}"' for n, k in (TARGET | APPROVED).items())}, [{", ".join(f"_{n}.k" for n in (TARGET | APPROVED))}] as firsts from f),
r as (select *, list_filter(e, lambda x: json_type(x.v) <> 'NULL' and not list_contains(list_filter(list_zip(firsts, [{", ".join(f'"{n}" is not null' for n in (TARGET | APPROVED))}]), lambda z: z[2]).list_transform(lambda z: z[1]), x.k)) as rest from t)
select * exclude (e, firsts, rest), case when len(rest) > 0 then '{{' || list_aggregate(list_transform(rest, lambda x: to_json(x.k) || ':' || x.v::varchar), 'string_agg', ',') || '}}' end as rescued from r"""
_P5_RESCUED = f"""{_P5_FIRST}, t as (select feed_id, file_id, e, list_filter([{", ".join(f'case when {_strict_sql(f"_{n}.v", k)} is not null then _{n}.k end' for n, k in TARGET.items())}], lambda k: k is not null) as took from f),
x as (select feed_id, file_id, unnest(list_filter(e, lambda x: json_type(x.v) <> 'NULL' and not list_contains(took, x.k))) as r from t)
select feed_id, r.k as name, count(*) as n_records, count(distinct file_id) as n_files from x group by all"""

SQL = {"p5_table": _P5_TABLE, "p5_rescued": _P5_RESCUED, "p3_found": _P3_FOUND, "p4_found": _P4_FOUND, "p4_profile": _profile_sql(), "p4_shifts": _P4_SHIFTS, "p5_found": _P5_FOUND}
