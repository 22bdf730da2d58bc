"""The queries of problems 1, 2, 6, 7 and 8, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.llm import encode, mixing, quantiles, splits, truncation
from shotlens.session import cut
from shotlens.sources.tables import table

SHARES = {"train": 0.6, "validation": 0.2, "test": 0.2}


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.shot_groups(table(spark, d, "shots"), table(spark, d, "frame_sites"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = cut(_groups(spark, d))
    return groups.join(splits.broken_groups(groups).select("group"), "group", "left_semi").select("run_id", "shot_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    groups = cut(_groups(spark, d))
    return groups.join(splits.assign_groups(groups, SHARES), "group").select("run_id", "shot_id", F.col("group").alias("group_id"), "n_rows", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    groups = cut(_groups(spark, d))
    got = splits.assign_groups(groups, SHARES).groupBy("split").agg(F.count("*").alias("n_groups"), F.sum("group_rows").alias("n_rows"))
    whole = groups.agg(F.sum("n_rows").alias("rows"))
    return got.join(F.broadcast(whole)).select("split", "n_groups", "n_rows", F.round(F.col("n_rows") / F.col("rows"), 6).alias("share"))  # one row on the right


def p1_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: what every assignment must keep. No related shots in two splits, and no share off by more than the largest group."""
    got = cut(p1_splits(spark, d))
    groups = got.groupBy("group_id").agg(F.countDistinct("split").alias("k"), F.sum("n_rows").alias("n"), F.count("*").alias("m"))
    whole = groups.agg(F.sum("m").alias("n_shots"), F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_in_several"), F.max("n").alias("most"))
    share = F.create_map(*[F.lit(x) for pair in SHARES.items() for x in pair])
    off = got.groupBy("split").agg(F.sum("n_rows").alias("n")).join(F.broadcast(whole))  # one row on the right
    worst = off.agg(F.max(F.abs(F.col("n") - share[F.col("split")] * F.col("n_rows")) - F.col("most")).alias("beyond"))
    return whole.join(F.broadcast(worst)).select("n_shots", "n_rows", "n_groups", "n_in_several", (F.col("beyond") <= 0).alias("shares_within_largest"))


POINTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
RANK_ERROR = 0.005


def p2_load_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["load_id", "site_id", "frame_id"]
    return quantiles.percentiles(table(spark, d, "frame_sites"), keys, "count_corrected_template", POINTS).select(*keys, "p", "value", "n")


def p2_combined_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Over all loads, from the summaries of the single loads alone."""
    parts = quantiles.summaries(table(spark, d, "frame_sites"), ["load_id", "site_id", "frame_id"], "count_corrected_template", RANK_ERROR)
    return quantiles.combined_percentiles(parts, ["site_id", "frame_id"], POINTS).select("site_id", "frame_id", "p", "value", "n")


def p2_combined_errors(spark: SparkSession, d: str) -> DataFrame:
    """Of each combined percentile whether its rank, counted in all rows, is within the stated error and a row for each summary."""
    keys, v = ["site_id", "frame_id"], F.col("count_corrected_template")
    rows = table(spark, d, "frame_sites")
    parts = cut(quantiles.summaries(rows, ["load_id", *keys], "count_corrected_template", RANK_ERROR))
    got = quantiles.combined_percentiles(parts, keys, POINTS)
    lists = got.groupBy(*keys, "n").agg(F.collect_list(F.struct("p", "value")).alias("ps")).join(parts.groupBy(*keys).agg(F.count("*").alias("n_parts")), keys)
    values = rows.select(*[F.col(k).cast("bigint").alias(k) for k in keys], v.alias("v")).where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, "v").agg(F.count("*").alias("m"))
    at = values.join(lists, keys).select(*keys, "v", "m", "n", "n_parts", F.explode("ps").alias("q"))
    at = at.select(*keys, "v", "m", "n", "n_parts", "q.p", "q.value")
    ranks = at.groupBy(*keys, "p", "value", "n", "n_parts").agg(F.sum(F.when(F.col("v") < F.col("value"), F.col("m")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value"), F.col("m")).otherwise(0)).alias("upto"))
    want, slack = F.greatest(F.ceil(F.col("p") * F.col("n") - 1e-9), F.lit(1)), RANK_ERROR * F.col("n") + F.col("n_parts")
    return ranks.select(*keys, "p", "n", ((F.col("below") + 1 - slack <= want) & (want <= F.col("upto") + slack)).alias("within_error"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, and how many come back unchanged from their ids; a null text comes back empty."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("was"))
    back = encode.decode_corpus(p6_ids(spark, d), "doc_id").select("doc_id", F.xxhash64("text").alias("now"))
    return docs.join(back, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("was") == F.col("now")).alias("n_same"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "source_targets")).used.select("doc_id", "source", "repeats")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "source_targets")).shares()


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each source: documents with tokens, documents used too often or twice, and whether a target that can be met is missed by three documents at most."""
    m = mixing.Mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))
    used = m.used.join(m.shares().select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("n_over"), (F.count("*") - F.countDistinct("doc_id")).alias("n_twice"))
    largest = m.counted.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    s = m.shares().join(used, "source", "left").join(largest, "source", "left").fillna(0, ["n_over", "n_twice", "largest"])
    near = ~F.col("can_be_met") | (F.abs(F.col("reached_tokens") - F.col("wanted_tokens")) <= 3 * F.col("largest"))
    return s.select("source", "target_share", "max_repeats", "n_docs", "n_over", "n_twice", near.alias("near_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_texts(table(spark, d, "documents")).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return truncation.truncation_rates(docs, truncation.truncated_texts(docs), "doc_id", "source")


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p1_split_checks": p1_split_checks, "p2_load_percentiles": p2_load_percentiles, "p2_combined_percentiles": p2_combined_percentiles, "p2_combined_errors": p2_combined_errors, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_rates": p8_rates}

_RANKED = """
with v as (select load_id, site_id, frame_id, count_corrected_template as v from frame_sites where count_corrected_template is not null and not isnan(count_corrected_template)),
r as (select *, row_number() over (partition by load_id, site_id, frame_id order by v) as k, count(*) over (partition by load_id, site_id, frame_id) as n from v)
select load_id::bigint as load_id, site_id::bigint as site_id, frame_id::bigint as frame_id, p, v as value, n
from r join (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as p) on k = greatest(1, ceil(p * n - 1e-9))
"""
_GROUPS = r"""
with recursive seen as (select distinct run_id, shot_id, nullif(trim(lower(regexp_extract(raw_image_path, '[^/\\]*$'))), '') as file,
    case when length(l) >= 2 and starts_with('train', l) then 'train' when length(l) >= 2 and starts_with('validation', l) then 'validation' when length(l) >= 2 and starts_with('test', l) then 'test' end as label
  from (select *, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) as l from frame_sites)),
node as (select distinct run_id, shot_id, 's|' || run_id || '|' || shot_id as n from (select run_id, shot_id from shots union select run_id, shot_id from seen)),
one as (select 's|' || run_id || '|' || shot_id as a, 'c|' || run_id || '|' || cycle_index as b from shots where cycle_index is not null
  union select 's|' || run_id || '|' || shot_id, 's|' || run_id || '|' || retake_of_shot_id from shots where retake_of_shot_id is not null
  union select 's|' || run_id || '|' || shot_id, 'f|' || file from seen where file is not null),
link as (select a, b from one union select b, a from one),
reach as (select n, n as root from node union select link.b, reach.root from reach join link on link.a = reach.n),
grp as (select n, min(root) as root from reach group by n)"""
_FOUND_1 = f"""{_GROUPS},
bad as (select root from grp join node using (n) join seen using (run_id, shot_id) where label is not null group by root having count(distinct label) > 1)
select run_id, shot_id from node join grp using (n) where root in (select root from bad)
"""
_SIZES = f"""{_GROUPS},
cnt as (select run_id, shot_id, count(*) as n_rows from frame_sites where run_id is not null and shot_id is not null group by all),
size as (select root, count(*) as n_shots, coalesce(sum(n_rows), 0)::bigint as n_rows from node join grp using (n) left join cnt using (run_id, shot_id) group by root)"""
#: Group by group, largest first, to the split furthest below its target.
_SHARES_1 = f"""{_SIZES},
line as (select n_rows, row_number() over (order by n_rows desc) as k from size),
step as (select 0::bigint as k, 0.6::double * sum(n_rows) as a, 0.2::double * sum(n_rows) as b, 0.2::double * sum(n_rows) as c, 0::bigint as n_rows, '' as split from size
  union all select line.k, a - (case when a >= b and a >= c then line.n_rows else 0 end), b - (case when not (a >= b and a >= c) and b >= c then line.n_rows else 0 end),
    c - (case when not (a >= b and a >= c) and not b >= c then line.n_rows else 0 end), line.n_rows, case when a >= b and a >= c then 'train' when b >= c then 'validation' else 'test' end
  from step join line on line.k = step.k + 1)
select split, count(*) as n_groups, sum(n_rows)::bigint as n_rows, round(sum(n_rows) / (select sum(n_rows) from size), 6) as share from step where k > 0 group by split
"""
_CHECKS_1 = f"""{_SIZES} select sum(n_shots)::bigint as n_shots, sum(n_rows)::bigint as n_rows, count(*) as n_groups, 0::bigint as n_in_several, true as shares_within_largest from size"""
_ERRORS_2 = """
select site_id::bigint as site_id, frame_id::bigint as frame_id, p, n, true as within_error from (select site_id, frame_id, count(*) as n from frame_sites
  where count_corrected_template is not null and not isnan(count_corrected_template) group by all), (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as p)
"""
_CHECKS_7 = """
select t.source, target_share, max_repeats, count(d.source) as n_docs, 0::bigint as n_over, 0::bigint as n_twice, true as near_target
from source_targets t left join (select source from documents where text <> '') d on d.source = t.source group by all
"""
_SAME = "select source, count(*) as n_docs, count(*) as n_same from documents group by source"
SQL = {"p1_found": _FOUND_1, "p1_shares": _SHARES_1, "p1_split_checks": _CHECKS_1, "p2_load_percentiles": _RANKED, "p2_combined_errors": _ERRORS_2, "p6_round_trip": _SAME, "p7_checks": _CHECKS_7}
