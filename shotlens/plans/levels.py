"""Queries of the structures of the counts and of how well they describe held-out shots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlens.functions.numbers import rounded
from shotlens.operators import emissions, retention, sensitivity
from shotlens.operators.shots import one_delivery
from shotlens.plans.core import _CLEAN, _FIN, VALUE, _clean, half_up
from shotlens.session import cut
from shotlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = half_up(sql)
        return f

    return keep


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    """Unflagged rows with the planned split of their shot."""
    shots = table(spark, d, "shots").select("run_id", "shot_id", F.col("split").alias("part"))
    return cut(_clean(spark, d).where("quality_flag = 'ok'").select("run_id", "shot_id", "site_id", "frame_id", VALUE, "roi_sum_raw").join(shots, ["run_id", "shot_id"]))


def _structures(rows: DataFrame, strengths: tuple[int, ...] = emissions.STRENGTHS) -> emissions.Structures:
    return emissions.Structures(retention.training_only(rows.where("part = 'train'"), "part"), VALUE, "roi_sum_raw", strengths)


@query()
def emission_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Structures of the counts, fitted on train and ranked on validation shots of each run."""
    rows = _split_rows(spark, d)
    return emissions.ranking(emissions.densities(_structures(rows).adjusted(rows.where("part = 'validation'"), VALUE, "roi_sum_raw")), ["run_id"])


@query(f"""with {_CLEAN}, sp as (select run_id, shot_id, split as part from shots), x as (select c.run_id, part, frame_id, site_id, {_FIN(VALUE)} as v from clean c join sp using (run_id, shot_id) where quality_flag = 'ok'),
tr as (select run_id, count(v) as n_train from x where part = 'train' group by all having count(v) >= 8 and stddev_pop(v) > 0), va as (select run_id, count(v) as n from x where part = 'validation' group by all having count(v) > 0)
select run_id, n as n_validation, true as all_scored, true as one_selected, true as integrates_to_one from va join tr using (run_id)""")
def emission_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every validation row of a run is scored by the global structure and its densities are those of a distribution; one structure is selected."""
    rows = _split_rows(spark, d)
    m = _structures(rows)
    held = rows.where("part = 'validation'")
    scored = cut(emissions.densities(m.adjusted(held, VALUE, "roi_sum_raw")))
    r = emissions.ranking(scored, ["run_id"]).groupBy("run_id").agg(F.count_if("selected").alias("k"))
    n = scored.where("structure = 'global'").groupBy("run_id").agg(F.count("*").alias("n_validation"), F.bool_and(F.col("posterior").between(0, 1) & ~F.isnan("log_density")).alias("ok"))
    got = held.where(F.col(VALUE).isNotNull() & ~F.isnan(VALUE)).groupBy("run_id").agg(F.count("*").alias("rows"))
    p = emissions.described(m.whole.where("structure = 'global'")).select("run_id", (F.col("central_high") > F.col("central_low")).alias("spread"))
    x = n.join(got, "run_id").join(r, "run_id").join(p, "run_id")
    return x.select("run_id", "n_validation", ((F.col("rows") == F.col("n_validation")) & F.col("ok")).alias("all_scored"), (F.col("k") == 1).alias("one_selected"), F.col("spread").alias("integrates_to_one"))


@query()
def emission_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels, separation, overlap and threshold of every run (global structure) and site, and the sites that are too weak."""
    rows = _split_rows(spark, d)
    m = _structures(rows)
    every = m.whole.where("structure = 'global'").select("run_id", F.lit(None).cast("int").alias("site_id"), "n", *emissions.LEVELS).unionByName(m.sites.select("run_id", "site_id", "n", *emissions.LEVELS))
    x = emissions.weak_sites(emissions.described(every))
    return x.select("run_id", "site_id", "n", *[rounded(c, 6).alias(c) for c in ("weight", "mean0", "mean1", "sd0", "sd1", "separation", "overlap", "threshold")], "weak")


@query()
def emission_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What the shrunk structure leaves on validation shots: rows between the levels, rows far from both."""
    rows = _split_rows(spark, d)
    scored = emissions.densities(_structures(rows).adjusted(rows.where("part = 'validation'"), VALUE)).where("structure = 'shrunk_20'")
    return emissions.residual_diagnostics(scored, ["run_id"])


@query()
def emission_audit(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of test shots against their model, in all, by half of the run and by quarter of its sites."""
    rows = _split_rows(spark, d)
    scored = emissions.densities(_structures(rows, (20,)).adjusted(rows.where("part = 'test'"), VALUE, only_shrunk=True))  # nothing else is fitted
    sites = table(spark, d, "sites").select("run_id", "site_id")
    quarter = sensitivity.site_quarters(sites)
    half = sensitivity.halves(table(spark, d, "shots"))
    x = scored.join(half, ["run_id", "shot_id"]).join(quarter, ["run_id", "site_id"], "left")
    x = x.withColumn("segment", F.explode(F.array(F.lit("all"), F.col("half"), F.concat(F.lit("sites "), F.coalesce(F.col("quarter").cast("string"), F.lit("unknown"))))))
    return emissions.distribution_audit(cut(x), ["run_id", "segment"])


@query()
def emission_bands(spark: SparkSession, d: str) -> DataFrame:
    """Density of the counts per run with the band of 400 replicates of whole shots."""
    rows = table(spark, d, "frame_sites").repartition("run_id", "shot_id")  # rows of a shot meet once: to choose a delivery and to list its values
    return emissions.density_bands(one_delivery(rows), ["run_id"], VALUE)
