"""Mixtures of sources at target shares of all tokens, drawn with the cube method.

The driver sees one line per source (documents, tokens, share, repeats) and plans: the total is the largest at which each
source that has documents reaches its share within its repeats; a source that would hold the total below ``least_total`` of
the corpus counts as unable and gives all it may.  Of each source every document is then used ``whole`` times, and once
more with probability ``extra``.

Which ones is balanced sampling.  Each source is cut into groups by a hash of key and seed, as many as its documents need
(their number is in the plan).  In each group, in the order of the keys, the documents pass through a flight of three at a time:
their probabilities move along the direction in which neither the expected tokens nor the expected number of documents
changes, one way or the other by chance with the right odds, until one of the three is settled at 0 or 1 and makes room for the
next.  A group leaves at most three documents open; these few fly on together, ``fan_in`` groups in one, and the last ones of
each source are landed on the choice with the least error.  A first group has about ``group_docs`` documents, a later one at
most ``3 * fan_in``, whatever the size of a source.

Defined results: a document whose source is null or has no target takes no part, nor does one without tokens (null or empty
text); repeated rows are documents of their own; negative or null shares and repeats count as 0; of several targets of one
source the first by share and repeats counts; a source without documents reaches 0 and is reported; empty tables give an
empty mixture; the draw depends on the seed, the keys and the sizes alone, not on how the rows are laid out nor on timing (rows
of one key and size may stand for each other).
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlens.llm.encode import DEFAULT_RANKS, token_counts
from shotlens.session import cut

#: More sources than this are refused: the plan has a line for each on the driver.
MOST_SOURCES = 100_000


def plan_shares(sources: pd.DataFrame, total: float | None, least_total: float) -> pd.DataFrame:
    """sources: source, share, cap, n_docs, n_tokens. Adds binds (it holds the total), passed_over (it would hold it too low), wanted (tokens), given (tokens), whole, extra, able."""
    p = sources.copy()
    corpus = p["n_tokens"].sum()
    room = p["n_tokens"] * p["cap"]
    limit = (room / p["share"]).where(p["share"] > 0)
    if total is None:
        bounds = limit[(limit > 0) & (limit >= least_total * corpus)]
        total = float(bounds.min()) if len(bounds) else float(room.sum())
    p["binds"] = (limit > 0) & (limit <= total * (1 + 1e-9)) & (limit >= least_total * corpus)
    p["passed_over"] = (limit < least_total * corpus) & (limit < total)
    p["wanted"] = p["share"] * total
    p["given"] = p[["wanted"]].assign(room=room).min(axis=1)
    p["able"] = (p["n_tokens"] > 0) & (p["given"] >= p["wanted"] * (1 - 1e-9))
    times = (p["given"] / p["n_tokens"]).where(p["n_tokens"] > 0, 0.0)
    p["whole"] = (times + 1e-12).astype(int)
    p["extra"] = (times - p["whole"]).clip(lower=0.0)
    p.loc[p["extra"] < 1e-9, "extra"] = 0.0
    return p


def flight(ids: list, tokens: list, probs: list, draws: list) -> tuple[list, list]:
    """(settled, open): (position, 0 or 1) of the settled documents and (position, probability) of those still open."""
    settled, here = [], []  # here: [position, tokens, probability]
    at, n = 0, len(ids)
    while True:
        while len(here) < 3 and at < n:
            if 0.0 < probs[at] < 1.0:
                here.append([at, tokens[at], probs[at]])
            else:
                settled.append((at, int(probs[at] >= 1.0)))
            at += 1
        if len(here) < 2 or (len(here) == 2 and here[0][1] != here[1][1]):
            return settled, [(i, p) for i, _, p in here]
        if len(here) == 2:
            u = (1.0, -1.0)
        else:
            a, b, c = here[0][1], here[1][1], here[2][1]
            u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        up = min(((1 - x[2]) / d if d > 0 else x[2] / -d) for x, d in zip(here, u) if d)
        down = min((x[2] / d if d > 0 else (1 - x[2]) / -d) for x, d in zip(here, u) if d)
        step = up if draws[max(x[0] for x in here)] * (up + down) < down else -down
        kept = []
        for x, d in zip(here, u):
            x[2] += step * d
            if x[2] < 1e-9 or x[2] > 1 - 1e-9:
                settled.append((x[0], int(x[2] > 0.5)))
            else:
                kept.append(x)
        here = kept


def land(tokens: list, probs: list) -> list[int]:
    """0 or 1 for each of a few open documents: expected tokens and, in a tie, documents are missed by the least."""
    want, count = sum(t * p for t, p in zip(tokens, probs)), sum(probs)
    return list(min(product((0, 1), repeat=len(tokens)), key=lambda x: (abs(sum(t * k for t, k in zip(tokens, x)) - want), abs(sum(x) - count), x)))


UNIT = "unit bigint, key string, source string, n_tokens bigint, prob double, draw double, part int"


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "n_tokens", "prob"], kind="stable", na_position="first").reset_index(drop=True)
        tokens, probs, draws = pdf["n_tokens"].tolist(), pdf["prob"].tolist(), pdf["draw"].tolist()
        done, open_ = flight(pdf["unit"].tolist(), tokens, probs, draws)
        if last and open_:
            done += list(zip([i for i, _ in open_], land([tokens[i] for i, _ in open_], [p for _, p in open_])))
            open_ = []
        for i, p in [*done, *open_]:
            probs[i] = float(p)
        return pdf.assign(prob=probs)

    return run


def balanced_draw(units: DataFrame, most_parts: int, fan_in: int = 64) -> DataFrame:
    """units (UNIT, parts counting from 0 to most_parts - 1) with every prob moved to 0 or 1."""
    settled, open_, parts = [], units, most_parts
    while True:
        last = parts <= 1
        level = cut(open_.groupBy("source", "part").applyInPandas(_fly(last), UNIT))
        settled.append(level.where("prob in (0, 1)"))
        if last:
            break
        open_ = level.where("prob > 0 and prob < 1").withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        parts = -(-parts // fan_in)
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


class Mixture:
    """The draw and its report. ``used``: key, source, n_tokens, repeats (1 or more); ``shares``: one row per source."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", ranks: str = DEFAULT_RANKS, total_tokens: float | None = None, least_total: float = 0.1, seed: int = 7, group_docs: int = 20_000):
        spark = docs.sparkSession
        counted = token_counts(docs.where(F.col(source).isNotNull()), [key, source], text, ranks)
        counted = cut(counted.select(F.col(key).alias("key"), F.col(source).alias("source"), "n_tokens").withColumn("unit", F.monotonically_increasing_id()))
        self.counted = counted
        nonneg = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        want = targets.where("source is not null").groupBy("source").agg(F.max(F.struct(nonneg("target_share").alias("share"), nonneg("max_repeats").alias("cap"))).alias("x")).select("source", "x.share", "x.cap")
        have = counted.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        lines = want.join(have, "source", "left").fillna(0).orderBy("source").limit(MOST_SOURCES + 1).toPandas()
        if len(lines) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.plan = plan_shares(lines.astype({"share": float, "cap": float, "n_docs": float, "n_tokens": float}), total_tokens, least_total)
        lines = [(r.source, int(r.whole), float(r.extra), max(1, -(-int(r.n_docs) // group_docs))) for r in self.plan.itertuples()]
        plan = spark.createDataFrame(lines, "source string, whole int, extra double, parts int")
        units = counted.where("n_tokens > 0").join(plan, "source")
        draw = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("draw")
        part = F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("parts")).cast("int").alias("part")
        flying = units.where("extra > 0").select("unit", F.col("key").cast("string").alias("key"), "source", "n_tokens", F.col("extra").alias("prob"), draw, part)
        drawn = balanced_draw(flying, max((x[3] for x in lines), default=1))
        once = units.where("whole > 0").select("unit", F.col("whole").alias("times"))
        more = drawn.where("prob = 1").select("unit", F.lit(1).alias("times"))
        times = once.unionByName(more).groupBy("unit").agg(F.sum("times").cast("int").alias("repeats"))
        self.used = counted.join(times, "unit").select(F.col("key").alias(key), "source", "n_tokens", "repeats")
        self._spark = spark

    def shares(self) -> DataFrame:
        got = self.used.groupBy("source").agg(F.count("*").alias("n_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("reached_tokens"), F.max("repeats").alias("most_repeats"), F.sum("repeats").alias("n_uses"))
        lines = [(r.source, r.share, int(r.cap), int(r.n_docs), int(r.n_tokens), float(r.wanted), bool(r.able and r.share > 0), bool(r.binds), bool(r.passed_over)) for r in self.plan.itertuples()]
        plan = self._spark.createDataFrame(lines, "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint, wanted_tokens double, can_be_met boolean, binds_total boolean, passed_over boolean")
        every = plan.join(got, "source", "left").fillna(0, ["n_used", "reached_tokens", "most_repeats", "n_uses"])
        whole = every.agg(F.sum("reached_tokens").alias("whole"))
        return every.join(F.broadcast(whole)).select(*every.columns, F.round(F.coalesce(F.try_divide("reached_tokens", "whole"), F.lit(0.0)), 6).alias("reached_share"))  # one row on the right
