"""Truncated texts: made cuts are found, written ends are not, limits of fields, marks, and the defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from shotlens.llm import truncation
from shotlens.llm.truncation import EVIDENCE, length_limits, prefix_counts, truncated_texts, truncation_rates

DOCS = "doc_id bigint, page_id bigint, source string, text string, word string, line string, tok string"
SUBJECTS = "bridge tower harbour orchard library railway windmill quarry meadow glacier".split()
SENTENCES = ["The {a} of [[{n}]] was first recorded in {y}.", "No map drawn before {y} shows the {a}, e.g. the survey of {n} omits it.", "Water from the {a} feeds the ancient {b} through {{{{convert|{y}|m}}}} of pipe.", "According to the rolls, {y} families kept a {b} there.<ref>{n} Rolls, p. {y}.</ref>", "What the expedition found under the {a} is another story..."]
ENDS = ["", "\n* {n} {a}\n* {n} {b}", "\n[[Category:{n}]]", "\nPopulation: {y}", "\n== Notes ==", "\n{{{{stub|en}}}}", "\n{{| class=x\n|-\n| {n} || {y}\n|}}", "\nmy cat wrote this", "\nlol lol lol", " ~~ {u} (talk) 1{h}:2{h}"]


def page(g):
    fill = lambda t: t.format(a=g.choice(SUBJECTS), b=g.choice(SUBJECTS), n="".join(g.choice(["Tor", "bel", "dan", "mol"]) for _ in range(2)).capitalize(), y=g.randint(1200, 1999), u="abc", h=g.randint(0, 9))
    return " ".join(fill(g.choice(SENTENCES)) for _ in range(g.randint(3, 9))) + fill(g.choice(ENDS))


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", "l", "t") for r in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    g = random.Random(4)
    rows, cut = [], set()
    for i in range(1500):
        t, source = page(g), g.choice(["main", "short", "dots"])
        if source == "short" and len(t) > 300:
            t = t[:300]
            if t[-1] not in ".!":
                cut.add(i)
        elif source == "dots" and len(t) > 280:
            t = t[:280]
            if t[-1] not in ".!":
                cut.add(i)
            t += "..."
        elif source == "main" and i % 20 == 0:
            t = t[: g.randint(60, len(t.split("\n")[0]) - 5)]
            if t[-1] not in ".!>":
                cut.add(i)
        rows.append((i, i // 2, source, t))
    return rows, cut


def test_made_cuts(spark, corpus):
    rows, cut = corpus
    found = truncated_texts(table(spark, rows))
    got = {r.doc_id for r in found.collect()}
    hit = len(got & cut)
    assert hit / len(cut) > 0.95 and hit / len(got) > 0.95
    rate = {r.source: r for r in truncation_rates(table(spark, rows), found, "doc_id", "source").collect()}
    assert rate["short"].n_at_limit > 0.9 * rate["short"].n_truncated and rate["main"].n_at_limit == 0
    assert sum(r.n_docs for r in rate.values()) == len(rows)
    assert all(r.n_truncated == sum(r[x] for x in EVIDENCE) for r in rate.values())
    assert sum(r.n_word for r in rate.values()) > sum(r.n_sentence for r in rate.values())


def test_the_trie_decides(spark, corpus, monkeypatch):
    """Without the trie, and with one that knows whole words only, most rows are gone; without lengths the rows at limits are."""
    rows, _ = corpus
    docs = table(spark, rows)
    on = {(r.doc_id, r.reason) for r in truncated_texts(docs).collect()}
    words = {i for i, why in on if why == "word"}
    trie = truncation.CorpusEnds.trie
    monkeypatch.setattr(truncation.CorpusEnds, "trie", lambda self, asked: trie(self, asked).where("false"))
    off = {r.doc_id for r in truncated_texts(docs).collect()}
    assert words and not words & off and len(off) < 0.4 * len(on)
    monkeypatch.setattr(truncation.CorpusEnds, "trie", lambda self, asked: trie(self, asked).withColumn("below", F.lit(0)))
    assert not words & {r.doc_id for r in truncated_texts(docs).collect()}
    monkeypatch.setattr(truncation.CorpusEnds, "trie", trie)
    monkeypatch.setattr(truncation, "length_limits", lambda *a, **k: length_limits(*a, **k).where("false"))
    assert not {r.reason for r in truncated_texts(docs).collect()} & {"limit"}


def test_prefixes_of_any_length(spark):
    g = random.Random(1)
    stem = "ab" * 40
    items = ["a", "ab", "abc", "b", stem, stem + "c", stem + "cd", stem[:70], "c" * 64, "c" * 65, *("".join(g.choice("ab") for _ in range(g.randint(1, 6))) for _ in range(60))]
    counts = {w: i + 1 for i, w in enumerate(sorted(set(items)))}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    asked = ["a", "ab", "aba", "", stem[:63], stem[:64], stem[:65], stem, stem + "c", stem + "x", "c" * 63, "c" * 64, "c" * 66, None]
    got = {r.word: r.below for r in prefix_counts(df, spark.createDataFrame([(w,) for w in asked + asked], "word string"), [], "word", "n", "below").collect()}
    want = {p: sum(n for w, n in counts.items() if w.startswith(p) and w != p) for p in asked if p}
    assert got == {p: n for p, n in want.items() if n}


def test_limits(spark, corpus):
    rows, _ = corpus
    got = {(r.source, r.unit, r["size"]) for r in length_limits(table(spark, rows), "source", "text").collect()}
    assert ("short", "chars", 300) in got and ("dots", "chars", 283) in got and not any(s == "main" for s, *_ in got)


def test_defined_cases(spark, corpus):
    rows, _ = corpus
    more = [(9000, None, None, None), (9001, 1, "main", ""), (9002, 1, "main", " \n\u200b "), (9003, None, None, "The bridge of [[Tor"), (9003, None, None, "The bridge of [[Tor"), (9004, 5, "main", "The tower. " * 20_000 + "The harb"), (9005, 5, "main", "#REDIRECT [[Torbel]]"), (9006, 6, "main", "hm")]
    got = [r.doc_id for r in truncated_texts(table(spark, rows + more)).collect() if r.doc_id >= 9000]
    assert sorted(x for x in got if x != 9006) == [9003, 9003, 9004]
    assert truncated_texts(table(spark, [])).count() == 0
    assert truncated_texts(table(spark, [(1, 1, "a", None)])).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_shares", "p1_split_checks", "p2_combined_errors", "p6_round_trip", "p7_checks"])
def test_against_sql(spark, folder, name):
    from shotlens.llm.queries import QUERIES, SQL
    from tests.helpers import assert_same

    assert_same(spark, folder, name, QUERIES[name], SQL[name])


def test_other_queries_run(spark, folder):
    from shotlens.llm.queries import QUERIES, SQL

    for name in sorted(set(QUERIES) - set(SQL) - {"p6_ids"}):
        df = QUERIES[name](spark, folder)
        assert len(set(df.columns)) == len(df.columns) and (df.count() > 0 or name.startswith("p8")), name
    assert set(SQL) <= set(QUERIES)
