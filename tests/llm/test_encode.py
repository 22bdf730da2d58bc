"""Encoding in pieces gives what encoding at once gives; the defined cases; the round trip."""

import random

import numpy as np
import pytest

from shotlens.llm.encode import DEFAULT_RANKS, coder, decode_corpus, encode_corpus, token_counts

PARTS = ["a", "b", "the", " ", "  ", "\n", " \n\t", "'", "'s", "'re", "’", "1", "23", "é", "日", "本", "😀", "...", "==", "[[", "]]", " x", "\u00a0", "\u3000", "\x1c", "ing", "tion", "Zz"]


def text(g, mode):
    if mode == 0:
        return "".join(g.choice(PARTS) for _ in range(g.randint(20, 200)))
    if mode == 1:
        return "".join(g.choice("abcde") for _ in range(g.randint(50, 400)))
    if mode == 2:
        return "".join(g.choice(" \n\t\u3000") for _ in range(g.randint(20, 200))) + g.choice(["x", ""])
    if mode == 3:
        return g.choice(["a", "=", "\n", " ", "日", "9"]) * g.randint(20, 3000) + g.choice(["", "b'"])
    return " ".join(g.choice(["don't", "we're", "they'll", "I'd", "x1y2", "foo", "Bar"]) for _ in range(g.randint(10, 80)))


def tree(c, t, piece):
    level = max(1, int(np.ceil(np.log2(len(t) / piece))))
    cuts = [len(t) * j >> level for j in range((1 << level) + 1)]
    nodes = [tuple(np.asarray(x, np.int32) for x in c.leaf(t[a:b])) for a, b in zip(cuts, cuts[1:])]
    while len(nodes) > 1:
        nodes = [c.join(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


@pytest.mark.parametrize("mode", range(5))
def test_joins_are_exact(mode):
    c, g = coder(DEFAULT_RANKS), random.Random(mode)
    for _ in range(150):
        t = text(g, mode)
        ids, words = tree(c, t, g.choice([1, 2, 3, 5, 16, 40]) if len(t) < 400 else g.choice([30, 100, 400]))
        assert ids.tolist() == c.ids(t) and words.sum() == len(ids)


def test_long_unsplit_words():
    c, g = coder(DEFAULT_RANKS), random.Random(1)
    for t in ("".join(g.choice("abcdefgh") for _ in range(60_000)), "日本語" * 20_000, "=" * 50_000, " " * 50_000 + "x"):
        assert tree(c, t, 1000)[0].tolist() == c.ids(t)


def test_corpus(spark):
    c, g = coder(DEFAULT_RANKS), random.Random(2)
    texts = [None, "", " ", "\n\n", "<|endoftext|>", "x" * 30_000, ("word " * 9000) + "end", "日本" * 7000, *[text(g, i % 5) * g.randint(1, 40) for i in range(40)]]
    rows = [(i // 2 if i < 6 else i, t, "n", [1]) for i, t in enumerate(texts)] + [(None, "null key", "n", [1]), (7, texts[7], "n", [1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string, ids array<int>")
    got = sorted(((r.doc_id, tuple(r.ids)) for r in encode_corpus(df, "doc_id", "text", piece_chars=500).collect()), key=repr)
    assert got == sorted(((k, tuple(c.ids(t) if t else [])) for k, t, *_ in rows), key=repr)
    assert encode_corpus(df.where("false"), "doc_id", "text").count() == 0
    back = decode_corpus(encode_corpus(df.where("doc_id > 6"), "doc_id", "text", piece_chars=500), "doc_id")
    assert sorted(r.text for r in back.collect()) == sorted(t for k, t, *_ in rows if k and k > 6)
    n = token_counts(df, ["doc_id", "k"], "text").collect()
    assert sorted(r.n_tokens for r in n) == sorted(len(c.ids(t)) if t else 0 for _, t, *_ in rows)


def test_ids_of_the_documents(spark, folder):
    from shotlens.llm.queries import p6_ids

    c = coder(DEFAULT_RANKS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in p6_ids(spark, folder).collect()}
    assert got == {k: c.ids(t) if t else [] for k, t in texts.items()}


def test_counts_of_long_texts_go_through_the_tree(spark):
    g = random.Random(5)
    texts = [None, "", *("".join(text(g, m) for _ in range(6)) for m in range(5))]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "n int, source string, text string")
    got = {r.n: r.n_tokens for r in token_counts(docs, ["n", "source"], "text", whole_chars=100).collect()}
    assert got == {i: len(coder(DEFAULT_RANKS).ids(t)) if t else 0 for i, t in enumerate(texts)}
