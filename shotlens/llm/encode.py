"""Encoding of whole corpora with a public byte-level BPE tokenizer, long texts in pieces that are joined exactly.

Short texts are encoded as they stand.  A text longer than ``piece_chars`` is halved until no piece is longer; the pieces
are spread over all tasks, encoded apart, and joined pairwise, level by level, like a tree.  At a join a window of the last
words of the left and the first words of the right piece (a word is what the tokenizer's pattern splits off) is split and
encoded anew, and grows until a border in it, far enough from its end, is also a border in the right piece: from there on
the pattern finds the same words.  A single long word that the cut went through is joined the same way in tokens: the window
grows until its first and last token are those of the two sides; a sequence of byte-pair tokens is the encoding of its
bytes when every two neighbours are, and all neighbours lie within the left side, the window or the right side.

Defined results: a null and an empty text have no ids (an empty list); blank text is encoded like any other; strings of
special tokens are ordinary text; every row gives a row, repeated ids and rows included; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The splitting pattern of the tokenizer; white space is Unicode's property of that name.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern looks no farther than this many bytes beyond a word: two characters of a contraction, or one of any kind.
LOOKAHEAD = 16


class Coder:
    """The tokenizer in one process."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.words_of = regex.compile(_OWN).findall

    def ids(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def word(self, data: bytes) -> list[int]:
        return self.enc._encode_single_piece(data)

    def text(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def leaf(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and the number of ids of each word; no words if our pattern and the tokenizer's should ever disagree."""
        ids, lengths = self.ids(text), []
        mine: list[int] = []
        for w in self.words_of(text):
            got = self.word(w.encode())
            lengths.append(len(got))
            mine += got
        return (ids, lengths) if mine == ids else (ids, [])

    def join_word(self, a: np.ndarray, b: np.ndarray, k: int = 8) -> np.ndarray:
        """The encoding of one word out of the encodings of its two parts."""
        while True:
            left, right = a[-k:].tolist(), b[:k].tolist()
            mid = self.word(self.text(left) + self.text(right))
            if (k >= len(a) or mid[0] == left[0]) and (k >= len(b) or mid[-1] == right[-1]):
                return np.concatenate([a[: max(0, len(a) - k)], np.asarray(mid, np.int32), b[k:]])
            k *= 2

    def join(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ids per word of two neighbouring pieces as one; only the windows become Python numbers."""
        (ai, aw), (bi, bw) = a, b
        if not len(ai) or not len(bi):
            return b if not len(ai) else a
        if not len(aw) or not len(bw):
            both = self.leaf((self.text(ai.tolist()) + self.text(bi.tolist())).decode())
            return np.asarray(both[0], np.int32), np.asarray(both[1], np.int32)
        m = 4
        while True:
            la, lb = aw[-m:].tolist(), bw[:m].tolist()
            ta, tb = sum(la), sum(lb)
            left, right = ai[len(ai) - ta :].tolist(), bi[:tb].tolist()
            lbytes, rbytes = self.text(left), self.text(right)
            words = [w.encode() for w in self.words_of((lbytes + rbytes).decode())]
            whole = m >= len(bw)
            borders, at, place = {len(lbytes): 0}, 0, len(lbytes)  # byte position -> words of the right piece before it
            for n, count in enumerate(lb, 1):
                place += len(self.text(right[at : at + count]))
                at += count
                borders[place] = n
            end, pos, used = len(lbytes) + len(rbytes), 0, None
            for n, w in enumerate(words, 1):
                pos += len(w)
                if pos >= len(lbytes) and pos in borders and (pos + LOOKAHEAD <= end or (whole and pos == end)):
                    used = (n, borders[pos])
                    break
            # the left side agrees when the window's first word is the left piece's; at the start of the text it must
            if used and (m >= len(aw) or words[0] == self.text(left[: la[0]])):
                break
            m *= 2
        n, skip = used
        one, two = ai[len(ai) - int(aw[-1]) :], bi[: int(bw[0])]  # the words on either side of the cut
        middle = []
        for w in words[:n]:
            if len(w) > 1024 and w == self.text(one.tolist()) + self.text(two.tolist()):
                middle.append(self.join_word(one, two))
            else:
                middle.append(np.asarray(self.word(w), np.int32))
        ids = np.concatenate([ai[: len(ai) - ta], *middle, bi[int(bw[:skip].sum()) :]])
        lengths = np.concatenate([aw[: max(0, len(aw) - m)], np.asarray([len(x) for x in middle], np.int32), bw[skip:]])
        return ids, lengths


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _lists(rows: list[list[int]]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)].astype(np.int32)), pa.array(np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)))


def encode_corpus(docs: DataFrame, key: str, text: str, ranks: str = DEFAULT_RANKS, piece_chars: int = 4096) -> DataFrame:
    """(key, ids) for every row of docs."""
    kind = docs.schema[key].dataType.simpleString()
    x = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    long_ = F.length("t") > piece_chars

    def whole(batches):
        c = coder(ranks)
        for b in batches:
            ids = [np.asarray(c.ids(t) if t else [], np.int32) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), _lists(ids)], names=["k", "ids"])

    def split(batches):
        for b in batches:
            for i, t in enumerate(b.column("t").to_pylist()):
                level = max(1, int(np.ceil(np.log2(len(t) / piece_chars))))
                cuts = [len(t) * j >> level for j in range((1 << level) + 1)]
                for at in range(0, 1 << level, 256):  # some pieces at a time, so that a batch stays small
                    part = range(at, min(at + 256, 1 << level))
                    one = pa.array([0] * len(part))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("r").slice(i, 1).take(one), b.column("k").slice(i, 1).take(one), pa.array([level] * len(part), pa.int32()), pa.array(list(part), pa.int64()), pa.array([t[cuts[j] : cuts[j + 1]] for j in part], pa.string())],
                        names=["r", "k", "level", "piece", "t"],
                    )

    def leaves(batches):
        c = coder(ranks)
        for b in batches:
            got = [c.leaf(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("k"), b.column("level"), b.column("piece"), _lists([g[0] for g in got]), _lists([g[1] for g in got])], names=["r", "k", "level", "piece", "ids", "words"])

    def joins(batches):
        c = coder(ranks)
        for b in batches:
            got = []
            sides = b.column("sides")
            at, inner = sides.offsets.to_numpy(), sides.values
            ids, words = inner.field("ids"), inner.field("words")
            part = lambda x, i: x.values[x.offsets[i].as_py() : x.offsets[i + 1].as_py()].to_numpy()
            for first, end in zip(at[:-1].tolist(), at[1:].tolist()):
                parts = [(part(ids, i), part(words, i)) for i in range(first, end)]
                got.append(c.join(*parts) if len(parts) == 2 else parts[0])
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("k"), b.column("level"), b.column("piece"), _lists([g[0] for g in got]), _lists([g[1] for g in got])], names=["r", "k", "level", "piece", "ids", "words"])

    short = x.where(F.col("t").isNull() | ~long_).mapInArrow(whole, f"k {kind}, ids array<int>")
    node = f"r bigint, k {kind}, level int, piece bigint, ids array<int>, words array<int>"
    longs = x.withColumn("r", F.monotonically_increasing_id()).where(long_)
    longest = longs.agg(F.max(F.length("t"))).first()[0]
    if not longest:
        return short.select(F.col("k").alias(key), "ids")
    nodes = longs.select("r", "k", "t").mapInArrow(split, f"r bigint, k {kind}, level int, piece bigint, t string").repartition("r", "piece").mapInArrow(leaves, node)
    for level in range(max(1, int(np.ceil(np.log2(longest / piece_chars)))), 0, -1):
        pair = F.when(F.col("level") == level, F.floor(F.col("piece") / 2)).otherwise(F.col("piece"))
        nodes = nodes.groupBy("r", F.least("level", F.lit(level - 1)).alias("level"), pair.alias("piece")).agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("piece", "ids", "words"))).alias("sides"))
        nodes = nodes.select("r", "k", F.col("level").cast("int"), F.col("piece").cast("bigint"), "sides").mapInArrow(joins, node)
    return short.unionByName(nodes.select("k", "ids")).select(F.col("k").alias(key), "ids")


def decode_corpus(coded: DataFrame, key: str, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(key, text) out of (key, ids); bytes that are no UTF-8 become replacement characters."""
    kind = coded.schema[key].dataType.simpleString()

    def back(batches):
        c = coder(ranks)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([None if i is None else c.text(i).decode(errors="replace") for i in b.column("ids").to_pylist()], pa.string())], names=["k", "text"])

    return coded.select(F.col(key).alias("k"), "ids").mapInArrow(back, f"k {kind}, text string").select(F.col("k").alias(key), "text")


def token_counts(docs: DataFrame, columns: list[str], text: str, ranks: str = DEFAULT_RANKS, whole_chars: int = 1 << 16) -> DataFrame:
    """columns and n_tokens of every row; a null text has 0. Texts over ``whole_chars`` are encoded as trees of pieces."""
    x = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("k"), F.col(text).alias("t"))
    kind = x.schema["k"].dataType.simpleString()
    long_ = F.length("t") > whole_chars

    def count(batches):
        c = coder(ranks)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([len(c.ids(t)) if t else 0 for t in b.column("t").to_pylist()], pa.int64())], names=["k", "n_tokens"])

    out = x.where(F.col("t").isNull() | ~long_).mapInArrow(count, f"k {kind}, n_tokens bigint")
    longs = x.where(long_)
    if not longs.isEmpty():
        out = out.unionByName(encode_corpus(longs, "k", "t", ranks).select("k", F.size("ids").cast("bigint").alias("n_tokens")))
    return out.select(*[F.col(f"k.c{i}").alias(c) for i, c in enumerate(columns)], "n_tokens")
