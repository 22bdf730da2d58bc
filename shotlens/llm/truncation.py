"""Texts that were stopped before their end.

The decision rests on a trie over the vocabulary of the corpus: a table of nodes with how often the node is a word by itself
and how often words below it stand.  Only the nodes that end a text are made.  The final token of a text is

* a stump, when it is unknown as a word and a proper prefix of known words: the text broke off inside that word (``word``),
* whole, when it is a known word or has no letters: the text may have ended or broken off between two words,
* strange, when the trie has no such node: a name or a slip of an editor, no evidence of a break.

A stump is enough by itself.  A whole token needs the evidence of lengths: the text stands at a limit of its source, a length
in characters or bytes that far more texts have than lengths nearby (``limit``).  Without a limit the sentence rule may add
it (``sentence``, ``abbreviation``): the line stops without a mark in a way in which lines of its kind (prose, list, heading,
...) hardly ever end.  For that are counted, for each kind of line and pair of neighbouring tokens in general form (names as A,
digits as 0), how often a line ends with the pair and how often it goes on, and for each token that ends in a mark how often
a sentence ends there (``p.`` against ``week.``).  Where lines often end like that nothing is a break, a stump neither.
Markup that is not closed (link, tag, reference, template, table, half a heading) is a third kind of evidence, apart from the
trie.  ``truncation_rates`` reports each reason's count, so that what the rules add to the trie can be seen.

A mark after the break (three dots, "[...]", "(truncated)") is taken off first unless the corpus knows the token with it.
What editors wrote, spam and pages that end in lists, tables, categories or signatures end as lines of other pages do.

Layout: equal lines of all texts are counted first, with map-side combining, since revisions and mirrors repeat them; the rest
works on each different line once, weighted.  A text is never moved as a whole, only its lines, and one row per text with its
last line.  Tables of tokens are joined to the last lines by shuffles, never collected.  Tokens may have any length: prefixes
of up to ``STEM`` characters are nodes, longer ones are compared within the words that share their first ``STEM`` characters.

Defined results: null, empty and blank texts are not truncated; repeated rows are judged alike, and count as often as they
stand; rows with a null source have no limits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.session import cut

#: Fixed patterns.
#: White space, controls and characters without width, of which a text's end may have any number.
INVISIBLE = "".join(map(chr, [*range(0x21), 0x7F, 0x85, 0xA0, 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, *range(0x2060, 0x2065), 0x3000, 0xFEFF]))
#: Runs of such characters within a line, a single blank apart.
GAP = r"[ ]{2,}|[ ]?[\p{Z}\p{Cf}\x00-\x1f\x7f&&[^ \n]][\p{Z}\p{Cf}\x00-\x1f\x7f&&[^\n]]*"
#: So many limits of fields (a few for each source) are broadcast to the texts; more are joined by a shuffle.
MOST_LIMITS = 100_000
#: Prefixes up to this length are nodes of the trie; longer ones are looked up among the words with the same beginning.
STEM = 64
MARKED = r"[ ]*(\.\.\.|…|\[\.\.\.\]|\[…\]|\(\.\.\.\)|\[\s*(?i:truncated)\s*\]|\((?i:truncated)\)|&hellip;)$"
WORD = r"\p{L}+(?:['’]\p{L}+)*"
NAME = r"""(?<=^| )['"“‘(\[{|*#:=]*\p{Lu}(?:[\p{Ll}\p{N}_\-’'][\p{L}\p{M}\p{N}_\-’']*)?"""
OPEN_END = r"""[\p{L}\p{M}\p{N},;:\-–—(\['"“„«’&/#=+_¿¡]$"""


def _kind(line: Column) -> Column:
    first = F.substring(line, 1, 1)
    return F.when(first.rlike(r"[*#:;|!=\[{<]"), first).otherwise("p")


def _shapes(line: Column) -> Column:
    # numbers of any length are alike, but the minutes of a time keep their number of digits
    x = F.regexp_replace(F.regexp_replace(line, NAME, "A"), r"(?<![0-9]:)(?<![0-9]:[0-9])[0-9]+", "0")
    return F.split(F.regexp_replace(x, r"[0-9]", "0"), " ")


def _context(token: Column) -> Column:
    """The token before, as a key: a long one by its digest."""
    return F.when(F.length(token) <= STEM, token).otherwise(F.md5(token))


def _final_word(line: Column) -> Column:
    """The letters (with single apostrophes between) that end the line."""
    tail = F.regexp_replace(F.substring_index(line, " ", -1), r"^.*[^\p{L}'’]", "")
    tail = F.regexp_replace(F.regexp_replace(tail, r"^.*['’]{2}", ""), r"^['’]", "")
    return F.when(tail.rlike(r"\p{L}$"), tail).otherwise(F.lit(""))


def length_limits(docs: DataFrame, source: str, text: str, least: int = 8, times: float = 6.0, around: int = 20) -> DataFrame:
    """(source, unit, size): lengths in chars or bytes that ``least`` texts or more have, and ``times`` as many as lengths nearby on average."""
    sizes = docs.where(F.col(text).isNotNull() & F.col(source).isNotNull()).select(
        F.col(source).alias("source"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).alias("size")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("size")))).alias("x")
    )
    n = sizes.groupBy("source", "x.unit", "x.size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-around, around)  # one row for each length
    rest = (F.sum("n").over(near) - F.col("n")) / (2.0 * around)
    return n.withColumn("rest", rest).where((F.col("n") >= least) & (F.col("n") > times * F.col("rest") + 4)).select("source", "unit", "size")


def prefix_counts(items: DataFrame, asked: DataFrame, context: list[str], token: str, n: str, name: str) -> DataFrame:
    """(context..., token, name): for each asked token the sum of ``n`` over the items of its context of which it is a proper prefix."""
    asked = asked.select(*context, token).where(F.col(token) != "").distinct()
    near = items.join(asked.select(*context).distinct(), context, "left_semi") if context else items
    cuts = F.sequence(F.lit(1), F.least(F.length(token) - 1, F.lit(STEM)))
    nodes = near.where(F.length(token) > 1).select(*context, F.explode(F.transform(cuts, lambda k: F.substring(F.col(token), F.lit(1), k))).alias(token), F.col(n).alias("_n"))
    short = nodes.groupBy(*context, token).agg(F.sum("_n").alias(name)).join(asked.where(F.length(token) <= STEM), [*context, token], "left_semi")
    stem = F.left(F.col(token), F.lit(STEM)).alias("_stem")
    long_ = asked.where(F.length(token) > STEM).select(*context, token, stem)
    words = near.where(F.length(token) > STEM).select(*context, F.col(token).alias("_w"), stem, F.col(n).alias("_n"))
    far = long_.join(words, [*context, "_stem"]).where(F.col("_w").startswith(F.col(token)) & (F.col("_w") != F.col(token)))
    return short.unionByName(far.groupBy(*context, token).agg(F.sum("_n").alias(name)))


class CorpusEnds:
    """Counts over all texts of docs (key, page, source, text)."""

    def __init__(self, docs: DataFrame, key: str, page: str, source: str, text: str, known: int = 3):
        x = docs.select(F.col(key).alias("key"), F.col(page).alias("page"), F.col(source).alias("source"), F.col(text).alias("text"))
        limits = cut(length_limits(x, "source", "text"))
        chars = limits.where("unit = 'chars'").select("source", F.col("size").alias("n_chars"), F.lit(True).alias("at_chars"))
        # a cut after a number of bytes falls back to the border of a character, up to three bytes before
        by = limits.where("unit = 'bytes'").select("source", F.explode(F.sequence(F.col("size") - 3, F.col("size"))).alias("n_bytes"), F.lit(True).alias("at_bytes")).distinct()
        x = x.withColumns({"n_chars": F.length("text"), "n_bytes": F.octet_length("text")})
        small = F.broadcast if limits.count() <= MOST_LIMITS else lambda df: df
        x = x.join(small(chars), ["source", "n_chars"], "left").join(small(by), ["source", "n_bytes"], "left")
        x = x.withColumn("at_limit", F.col("at_chars").isNotNull() | F.col("at_bytes").isNotNull())
        self.docs = x.select("key", "page", "source", "at_limit", F.rtrim("text", F.lit(INVISIBLE)).alias("body")).where("body <> ''")
        self.known = known
        # each different line: how often within a text, how often as the last line, and on which pages (two are enough)
        line = self.docs.select(F.coalesce(F.xxhash64("page"), F.lit(0)).alias("page"), "at_limit", F.split("body", "\n").alias("lines"))
        line = line.select("page", "at_limit", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line"))
        last = F.col("at") == F.col("n_lines") - 1
        fair = ~(last & F.col("at_limit"))  # a text at a limit is no example of an end
        self.lines = cut(
            line.groupBy("line").agg(
                F.count("*").alias("n"), F.count_if(~last).alias("inner"), F.count_if(fair).alias("fair"),
                F.min(F.when(fair, F.col("page"))).alias("page1"), F.max(F.when(fair, F.col("page"))).alias("page2"),
            )
        )
        line = self.lines.withColumn("line", F.trim(F.regexp_replace("line", GAP, " "))).where("line <> ''")
        tok = line.select("n", "inner", "fair", "page1", "page2", _kind(F.col("line")).alias("kind"), _shapes(F.col("line")).alias("sh"))
        # neighbours come from shifted copies of the array, so that a token is a plain row after the explode
        none = F.array(F.lit(""))
        trio = F.arrays_zip(F.concat(none, F.slice("sh", 1, F.size("sh") - 1)).alias("prev"), F.col("sh").alias("tok"), F.concat(F.slice("sh", 2, F.size("sh")), none).alias("next"))
        tok = tok.withColumn("size", F.size("sh")).select("n", "inner", "fair", "page1", "page2", "kind", "size", F.posexplode(trio).alias("i", "t"))
        tok = tok.select("n", "inner", "fair", "page1", "page2", "kind", _context(F.col("t.prev")).alias("prev"), "t.tok", "t.next", (F.col("i") == F.col("size") - 1).alias("ends"))
        ends, marked = F.col("ends"), F.right(F.col("tok"), F.lit(1)).rlike(r"[^\p{L}\p{N}]")
        times = F.when(ends, F.col("inner")).otherwise(F.col("n"))  # what the end of a text has is no evidence of how texts go on
        stops = ends | F.col("next").rlike(r"^(A|[^\p{L}\p{N}])")
        self.pairs = cut(
            tok.groupBy("kind", "prev", "tok").agg(
                F.sum(F.when(ends, 0).otherwise(F.col("n"))).alias("goes_on"), F.sum(F.when(ends, F.col("fair")).otherwise(0)).alias("ends"),
                F.sum(F.when(marked, times).otherwise(0)).alias("seen"), F.sum(F.when(marked & stops, times).otherwise(0)).alias("stops"),
                F.min(F.when(ends, F.col("page1"))).alias("page1"), F.max(F.when(ends, F.col("page2"))).alias("page2"),
            )
        )
        self.marked = self.pairs.where("seen > 0").groupBy("tok").agg(F.sum("seen").alias("seen"), F.sum("stops").alias("stops"))
        # the last token of a text may be a piece of a word, so it is no evidence that the word exists
        tail = F.substring_index("line", " ", -1)
        before = F.left(F.col("line"), F.length("line") - F.length(tail))
        found = lambda t, n: F.transform(F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.struct(w.alias("word"), F.col(n).alias("n")))
        words = line.select(F.explode(F.concat(found(before, "n"), found(tail, "inner"))).alias("w")).select("w.word", "w.n").where("n > 0")
        self.words = cut(words.groupBy("word").agg(F.sum("n").alias("n")))

    def trie(self, asked: DataFrame) -> DataFrame:
        """(word, word_n, below) of the nodes that ``asked`` (word) reaches: how often it is a known word, and how often known words go on below it."""
        vocabulary = self.words.where(f"n >= {self.known}")
        below = prefix_counts(vocabulary, asked, [], "word", "n", "below")
        return vocabulary.select("word", F.col("n").alias("word_n")).join(asked.select("word").distinct(), "word", "left_semi").join(below, "word", "full")

    def contexts(self, asked: DataFrame) -> DataFrame:
        """(kind, prev, tok, goes_on, ended, page1, page2, longer) of the line ends in ``asked``."""
        at = ["kind", "prev", "tok"]
        longer = prefix_counts(self.pairs.withColumn("all", F.col("ends") + F.col("goes_on")), asked, ["kind", "prev"], "tok", "all", "longer")
        ended = self.pairs.where("ends > 0").select(*at, "goes_on", F.col("ends").alias("ended"), "page1", "page2")
        return ended.join(asked.select(*at).distinct(), at, "left_semi").join(longer, at, "full")


def _unclosed(text: Column, opened: str, closed: str) -> Column:
    """Whether the last ``opened`` in text has no ``closed`` after it."""
    return F.contains(text, F.lit(opened)) & ~F.contains(F.substring_index(text, opened, -1), F.lit(closed))


def truncated_texts(docs: DataFrame, key: str = "doc_id", page: str = "page_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, at_limit, reason) for every truncated text."""
    c = CorpusEnds(docs, key, page, source, text)
    d = c.docs.withColumn("line", F.trim(F.regexp_replace(F.substring_index("body", "\n", -1), GAP, " ")))
    # a token with a mark that the corpus has elsewhere, on several pages, is an end that was written
    d = d.withColumn("marked_tok", F.when(F.right(F.col("line"), F.lit(STEM)).rlike(MARKED), F.element_at(_shapes(F.col("line")), -1)))
    d = d.select("key", "source", "at_limit", "line", "marked_tok", _unclosed(F.col("body"), "{|", "|}").alias("open_table"))
    m = c.marked.where("seen >= 3").select(F.col("tok").alias("marked_tok"), F.lit(True).alias("usual"))
    d = d.join(m, "marked_tok", "left").withColumn("mark", F.col("marked_tok").isNotNull() & F.col("usual").isNull())
    line = F.trim(F.when(F.col("mark"), F.regexp_replace("line", MARKED, "")).otherwise(F.col("line")))
    d = d.select("key", "source", "at_limit", "mark", "open_table", line.alias("line")).where("line <> ''")
    sh = _shapes(F.col("line"))
    d = d.withColumns({"kind": _kind(F.col("line")), "tok": F.element_at(sh, -1), "prev": _context(F.coalesce(F.get(sh, F.size(sh) - 2), F.lit(""))), "word": _final_word(F.col("line")), "final": F.right(F.col("line"), F.lit(1))})
    d = cut(d)
    d = d.join(c.contexts(d), ["kind", "prev", "tok"], "left").join(c.marked.select("tok", "seen", "stops"), "tok", "left").join(c.trie(d), "word", "left")
    n = {x: F.coalesce(F.col(x), F.lit(0)) for x in ("goes_on", "ended", "longer", "seen", "stops", "word_n", "below")}
    share = F.when(F.col("at_limit"), 0.5).otherwise(0.3)
    usual = (n["ended"] >= 3) & (F.col("page1") != F.col("page2")) & (n["ended"] * 8 >= n["longer"]) & (n["ended"] >= share * (n["ended"] + n["goes_on"]))
    x, kind = F.col("line"), F.col("kind")
    after_ref = F.substring_index(x, "<ref>", -1)
    open_end = (x.rlike(OPEN_END) | ((kind == "p") & F.col("final").isin("{", "|"))) & ~x.rlike(r"""[.!?。]["'”’]+$""") & ~usual
    script = x.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]$")
    # what the trie says of the final token
    stump = (F.col("word") != "") & (n["word_n"] == 0) & (n["below"] >= c.known)
    whole = (F.col("word") == "") | (n["word_n"] > 0)
    capitals = (F.col("word") != "") & (kind != "p") & (x == F.upper(x))  # an entry in capitals is no sentence
    reason = (
        F.when(F.col("open_table"), "table")
        .when(_unclosed(x, "[[", "]]"), "link")
        .when(_unclosed(x, "<", ">") & F.substring_index(x, "<", -1).rlike(r"^(/?[A-Za-z!]|$)"), "tag")
        .when(_unclosed(x, "<ref>", "</ref>") & ~after_ref.rlike(r"\. \p{Lu}"), "reference")
        .when(_unclosed(x, "{{", "}}") & ~x.rlike(r"[!|]$"), "template")
        .when(x.rlike(r"^==+[^=]+=?$"), "heading")
        .when(open_end & stump, "word")
        .when(open_end & whole & F.col("at_limit"), "limit")
        .when(open_end & (script | (whole & ~capitals)), "sentence")
        .when((kind == "p") & (F.col("final") == ".") & (n["seen"] >= 5) & (n["stops"] < 0.2 * n["seen"]), "abbreviation")
        .when((kind == "p") & F.col("final").isin("}", "]", ">", ")") & ~F.right(x, F.lit(STEM)).rlike(r"(/>|</ref>|/\w+>)$") & ~usual, "sentence")
    )
    out = d.withColumn("reason", reason).where("reason is not null")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "at_limit", "reason")


#: The kinds of evidence that ``truncation_rates`` counts.
EVIDENCE = {"n_word": ["word"], "n_limit": ["limit"], "n_markup": ["table", "link", "tag", "reference", "template", "heading"], "n_sentence": ["sentence", "abbreviation"]}


def truncation_rates(docs: DataFrame, found: DataFrame, key: str, source: str) -> DataFrame:
    """For each source its documents, how many of them are truncated, by which evidence, how many of those at a limit, and the share."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    parts = [F.count_if(F.col("reason").isin(r)).alias(name) for name, r in EVIDENCE.items()]
    hit = found.groupBy(F.col(source).alias("s")).agg(F.count("*").alias("n_truncated"), F.count_if("at_limit").alias("n_at_limit"), *parts)
    both = n.join(hit, F.col("source").eqNullSafe(F.col("s")), "left").fillna(0, ["n_truncated", "n_at_limit", *EVIDENCE])
    return both.select("source", "n_docs", "n_truncated", "n_at_limit", *EVIDENCE, F.round(F.col("n_truncated") / F.col("n_docs"), 6).alias("share"))
