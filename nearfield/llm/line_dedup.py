"""Near-duplicate lines over all documents, by an exact set-similarity join.

Native: DataFrame expressions only. A line's tokens are its different shingles
of five words, in an order that all lines share: rare ones first, by counts
over all lines, then by hash. Lines whose Jaccard similarity is at least t
share a token in their prefixes of n - ceil(t * n) + 1 tokens; the places of
that token and the lengths bound the overlap. What these filters leave is
verified. Equal lines are one node.

Texts are read three times and never shuffled but for lines that share a
token: to count shingles, for the lines' digests and prefixes, and for the
tokens of those lines.

The lines of a token are compared with one leader, those in another class with
a second. Only what is then in another class than the first leader is compared
with the token's other classes, so a group of near copies costs its size and
not its square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import SHINGLE_WORDS, SIMILARITY, discard, keyed, own, table, written
from nearfield.llm.components import components

#: Counters of shingles; one with as large a share of all occurrences as a counter has stands out, whatever the input.
COUNTERS = 1 << 17
#: How often a token's lines are compared with one leader before the rest is compared in full.
LEADERS = 2
_BLANK = " \t\x0b\x0c\r"


def _words(line: Column) -> Column:
    """The line's words, by single blanks that become one separator."""
    return F.filter(F.split(F.translate(line, _BLANK, " " * len(_BLANK)), " "), lambda w: w != "")


def _shingle(words: str, k: int, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(k)))


def _split(rows: DataFrame) -> DataFrame:
    """The rows' lines: line (number), text, words (joined by blanks), w (the words)."""
    lines = rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    # Most lines have single spaces only: then the line itself, trimmed, is its words.
    odd = F.contains("text", F.lit("  "))
    for c in _BLANK[1:]:
        odd = odd | F.contains("text", F.lit(c))
    joined = F.when(odd, F.array_join(_words(F.col("text")), " ")).otherwise(F.trim("text"))
    return lines.withColumn("words", joined).withColumn("digest", F.when(F.col("words") != "", F.unhex(F.md5("words"))))


def rarities(rows: DataFrame, k: int) -> Column:
    """How common the shingles of each counter are, from 0 to 31: twice the logarithm of its count over the mean.

    A constant of one byte per counter. Every occurrence in every line counts;
    the driver gets at most COUNTERS rows.
    """
    w = _split(rows.select("text")).select(F.split("words", " ").alias("w")).where(F.size("w") >= k)
    each = w.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i")).select(F.pmod(_shingle("w", k, F.col("i")), F.lit(COUNTERS)).alias("b"))
    found = each.groupBy("b").agg(F.count("*").alias("n")).toArrow()
    counts = dict(zip(found.column("b").to_pylist(), found.column("n").to_pylist()))
    mean = max(1.0, sum(counts.values()) / COUNTERS)
    return F.lit(bytearray(min(31, max(0, math.ceil(2 * math.log2(counts.get(b, 1) / mean)))) for b in range(COUNTERS)))


def line_table(rows: DataFrame, rarity: Column, least: float, k: int, with_text: bool) -> DataFrame:
    """Every line: lid and row (numbers of the line and of its document's row), doc_id, line, digest of its words (null without words), n (tokens) and the prefix.

    A token is its shingle's hash with the shingle's commonness as highest bits.
    """
    lines = _split(rows.withColumn("row", F.monotonically_increasing_id())).withColumn("lid", F.monotonically_increasing_id())
    lines = lines.withColumn("w", F.split("words", " "))

    def token(at: Column) -> Column:
        return _shingle("w", k, at)

    def ranked(t: Column) -> Column:
        common = F.ascii(F.substr(rarity, F.pmod(t, F.lit(COUNTERS)).cast("int") + 1, F.lit(1)).cast("string")).cast("long")
        return F.shiftleft(common, 58).bitwiseOR(F.shiftrightunsigned(t, 6))

    hashes = F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), token)).otherwise(F.array().cast("array<long>"))
    lines = lines.withColumn("hashes", hashes).withColumn("tokens", F.sort_array(F.transform(F.array_distinct("hashes"), ranked)))
    lines = lines.withColumn("n", F.size("tokens"))
    prefix = F.when(F.col("n") > 0, F.slice("tokens", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")))
    return lines.select("lid", "row", "doc_id", "line", "digest", "n", prefix.alias("prefix"), *(["text"] if with_text else []))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id"), F.col("line"), F.col("row"))


def _passes(n: Column, m: Column, i: Column, j: Column, least: float) -> Column:
    """Length filter, and positional filter for a token at places i and j (from 0)."""
    needed = F.ceil(F.lit(least / (1 + least)) * (n + m) - 1e-9)
    return (F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9) & (F.least(n - i, m - j) >= needed)


def _with(lines: DataFrame, digests: DataFrame, how: str = "left_semi") -> DataFrame:
    """The lines whose digest's hash is among those of ``digests``; with ``left_anti`` the others, which need not be moved."""
    return keyed(lines, F.xxhash64("digest"), digests.select(F.xxhash64("digest").alias("key")), digests.count(), how)


def similar_lines(lines: DataFrame, distinct: DataFrame, rows: DataFrame, least: float, k: int) -> DataFrame | None:
    """Links (u, v) between nodes of ``distinct`` (digest, node) that connect its classes; None without any."""
    repeated = distinct.where("copies > 1")
    again = _with(lines.where("n > 0").select("lid", "digest"), repeated)
    again = written(again.join(repeated.select("digest", "node").hint("merge"), "digest").where("lid <> node").select(F.col("lid").alias("key")), "line-again")
    prefixes = keyed(lines.where("n > 0").select(F.col("lid").alias("node"), "n", "prefix"), F.col("node"), again, again.count(), "left_anti")
    tokens = prefixes.select("node", "n", F.posexplode("prefix").alias("i", "token"))
    # Only tokens of several lines matter; counted first, so that single ones aren't moved again.
    several = written(tokens.groupBy("token").agg(F.count("*").alias("count")).where("count > 1").select(F.col("token").alias("key")), "line-tokens")
    shared = written(keyed(tokens, F.col("token"), several, several.count(), "left_semi"), "line-shared")
    discard(again, several)
    # Tokens of the lines that share one.
    wanted = distinct.join(shared.select("node").distinct(), "node", "left_semi").select("node", "digest")
    wanted = written(wanted.withColumn("key", F.xxhash64("digest")), "line-wanted")
    bodies = keyed(_split(rows.select("text")).select("digest", "words"), F.xxhash64("digest"), wanted.select("key").distinct(), wanted.count(), "left_semi")
    bodies = bodies.groupBy("digest").agg(F.first("words").alias("words")).join(wanted.select("node", "digest"), "digest").select("node", F.split("words", " ").alias("w"))
    tokens_of = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda at: _shingle("w", k, at)))
    bodies = written(bodies.select("node", tokens_of.alias("tokens")), "line-bodies")
    discard(wanted)

    links, of, nodes = None, None, 0

    def verified(pairs: DataFrame) -> None:
        nonlocal links, of, nodes
        pairs = written(pairs.distinct(), "line-pairs")
        ends = written(pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct(), "line-ends")
        some = keyed(bodies, F.col("node"), ends, ends.count(), "left_semi")
        a, b = (some.select(F.col("node").alias(v), F.col("tokens").alias(t)).hint("merge") for v, t in (("u", "a"), ("v", "b")))
        both = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("a", "b")))
        found = written(both.where(F.col("both") >= F.lit(least) * (F.size("a") + F.size("b") - F.col("both")) - 1e-9).select("u", "v"), "line-links")
        links = found if links is None else links.unionByName(found)
        discard(pairs, ends, of)
        of = written(components(links), "line-components")
        nodes = of.count()

    def classed(df: DataFrame, node: str, name: str) -> DataFrame:
        named = keyed(df, F.col(node), of.select(F.col("node").alias("key"), F.col("component").alias(name)), nodes, "left")
        return named.withColumn(name, F.coalesce(name, node))

    def led_by(df: DataFrame) -> DataFrame:
        first = df.groupBy("token").agg(F.min(F.struct("node", "n", "i")).alias("l"), F.count("*").alias("count")).where("count > 1")
        first = written(first.select(F.col("token").alias("key"), F.col("l.node").alias("leader"), F.col("l.n").alias("ln"), F.col("l.i").alias("li")), "line-leaders")
        led = written(keyed(df, F.col("token"), first, first.count(), "inner").where("node <> leader"), "line-led")
        discard(first)
        return led

    whole = led = led_by(shared)
    for turn in range(LEADERS):
        verified(led.where(_passes(F.col("n"), F.col("ln"), F.col("i"), F.col("li"), least)).select(F.col("leader").alias("u"), F.col("node").alias("v")))
        left = written(classed(classed(led, "node", "c"), "leader", "lc").where("c <> lc").select("token", "node", "n", "i"), "line-left")
        if led is not whole:
            discard(led)
        if left.isEmpty():
            break
        if turn < LEADERS - 1:
            led = led_by(left)
        discard(left)
    # What is still in another class than its token's first leader is compared with all of the token's other classes.
    strays = written(classed(classed(whole, "node", "c"), "leader", "lc").where("c <> lc"), "line-strays")
    if not strays.isEmpty():
        met = shared.join(strays.select("token").distinct(), "token", "left_semi")
        mine = written(met.groupBy("node").agg(F.array_sort(F.collect_list("token")).alias("mine")), "line-mine")  # a prefix at most
        met = written(classed(met, "node", "c").join(mine, "node"), "line-met")
        other = met.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("oc"), F.col("mine").alias("theirs"))
        here = written(strays.select("token", "node", "n", "i", "c").join(mine, "node"), "line-here")
        # A pair is looked at under its first token, where the positional filter holds.
        first = F.element_at(F.array_intersect("mine", "theirs"), 1) == F.col("token")
        pair = (F.col("c") != F.col("oc")) & _passes(F.col("n"), F.col("m"), F.col("i"), F.col("j"), least) & first
        rest = here.join(other, "token").where(pair)
        verified(rest.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")))
        discard(mine, met, here)
    discard(strays, whole, shared, bodies)
    return of


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, k: int = SHINGLE_WORDS, with_text: bool = False) -> DataFrame:
    """Every line with ``removed``: whether an earlier line is in its class.

    Lines are ordered by doc_id (null last), then by place. Lines without
    words are never removed; lines under five words only if an earlier one has
    the same words. Null texts are one empty line. Rows that repeat an id are
    documents of their own, the earlier read first. Classes are the connected
    components of lines with Jaccard similarity of at least ``least``. Texts
    and lines of any length are taken whole, other columns are ignored, an
    empty table gives an empty result.
    """
    rows = own(docs, doc_id=id_col, text=text_col)
    lines = written(line_table(rows, rarities(rows, k), least, k, with_text), "lines", compression="zstd")
    place = F.min(_order()).alias("at")
    distinct = lines.where("digest is not null").groupBy("digest").agg(F.min("lid").alias("node"), place, F.count("*").alias("copies"))
    distinct = written(distinct, "line-distinct")
    of = similar_lines(lines, distinct, rows, least, k)
    named = written(distinct.join(of, "node"), "line-named") if of is not None else distinct.limit(0).withColumn("component", F.col("node"))
    heads = written(named.groupBy("component").agg(F.min("at").alias("head"), F.count("*").alias("lines")), "line-heads")
    near = named.join(heads, "component").select("digest", "head", "lines")
    alone = distinct.where("copies > 1").join(named.select("digest"), "digest", "left_anti").select("digest", F.col("at").alias("head"), F.lit(1).cast("long").alias("lines"))
    classes = written(near.unionByName(alone), "line-classes")  # all other lines are alone and stay
    # Lines without a class, those without words among them, stay where they are.
    out = lines.drop("n", "prefix")
    alone = _with(out, classes, "left_anti").withColumns({c: F.lit(None).cast(classes.schema[c].dataType) for c in ("head", "lines")})
    out = _with(out, classes).join(classes.hint("merge"), "digest", "left").unionByName(alone)
    same = F.col("head").isNull() | (F.col("head.row") == F.col("row")) & (F.col("head.line") == F.col("line"))
    removed = F.col("digest").isNotNull() & ~same
    has_words = F.col("digest").isNotNull()
    return out.select("row", "doc_id", "line", *(["text"] if with_text else []), removed.alias("removed"), F.coalesce("lines", has_words.cast("long")).alias("class_lines"), has_words.alias("has_words"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id and the text without removed lines; one row per input row."""
    lines = mark_lines(docs, id_col, text_col, least, with_text=True)
    held = F.when(~F.col("removed"), F.struct("line", "text"))  # collect_list leaves out the nulls
    kept = lines.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(held)).alias("kept"))
    return kept.select("doc_id", F.array_join(F.transform("kept", lambda x: x["text"]), "\n").alias("text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and lines with near copies of every document."""
    lines = mark_lines(table(spark, sf_dir, "documents"))
    count = lambda c: F.sum(c.cast("long"))
    return lines.groupBy("row", "doc_id").agg(
        count(F.col("has_words")).alias("n_lines"),
        count(F.col("removed")).alias("n_removed"),
        count(F.col("class_lines") > 1).alias("n_near"),
        F.sum(F.when(F.col("removed"), F.xxhash64("line") % 1_000_003).otherwise(0)).alias("removed_digest"),
    ).drop("row")
