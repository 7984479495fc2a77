"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times,
and once more with probability r - floor(r). Which documents are taken once
more is a balanced sample (Deville and Tillé 2004): the vector of inclusion
probabilities moves within the null space of the constraints, here the number
of documents and of words, until each is 0 or 1 but for at most as many as
there are constraints. Blocks of a source do this independently; what each
leaves open goes on together, block by block of the leavings, until one small
block is left per source, whose last documents are settled by trying all ways.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import WORD, keyed, row_key, table, unused, written

BLOCK = 4096
#: With more sources than this the plan is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Documents of a source that are settled by trying all ways.
LANDING = 12
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
_EPS = 1e-9


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Split ``total`` by weight; no share exceeds ``most`` times its size, the excess is shared again."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        sum_ = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / sum_ > most * sizes[k]]
        if not over:
            for k in free:
                target[k] = left * weights[k] / sum_
            break
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in over)
        free -= set(over)
    return target


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move probabilities until at most ``leave`` units, two or more, are neither 0 nor 1.

    Three open units at a time have a null space for the two constraints, the
    sums of p and of p * size; a random step within it ends at a 0 or a 1.
    """
    p = p.copy()
    x = sizes / max(1.0, float(sizes.max(initial=1)))
    queue = [k for k in rng.permutation(len(p)).tolist() if _EPS < p[k] < 1 - _EPS]
    active, queue = queue[:3], queue[3:]
    queue.reverse()
    while len(active) == 3 and len(active) + len(queue) > leave:
        i, j, k = active
        u = (x[j] - x[k], x[k] - x[i], x[i] - x[j])  # orthogonal to (1, 1, 1) and to the sizes
        if max(map(abs, u)) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[a]) / v if v > 0 else -p[a] / v) for a, v in zip(active, u) if v)
        down = min((p[a] / v if v > 0 else (p[a] - 1) / v) for a, v in zip(active, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for a, v in zip(active, u):
            p[a] += step * v
            if p[a] < _EPS:
                p[a] = 0.0
            elif p[a] > 1 - _EPS:
                p[a] = 1.0
            else:
                left.append(a)
        active = left
        while queue and len(active) < 3:
            active.append(queue.pop())
    return p


def landing(p: np.ndarray, sizes: np.ndarray, wanted: float) -> np.ndarray:
    """Settle the few open units so that the words taken come nearest to ``wanted``."""
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    p = np.where(p >= 1 - _EPS, 1.0, np.where(p <= _EPS, 0.0, p))
    if len(open_):
        base = float((np.delete(p, open_) * np.delete(sizes, open_)).sum())
        ways = np.array(list(itertools.product((0.0, 1.0), repeat=len(open_))))
        p[open_] = ways[np.lexsort((ways.sum(axis=1), np.abs(base + ways @ sizes[open_] - wanted)))[0]]
    return p


def _moved(last: bool, seed: int):
    def each(rows: pa.Table) -> pa.Table:
        # Arrow keeps ids as they are, also beside nulls.
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "size", "key", "p")])  # nulls last
        sizes, p = rows["size"].to_numpy().astype(float), rows["p"].to_numpy().copy()
        rng = np.random.default_rng([seed, rows["block"][0].as_py(), len(rows), int(sizes.sum())])
        alone = rows["blocks"][0].as_py() <= 1  # the source's last block
        moved = flight(p, sizes, rng, LANDING if alone else 2)
        if last:
            moved = landing(moved, sizes, float(np.dot(p, sizes)))
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(moved, pa.float64()))

    return each


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """How often each document is taken, and its words.

    One row per input row: doc_id, source, size, source_size, target (of the
    source), copies, taken = copies * size. Sources stand in order of their
    code points, null last, and ``weights`` repeat over them. Null and empty
    texts have size 0; a source of size 0 has target 0 and takes nothing.
    Rows that repeat count as documents of their own. The same input gives the
    same result: blocks come from hashes, and the seed is fixed. The driver
    sees one row per source. An empty table gives an empty result.
    """
    out = _mix(docs, id_col, text_col, source_col, weights, share, block, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, block: int, seed: int) -> DataFrame:
    spark = docs.sparkSession
    named = [F.col(f"`{old}`").alias(new) for new, old in (("doc_id", id_col), ("text", text_col), ("source", source_col))]
    rows = docs.select(*named, row_key(docs).alias("key"))
    sized = written(rows.select("doc_id", "source", size_of(F.col("text")).alias("size"), "key", F.lit(0).cast("long").alias("salt")), "mix-sizes")
    # Rows that repeat as a whole would all meet in one block.
    repeated = written(sized.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block // 8).select("key"), "mix-repeated")
    if many := repeated.count():
        mark = keyed(sized.drop("salt"), F.col("key"), repeated.withColumn("again", F.lit(True)), many, "left")
        sized = written(mark.withColumn("salt", F.when("again", F.monotonically_increasing_id()).otherwise(0)).drop("again"), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    found = sorted(totals.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["source_size"] for r in found]
    targets = capped_targets(sizes, [weights[k % len(weights)] for k in range(len(found))], share * sum(sizes))
    plan = [
        (r["source"], r["source_size"], float(t), float(t / r["source_size"]) if r["source_size"] else 0.0, -(-r["docs"] // block), k)
        for k, (r, t) in enumerate(zip(found, targets))
    ]
    plan_df = spark.createDataFrame(plan, "plan_source string, source_size long, target double, rate double, blocks long, rank long")
    # Blocks are numbered over all sources, so that every block has a number of its own.
    ranked = sized.join(F.broadcast(plan_df) if len(plan) <= MOST_BROADCAST else plan_df, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    whole = F.floor(F.col("rate") + 1e-12)
    rest = F.col("rate") - whole
    now = ranked.select(
        "doc_id", "source", "size", "source_size", "target", "rank", "blocks",
        whole.cast("long").alias("whole"),
        F.when((rest <= 1e-9) | (F.col("size") == 0), 0.0).otherwise(rest).alias("p"),
        F.pmod(F.xxhash64("doc_id", "size", "key", "salt"), F.col("blocks")).alias("block"),
        "key",
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema)
    is_open = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    most = max([b for *_, b, _ in plan], default=1)
    done = []
    while True:
        last = most <= 1
        stepped = now.where(is_open).groupBy("rank", "block").applyInArrow(_moved(last, seed), schema)
        moved = written(stepped.unionByName(now.where(~is_open)), "mix-level")
        if last:
            done.append(moved)
            break
        done.append(moved.where(~is_open))
        # A block leaves two documents at most, so this many blocks leave a block's worth.
        most = -(-most // (block // 2))
        now = moved.where(is_open).withColumn("block", F.floor(F.col("block") / (block // 2)).cast("long"))
        now = now.withColumn("blocks", F.ceil(F.col("blocks") / (block // 2)).cast(moved.schema["blocks"].dataType))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.when(F.col("p") >= 0.5, 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with all their columns.

    Most documents of a source are taken equally often; that number goes with
    the source. Only keys of the others are looked for. Rows that are equal in
    all columns are taken as often as all of them together.
    """
    found = written(_mix(docs, id_col, text_col, source_col, WEIGHTS, SHARE, BLOCK, 7).select("source", "key", "copies"), "mix-copies")
    usual = found.groupBy("source", "copies").agg(F.count("*").alias("n")).groupBy("source").agg(F.max_by("copies", F.struct("n", "copies")).alias("usual"))
    usual = written(usual, "mix-usual").withColumnRenamed("source", "usual_source")
    few = usual.count() <= MOST_BROADCAST
    marked = found.join(F.broadcast(usual) if few else usual, F.col("source").eqNullSafe(F.col("usual_source")))
    odd = marked.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("total"), F.min("usual").alias("usual"))
    odd = written(odd.where("n > 1 or total <> usual").select("key", "n", "total"), "mix-odd")

    names = {}
    for name in ("usual_source", "usual", "n", "total", "number"):
        names[name] = unused(docs, f"mix_{name}")
    plan = usual.select(F.col("usual_source").alias(names["usual_source"]), F.col("usual").alias(names["usual"]))
    of = odd.select("key", F.col("n").alias(names["n"]), F.col("total").alias(names["total"]))
    joined = docs.join(F.broadcast(plan) if few else plan, F.col(f"`{source_col}`").eqNullSafe(F.col(names["usual_source"])))
    # Computed of the documents' own columns alone, on either side of the first join.
    joined = keyed(joined, row_key(docs), of, odd.count(), "left")
    times = F.coalesce(names["total"], names["usual"])
    kept = [F.col(f"`{c}`") for c in docs.columns]
    again = lambda df: df.where(times > 0).select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias(names["number"])).select(*kept)
    out = again(joined.where(F.coalesce(names["n"], F.lit(1)) == 1))
    if not odd.where("n > 1").isEmpty():
        several = joined.where(F.col(names["n"]) > 1).withColumn(names["number"], row_key(docs))
        out = out.unionByName(again(several.dropDuplicates([names["number"], id_col, source_col, text_col])))
    return out


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken for every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
