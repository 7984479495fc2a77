"""Connected components of a graph that may be larger than the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import discard, sized, written


def _stars(links: DataFrame, large: bool, width: int) -> DataFrame:
    """Link each node's neighbours (those above it, or those below it) to the least of them and it; written."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written first, so that Spark may split the links of a node with very many.
    least = written(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")).coalesce(width), "least")
    joined = near.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined
    out = moved.select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("least").alias("v")))
    moved = written(out.where("u <> v").distinct().coalesce(width), "stars")
    discard(least)
    return moved


def components(links: DataFrame) -> DataFrame:
    """Node and its component, the least node of it, for every node with a link.

    A component's least node has a row too.

    ``links`` has two columns u and v of one orderable type. Large and small
    stars alternate (Kiveris et al. 2014) until only stars are left, in about
    log(longest path) rounds; each round is written to the shared folder. As
    many tasks write as the links ask for, however many a shuffle has.
    """
    width = sized(links.count())
    now = written(links.select("u", "v").coalesce(width), "links")
    while True:
        large = _stars(now, True, width)
        discard(now)
        now = _stars(large, False, width)
        discard(large)
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        met = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if met.where("up > 1 or (up = 1 and down = 1)").coalesce(width).isEmpty():
            break
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
