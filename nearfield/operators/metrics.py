"""Measures of results and of training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(truth: DataFrame, got: DataFrame) -> DataFrame:
    """One row: the share of true hits that were found, on average over queries."""
    sets = lambda df, name: df.groupBy("query_id").agg(F.collect_set("vec_id").alias(name))
    both = sets(truth, "truth").join(sets(got, "got"), "query_id", "left")
    share = F.size(F.array_intersect("truth", F.coalesce("got", F.array().cast("array<bigint>")))) / F.size("truth")
    return both.agg(F.avg(share).alias("recall"))


def centroid_shift(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the mean absolute change of a centroid's element."""
    change = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    pairs = before.select("cell", F.col("centroid").alias("a")).join(after.select("cell", F.col("centroid").alias("b")), "cell")
    return pairs.select(F.explode(change).alias("d")).agg(F.avg("d").alias("shift"))
