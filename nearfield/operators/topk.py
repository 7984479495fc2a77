"""The k best rows of each query, and the forms a result can take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(found: DataFrame, k: int, by: str = "distance", descending: bool = False, id_col: str = "vec_id") -> DataFrame:
    """Rows ranked from 1 within each query, the first k of them.

    Spark puts a limit per group before and after the shuffle.
    """
    order = F.desc(by) if descending else F.asc(by)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, id_col)))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def nested(hits: DataFrame) -> DataFrame:
    """One row per query with its hits in order: array of (distance, vec_id)."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "distance", "vec_id")))
    return hits.groupBy("query_id").agg(F.transform(rows, lambda h: F.struct(h["distance"].alias("distance"), h["vec_id"].alias("vec_id"))).alias("hits"))


def split(hits: DataFrame) -> DataFrame:
    """One row per query with two parallel arrays, distances and indices."""
    return nested(hits).select("query_id", F.transform("hits", lambda h: h["distance"]).alias("distances"), F.transform("hits", lambda h: h["vec_id"]).alias("indices"))


def exploded(parallel: DataFrame) -> DataFrame:
    """The rows of two parallel arrays again, ranked from 1."""
    rows = parallel.select("query_id", F.posexplode(F.arrays_zip("distances", "indices")).alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("hit.indices").alias("vec_id"), F.col("hit.distances").alias("distance"))


def padded(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nested hits of every query, filled up to k in front with (0.0, 0)."""
    rows = queries.select("query_id").join(nested(hits), "query_id", "left")
    kind = "array<struct<distance:double,vec_id:bigint>>"
    found = F.coalesce("hits", F.array().cast(kind))
    fill = F.array_repeat(F.struct(F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("vec_id")), F.greatest(F.lit(0), F.lit(k) - F.size(found)))
    return rows.select("query_id", F.concat(fill.cast(kind), found).alias("hits"))


def order_by_distance(rows: DataFrame, by: str = "distance", id_col: str = "vec_id") -> DataFrame:
    """All rows of each query in descending order, ranked from 1."""
    return top_k(rows, (1 << 31) - 1, by, descending=True, id_col=id_col)
