"""Made vectors, the same for the same seed on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _hashes(dim: int, seed: int, make) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: make(F.xxhash64(F.col("vec_id"), i, F.lit(seed))))


def _ids(spark: SparkSession, rows: int | DataFrame) -> DataFrame:
    return rows.select("vec_id") if isinstance(rows, DataFrame) else spark.range(rows).withColumnRenamed("id", "vec_id")


def random_vectors(spark: SparkSession, rows: int | DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """vec_id from 0, or those of a table, and floats in [0, 1)."""
    made = _hashes(dim, seed, lambda h: (F.pmod(h, F.lit(1 << 24)) / F.lit(float(1 << 24))).cast("float"))
    return _ids(spark, rows).select("vec_id", made.alias("embedding"))


def random_bytes(spark: SparkSession, rows: int | DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """vec_id from 0, or those of a table, and whole numbers from 0 to 255."""
    made = _hashes(dim, seed, lambda h: F.pmod(h, F.lit(256)).cast("short"))
    return _ids(spark, rows).select("vec_id", made.alias("embedding"))
