"""The shape of vector tables, and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checked(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None, name: str = "vec_id") -> DataFrame:
    """Two columns, ``name`` (long) and ``embedding`` (array of double).

    A null id or vector, a vector of another width than ``dim``, and a null or
    NaN element raise an error when the row is read: a row is never dropped.
    """
    kind = df.schema[vector_col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise TypeError(f"{vector_col} must be an array of numbers, not {kind.simpleString()}")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    if dim is not None:
        sound = sound & (F.size(v) == dim)
    wrong = F.raise_error(F.lit(f"a row has no id or no vector of {dim or 'numbers'}")).cast("array<double>")
    return df.select(F.col(f"`{id_col}`").cast("long").alias(name), F.when(sound, v).otherwise(wrong).alias("embedding"))
