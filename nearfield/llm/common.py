"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, everywhere in this subpackage.
WHITE = " \t\n\x0b\x0c\r"
#: One word.
WORD = "[^\\x20\\x09-\\x0D]+"
#: How many words a shingle has, and from which similarity texts count as near copies.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path for a written table, in the folder all executors share.

    That is the session's ``spark.checkpoint.dir``. Only where it is unset on a
    local master, as in tests, a local temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/nearfield-{name}-{uuid.uuid4().hex}"


#: Folders of the written tables that are still referred to.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to a new shared table and read it back.

    This cuts the lineage: a lost executor costs at most the tasks it ran, and
    what is derived from the table twice isn't computed twice.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = _FOLDERS.pop(df, None) if df is not None else None
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def own(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Whatever else the table carries can't clash with an operator's columns.
    """
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def sized(rows: int, each: int = 100_000) -> int:
    """How many tasks a table of that many short rows is worth."""
    return max(8, -(-rows // each))


_HELD: list = [None, None]


def held(key: str, make: Callable[[], Any]) -> Any:
    """What the tasks that a Python worker runs one after the other share.

    A worker keeps only the last key's, so one operator's memory doesn't stay
    while another's tasks run.
    """
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        gc.collect()
        _HELD[:] = [key, make()]
    return _HELD[1]


#: Keys that are broadcast at most; each takes some 24 bytes.
MOST_KEYS = 2_000_000


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps and variants, which have none, are left out."""
    hashed = [f"`{f.name.replace('`', '``')}`" for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*(F.col(c) for c in hashed))


def keyed(df: DataFrame, key: Column, table: DataFrame, count: int, how: str) -> DataFrame:
    """``df`` joined with ``table`` where ``key`` equals the table's column ``key``.

    The table is broadcast if its ``count`` rows are at most MOST_KEYS. Then the
    rows of ``df`` stay where they are; else both sides are shuffled.
    """
    name = unused(df, "key")
    right = table.withColumnRenamed("key", name)
    right = F.broadcast(right) if count <= MOST_KEYS else right.hint("merge")
    joined = df.join(right, key == right[name], how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(name)


def staying(df: DataFrame, key: Column, decided: DataFrame, same: list[str]) -> DataFrame:
    """The rows of ``df`` that stay, by ``decided``: key and stays of every row.

    Only keys that don't stand for one staying row are looked for, so most rows
    aren't moved. Rows of one key of which some stay are one document: one row
    of each value of the columns ``same`` stays.
    """
    odd = decided.groupBy("key").agg(F.count("*").alias("n"), F.count_if("stays").alias("stay"))
    odd = written(odd.where("n > 1 or stay = 0"), "odd-rows")
    of = odd.agg(F.count("*"), F.count_if(F.col("stay") > 0)).first()
    out = keyed(df, key, odd.select("key"), of[0], "left_anti")
    if of[1]:
        repeated = keyed(df, key, odd.where("stay > 0").select("key"), of[1], "left_semi")
        out = out.unionByName(repeated.dropDuplicates(same))
    return out
