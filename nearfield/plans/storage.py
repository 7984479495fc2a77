"""Inverted files on shared storage.

    path/data/<name>/part-*.parquet     vectors sorted by cell
    path/versions/<n>/manifest          file, cell, rows and radius of each part of a cell
    path/versions/<n>/{settings,centroids,codebook}

A version is never changed. Its manifest is written last, so a version is there
once that is complete, and the highest such is the current one. A new version
may go on using the files of an earlier one; nothing is overwritten or deleted,
so what reads an older version, as a search or as the source of the new one,
goes on reading it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.kernels import MOST_LISTED_CELLS

#: Rows of a file at most. A file holds parts of few cells, a large cell lies in several files.
ROWS_PER_FILE = 1 << 17


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _folder(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    return sorted(int(n) for n in _names(spark, f"{path}/versions") if n.isdigit() and "_SUCCESS" in _names(spark, f"{path}/versions/{n}/manifest"))


@dataclass(frozen=True)
class Stored:
    """One version of an index on storage."""

    spark: SparkSession
    path: str
    version: int

    @property
    def folder(self) -> str:
        return f"{self.path}/versions/{self.version:08d}"

    @cached_property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    @cached_property
    def settings(self) -> dict:
        return self.spark.read.parquet(f"{self.folder}/settings").first().asDict()

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/centroids")

    @property
    def codebook(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/codebook")

    @cached_property
    def size(self) -> int:
        """Vectors, from the manifest."""
        return self.manifest.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def radii(self, cells: int) -> np.ndarray:
        """The largest angle of each cell's vectors to its centroid, -1 for an empty cell; from the manifest."""
        out = np.full(cells, -1.0)
        for row in self.manifest.groupBy("cell").agg(F.max("radius")).collect():  # one row per cell
            out[row[0]] = row[1]
        return out

    def files(self, cells: Iterable[int] | None = None) -> list[str]:
        """The files that hold any of the cells, of all cells without an argument."""
        rows = self.manifest if cells is None else self.manifest.where(F.col("cell").isin(list(cells)))
        return [f"{self.path}/{r['file']}" for r in rows.select("file").distinct().orderBy("file").collect()]

    def cells(self, cells: Iterable[int] | None = None) -> DataFrame:
        """The vectors of the cells, read from their files only; of all cells without an argument, or with too many to list."""
        cells = None if cells is None else sorted(set(cells))
        some = cells if cells is not None and len(cells) <= MOST_LISTED_CELLS else None
        schema = self.settings["schema"]
        files = self.files(some)
        if not files:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*files)
        return rows if some is None else rows.where(F.col("cell").isin(some))


def store(path: str, fresh: DataFrame | None, centroids: DataFrame, codebook: DataFrame | None, settings: dict, before: Stored | None = None, rows_per_file: int = ROWS_PER_FILE) -> Stored:
    """Write a new version: the files of ``before`` (a version at the same path) and those of the ``fresh`` vectors.

    ``fresh`` has vec_id, embedding, cell, angle and perhaps codes. Vectors are
    shuffled by cell; where a cell outgrows a task, adaptive execution splits
    it. Only the cells and angles are read again, for the manifest.
    """
    spark = centroids.sparkSession
    taken = [int(n) for n in _names(spark, f"{path}/versions") if n.isdigit()]
    out = Stored(spark, path, max(taken, default=0) + 1)
    manifest = before.manifest if before is not None else None
    schema = before.settings["schema"] if before is not None else None
    if fresh is not None:
        name = f"data/{uuid.uuid4().hex}"
        sorted_ = fresh.hint("rebalance", "cell").sortWithinPartitions("cell")
        sorted_.write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(f"{path}/{name}")
        schema = schema or ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema)
        parts = spark.read.schema(schema).parquet(f"{path}/{name}").select(F.concat(F.lit(f"{name}/"), F.col("_metadata.file_name")).alias("file"), "cell", "angle")
        parts = parts.groupBy("file", "cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
        manifest = parts if manifest is None else manifest.unionByName(parts)
    if manifest is None:
        raise ValueError("there is nothing to store")
    spark.createDataFrame([settings | {"schema": schema}]).coalesce(1).write.mode("errorifexists").parquet(f"{out.folder}/settings")
    centroids.write.mode("errorifexists").parquet(f"{out.folder}/centroids")
    if codebook is not None:
        codebook.write.mode("errorifexists").parquet(f"{out.folder}/codebook")
    manifest.write.mode("errorifexists").parquet(f"{out.folder}/manifest")
    return out
