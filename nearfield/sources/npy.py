"""``.npy`` matrices as a Spark data source, to read and to write.

``spark.read.format("npy").load(path)`` reads a file, of which only the header
is read for the plan, or a folder that was written by this source; tasks read
ranges of rows. ``df.write.format("npy").save(path)`` writes a folder: tasks write files
of up to ``part_bytes``, each a matrix of its own, and the commit names them in
their order in one index file. Files of attempts that failed are in no index
and so are never read.
"""

from __future__ import annotations

import ast
import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a file that one task reads, and of a file that is written.
PART_BYTES = 32 << 20
INDEX = "_index.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def header(source) -> tuple[np.dtype, tuple[int, int], int]:
    """Type, shape and the place of the first element of a two-dimensional row-major file."""
    start = source.read_at(12, 0)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    size, at = (struct.unpack("<H", start[8:10])[0], 10) if start[6] == 1 else (struct.unpack("<I", start[8:12])[0], 12)
    said = ast.literal_eval(source.read_at(size, at).decode("latin1"))
    if len(said["shape"]) != 2:
        raise ValueError("the array must have two dimensions")
    if said["fortran_order"]:
        raise ValueError("the array must be stored by rows")
    return np.dtype(said["descr"]), said["shape"], at + size


def _index(fs: pafs.FileSystem, folder: str) -> list[dict]:
    """file and rows of every part, in order."""
    with fs.open_input_file(f"{folder}/{INDEX}") as source:
        return json.loads(source.read().decode())["parts"]


@dataclass
class Rows(InputPartition):
    """Rows ``first`` and following of a file, the first of which is row ``number`` of the whole."""

    file: str
    first: int
    count: int
    number: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Rows]:
        fs, path = _open(self.path)
        files = [path]
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            files = [f"{path}/{p['file']}" for p in _index(fs, path)]
        found, number = [], 0
        for file in files:
            with fs.open_input_file(file) as source:
                dtype, (rows, dim), _ = header(source)
            each = max(1, self.part_bytes // max(1, dtype.itemsize * dim))
            found += [Rows(file, a, min(each, rows - a), number + a) for a in range(0, rows, each)]
            number += rows
        return found or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.file) as source:
            dtype, (_, dim), start = header(source)
            width = dtype.itemsize * dim
            step = max(1, min(partition.count, 8192))
            for a in range(0, partition.count, step):
                n = min(step, partition.count - a)
                x = np.frombuffer(source.read_at(n * width, start + (partition.first + a) * width), dtype).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.number + a, partition.number + a + n)), vectors], names=["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    """What a task has written, in order: (file, rows)."""

    partition: int
    parts: list[tuple[str, int]]


class NpyWriter(DataSourceArrowWriter):
    """Writes the column embedding; a row's place is its number, so sort before."""

    def __init__(self, path: str, dtype: str, part_bytes: int, overwrite: bool, column: str):
        self.path, self.dtype, self.part_bytes, self.overwrite, self.column = path, np.dtype(dtype), part_bytes, overwrite, column

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        out = Written(TaskContext.get().partitionId(), [])
        attempt = uuid.uuid4().hex
        held: list[np.ndarray] = []

        def flush(least: int) -> None:
            """Write what is held, in files of ``least`` rows; fewer rows stay, if there is a least."""
            x = np.concatenate(held)
            held.clear()
            while len(x) >= max(1, least):
                part, x = (x[:least], x[least:]) if least else (x, x[:0])
                file = io.BytesIO()
                np.save(file, part)
                name = f"part-{out.partition:06d}-{len(out.parts):06d}-{attempt}.npy"
                with fs.open_output_stream(f"{folder}/{name}") as sink:
                    sink.write(file.getbuffer())
                out.parts.append((name, len(part)))
            if len(x):
                held.append(x)

        for batch in iterator:
            vectors = batch.column(self.column)
            if not len(vectors):
                continue
            sizes = set(vectors.value_lengths().to_pylist())
            if vectors.null_count or len(sizes) != 1 or vectors.flatten().null_count:
                raise ValueError("every row must have a vector of the same width, without nulls")
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(len(vectors), -1)
            if held and held[0].shape[1] != x.shape[1]:
                raise ValueError("every row must have a vector of the same width, without nulls")
            held.append(x)
            if sum(h.nbytes for h in held) >= self.part_bytes:
                flush(max(1, self.part_bytes // (x.itemsize * max(1, x.shape[1]))))
        if held:
            flush(0)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        kept = []
        if not self.overwrite and fs.get_file_info(f"{folder}/{INDEX}").type == pafs.FileType.File:
            kept = _index(fs, folder)
        parts = [{"file": file, "rows": rows} for m in sorted(filter(None, messages), key=lambda m: m.partition) for file, rows in m.parts]
        fresh = f"{folder}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as sink:
            sink.write(json.dumps({"parts": kept + parts}).encode())
        fs.move(fresh, f"{folder}/{INDEX}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _open(self.path)
        for m in filter(None, messages):
            for file, _ in m.parts:
                fs.delete_file(f"{folder}/{file}")


class NpyDataSource(DataSource):
    """Rows of a matrix with their number as vec_id; options ``part_bytes`` and, to write, ``dtype``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], self.options.get("dtype", "float32"), int(self.options.get("part_bytes", PART_BYTES)), overwrite, "embedding")


def read_npy(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Register the source, if need be, and read ``path``."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").options(**options).load(path)


def write_npy(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", mode: str = "append", **options: str) -> None:
    """Write vectors in the order of their ids, so that a row's number among all is its place in that order."""
    spark = vectors.sparkSession
    spark.dataSource.register(NpyDataSource)
    rows = vectors.orderBy(id_col).selectExpr(f"`{id_col}` as vec_id", f"`{vector_col}` as embedding")
    rows.write.format("npy").mode(mode).options(**options).save(path)
