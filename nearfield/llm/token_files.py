"""Token ids in bit-packed shard files.

Format of a shard, all numbers little-endian:

- header of 64 bytes: magic ``NFTOKEN1``, then unsigned 64-bit: bits per id,
  ids per block, ids, documents, byte position of the block offsets, of the
  document ids, of the document starts;
- blocks: each holds ``ids per block`` ids (the last one fewer) of ``bits``
  bits each, the first id in the lowest bits, filled up to whole bytes;
- block offsets: signed 64-bit byte positions, one more than blocks;
- document ids: signed 64-bit, then one byte each, 1 where the id is null;
- document starts: signed 64-bit, one more than documents.

A reader finds id ``i`` in block ``i // ids per block`` without reading others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.common import own, scratch, table, written
from nearfield.llm.packing import ROWS
from nearfield.llm.tokenization import default_vocabulary, encoder_of

MAGIC = b"NFTOKEN1"
HEADER = struct.Struct("<8s7Q")
BLOCK_IDS = 8192
#: Ids of a shard, after which a task begins another: 128 MiB at 16 bits.
SHARD_IDS = 1 << 26
END_ID = 2


def bits_for(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing of one block."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    single = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(single.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from position ``first`` of a block, without a loop over ids."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    at = (np.arange(first, first + count, dtype=np.int64)) * bits
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    byte, value = at >> 3, np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (value >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype("<u4")


class ShardWriter:
    """Writes one shard as a stream; holds less than one block and the document index."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at, self.ids, self.pending, self.waiting = HEADER.size, 0, [], 0
        self.offsets, self.docs, self.nulls, self.starts = [HEADER.size], [], [], [0]
        out.write(HEADER.pack(MAGIC, *[0] * 7))

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id doesn't fit {self.bits} bits")
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            joined = np.concatenate(self.pending)
            full = len(joined) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(joined[k : k + self.block_ids])
            self.pending, self.waiting = [joined[full:]], len(joined) - full

    def close(self) -> bytes:
        """Write what is left; returns the header, which belongs at the start."""
        if self.waiting:
            self._block(np.concatenate(self.pending))
        tables = [np.array(x, "<i8").tobytes() for x in (self.offsets, self.docs)] + [np.array(self.nulls, np.uint8).tobytes(), np.array(self.starts, "<i8").tobytes()]
        at_offsets = self.at
        at_docs = at_offsets + len(tables[0])
        at_starts = at_docs + len(tables[1]) + len(tables[2])
        for data in tables:
            self.out.write(data)
        footer = HEADER.pack(MAGIC, self.bits, self.block_ids, self.ids, len(self.docs), at_offsets, at_docs, at_starts)
        self.out.write(footer)
        return footer


class ShardReader:
    """Random access to one shard; the header is repeated as the last 64 bytes."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block_ids, self.ids, self.n_docs, offsets, docs, starts = HEADER.unpack(source.read_at(HEADER.size, size - HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        tail = source.read_at(size - HEADER.size - offsets, offsets)
        blocks = -(-self.ids // self.block_ids)
        self.offsets = np.frombuffer(tail, "<i8", blocks + 1)
        self.docs = np.frombuffer(tail, "<i8", self.n_docs, docs - offsets)
        self.nulls = np.frombuffer(tail, np.uint8, self.n_docs, docs - offsets + 8 * self.n_docs)
        self.starts = np.frombuffer(tail, "<i8", self.n_docs + 1, starts - offsets)

    def block(self, k: int) -> np.ndarray:
        data = self.source.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        return unpack_bits(data, self.bits, min(self.block_ids, self.ids - k * self.block_ids))

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; reads only the blocks it lies in."""
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        if a == b:
            return np.zeros(0, "<u4")
        low, high = a // self.block_ids, (b - 1) // self.block_ids
        joined = np.concatenate([self.block(x) for x in range(low, high + 1)])
        return joined[a - low * self.block_ids : b - low * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document in order, with its start; each block is read once."""
        held_from, held = 0, np.zeros(0, "<u4")
        block = 0
        for k in range(self.n_docs):
            a, b = int(self.starts[k]), int(self.starts[k + 1])
            if b > held_from + len(held):
                more = [held[a - held_from :]]
                held_from = a
                while held_from + sum(map(len, more)) < b:
                    more.append(self.block(block))
                    block += 1
                held = np.concatenate(more)
            yield None if self.nulls[k] else int(self.docs[k]), a, held[a - held_from : b - held_from]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder that Spark may name by another scheme, and the path in it."""
    for spark_scheme in ("s3a://", "s3n://"):
        if uri.startswith(spark_scheme):
            uri = "s3://" + uri[len(spark_scheme) :]
    return pafs.FileSystem.from_uri(uri)


def write_tokens(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encode every document and write shards in ascending id order.

    Returns the manifest: shard (ascending like the ids in it), path, n_docs,
    n_tokens. Null ids come first, a null text is the end id alone, equal ids
    stand in the order of their texts; an empty table gives an empty manifest.

    As many tasks write as a shuffle has partitions. A task begins another shard
    after ``shard_ids`` ids, so files and what a task holds for one stay of a size
    however large the input is; a document lies in one shard, whatever its length.
    Each attempt of a task writes files of its own, and the manifest names those
    of the attempt that Spark took; nothing is renamed or deleted, and what a lost
    attempt has left is never read. Columns other than the two named are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    folder = path or scratch(spark, "tokens")
    model = vocabulary or default_vocabulary()
    rows = own(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = file_system(folder)
        encoder, writer, out, name = None, None, None, None
        shards_done = 0

        def closed() -> pa.RecordBatch:
            """The finished shard's row of the manifest."""
            nonlocal writer, shards_done
            writer.close()
            out.close()
            row = {"shard": [(context.partitionId() << 24) + shards_done], "path": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.ids]}
            writer, shards_done = None, shards_done + 1
            return pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c == "path" else pa.int64()) for c, v in row.items()})

        for batch in batches:
            if not len(batch):
                continue
            if encoder is None:
                fs.create_dir(root, recursive=True)
                encoder = encoder_of(model)
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                    if writer is None:
                        name = f"{root}/shard-{context.partitionId():06d}-{shards_done:06d}-{context.taskAttemptId()}.bin"
                        out = fs.open_output_stream(name)
                        writer = ShardWriter(out, bits_for(encoder.tokenizer.get_vocab_size()), block_ids)
                    writer.add(doc, np.append(ids, np.uint32(end_id)))
                    if writer.ids >= shard_ids:
                        yield closed()
        if writer is not None:
            yield closed()

    return written(rows.mapInArrow(each, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(manifest: DataFrame, folder_uri: str | None = None) -> DataFrame:
    """Read the shards of a manifest; one row per document.

    Columns: doc_id, start (ids of all documents before it, over all shards),
    n_tokens, ids (binary, little-endian unsigned 32-bit). The sum over shards
    is the only step in one task: a row per shard. Shards are read in parallel.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    scheme = folder_uri or scratch(manifest.sparkSession, "any")
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(scheme)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(path) as source:
                    docs, starts, ids, held = [], [], [], 0
                    for doc, start, some in ShardReader(source).documents():
                        docs.append(doc)
                        starts.append(base + start)
                        ids.append(some.tobytes())
                        held += 4 * len(some)
                        if held > 8 << 20:
                            yield _read_batch(docs, starts, ids)
                            docs, starts, ids, held = [], [], [], 0
                    yield _read_batch(docs, starts, ids)

    return based.select("path", "base").repartition(tasks, "path").mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")


def _read_batch(docs: list, starts: list, ids: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])


def crc32_of(ids: np.ndarray) -> int:
    """The checksum by which ids are compared."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as shards and read them back."""
    manifest = write_tokens(table(spark, sf_dir, "documents"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
