"""Harmonic packing of tokenized documents into fixed-length sequences.

A piece of ``n`` ids belongs to class ``capacity // n``: so many pieces of the
class fill one sequence. Each worker fills its classes' open sequences by
count alone, without looking at other workers. A document is first cut into
whole sequences; of the rest, a piece is cut down to the next smaller
reciprocal of the capacity wherever its class would otherwise leave more than
``slack`` of a sequence empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import own, table
from nearfield.llm.tokenization import default_vocabulary, encoder_of

CAPACITY = 2048
END_ID = 1
#: Documents that a worker tokenizes at a time.
ROWS = 2_500


def cut_lengths(total: int, capacity: int, slack: float = 0.02) -> list[int]:
    """Lengths of the pieces that a document of ``total`` ids is cut into."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        count = capacity // rest
        piece = rest if rest * count >= (1 - slack) * capacity else capacity // (count + 1)
        out.append(piece)
        rest -= piece
    return out


def powers_of_two(n: int) -> list[int]:
    """The powers of two that sum up to ``n``, largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class HarmonicBins:
    """The open sequences of one worker. A piece is (document row, start, ids, ids in the document)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple] | None:
        """Put a piece into its class's open sequence; return the sequence if that fills it."""
        count = self.capacity // len(piece[2])
        if count == 1:
            return [piece]
        bin_ = self.open.setdefault(count, [])
        bin_.append(piece)
        return self.open.pop(count) if len(bin_) == count else None

    def close(self) -> Iterator[list[tuple]]:
        """What stayed open, cut anew: full sequences, then powers of two, so nothing is padded."""
        left = [piece for count in sorted(self.open) for piece in self.open[count]]
        total = sum(len(piece[2]) for piece in left)
        sizes = [self.capacity] * (total // self.capacity) + powers_of_two(total % self.capacity)
        left.reverse()
        for size in sizes:
            out = []
            while size:
                doc, start, ids, whole = left.pop()
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:], whole))
                    ids = ids[:size]
                out.append((doc, start, ids, whole))
                size -= len(ids)
            yield out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    slack: float = 0.02,
) -> DataFrame:
    """Tokenize and pack every document; one row per piece.

    Columns: doc_id, start (ids of the document before the piece), length, ids
    (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    A null or empty text is the end id alone; null ids stay null; repeated
    rows are packed as often as they come; an empty table gives no rows.

    Nothing is shuffled. A task holds one Arrow batch and, per class, less than
    one sequence. Sequence ids are made of the partition's number and a count,
    so a task that is run again gives the same ones.
    """
    rows = own(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    path = vocabulary or default_vocabulary()
    arrow_kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = encoder_of(path), HarmonicBins(capacity)
        made = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        kept_kind = None

        def put(pieces: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, whole in pieces:
                out.append((doc, start, len(ids), ids.tobytes(), whole, made, at))
                at += len(ids)
            made += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [kept_kind, *arrow_kinds])], names=names)

        for batch in batches:
            kept_kind = batch.column("doc_id").type
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                    ids, start = np.append(ids, np.uint32(end_id)), 0
                    for length in cut_lengths(len(ids), capacity, slack):
                        if full := bins.add((doc, start, ids[start : start + length].copy(), len(ids))):
                            put(full)
                        start += length
                    if len(out) >= 4_000:
                        yield batch_of()
        if kept_kind is not None:
            for pieces in bins.close():
                put(pieces)
            yield batch_of()

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(each, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with the checksum of its ids."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
