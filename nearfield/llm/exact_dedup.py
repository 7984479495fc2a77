"""Exact deduplication by a log-structured merge index of digests.

1. The log: id, length and digest of every document's normalised text.
2. Each task feeds its part of the log into a memtable; full ones are flushed
   as runs sorted by digest (Parquet).
3. Compaction deals the runs out by ranges of digests and merges what falls into
   a range in one pass over its order: per digest the row that stays and the
   count. Runs are aggregated already, so a digest has at most a row per memtable.
   The index keeps the hits, digests that more than one row has, again as
   sorted runs, one to a range, each with its first and last digest and a filter.
4. Documents look their digest up: the ranges name the one run that can have
   it, the run's filter rules out most that aren't there. Only documents that
   pass meet the index in a join, and only their texts are moved.
5. Those texts are grouped by digest and whole text: equal bytes, not equal
   digests, make a group. A digest that turns out to stand for several texts is
   resolved by the texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import WHITE, discard, own, sized, staying, table, written

_DROP = WHITE.encode()
#: Bits of filters per digest and at most in all, and hash functions. Beyond the most, more texts pass; results are the same.
BITS_PER_DIGEST, MOST_BITS, FILTER_HASHES = 12, 1 << 29, 4
#: Runs of the index at most.
MOST_RUNS = 4096


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


class DigestFilter:
    """A Bloom filter over digests that are themselves uniformly distributed."""

    def __init__(self, bits: int = 1 << 20, hashes: int = FILTER_HASHES, data: bytes | None = None):
        self.bits, self.hashes = 8 * len(data) if data else bits, hashes
        self.data = np.frombuffer(data, np.uint8).copy() if data else np.zeros(bits // 8, np.uint8)

    def _places(self, digests: list[bytes]) -> np.ndarray:
        words = np.frombuffer(b"".join(hashlib.blake2b(d, digest_size=8 * self.hashes).digest() for d in digests), "<u8")
        return (words % np.uint64(self.bits)).astype(np.int64).reshape(-1, self.hashes)

    def add(self, digests: list[bytes]) -> None:
        at = self._places(digests).ravel()
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def might_contain(self, digests: list[bytes]) -> np.ndarray:
        at = self._places(digests)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _flushes(rows_of: Iterator[pa.RecordBatch], memtable_rows: int) -> Iterator[pa.RecordBatch]:
    """Memtables of one task, each flushed as a run sorted by digest."""
    table_: dict[bytes, list] = {}
    runs = 0

    def flush() -> pa.RecordBatch:
        nonlocal runs
        rows = sorted(table_.items())
        table_.clear()
        runs += 1
        run = (TaskContext.get().partitionId() << 33) + runs
        cols = list(zip(*((d, *v) for d, v in rows))) or [[]] * 4
        arrays = [pa.array([run] * len(rows), pa.int64()), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])]
        return pa.RecordBatch.from_arrays(arrays, names=["run", "digest", "n", "best_chars", "keep_id"])

    for batch in rows_of:
        for digest, chars, doc in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_chars", "doc_id"))):
            held = table_.get(digest)
            if held is None:
                table_[digest] = [1, chars, doc]
                if len(table_) >= memtable_rows:
                    yield flush()
            else:
                held[0] += 1
                if _precedes(chars, doc, held[1], held[2]):
                    held[1:] = chars, doc
    if table_:
        yield flush()


def _merged(runs: DataFrame, *keys: str) -> DataFrame:
    """Per key the row with the most characters, then the smallest id (null last)."""
    order = F.min(F.struct((-F.col("best_chars")).alias("less"), F.col("keep_id").isNull().alias("void"), F.col("keep_id").alias("id")))
    return runs.groupBy(*keys).agg(F.sum("n").alias("n"), order.alias("best")).select(*keys, "n", (-F.col("best.less")).alias("best_chars"), F.col("best.id").alias("keep_id"))


def _precedes(chars: int, doc: int | None, other_chars: int, other: int | None) -> bool:
    """Whether a row stays rather than another: more characters, then the smaller id, null last."""
    return chars > other_chars or chars == other_chars and doc is not None and (other is None or doc < other)


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits among rows in order of their digest, as one sorted run; a digest may go on in the next batch."""
    run = TaskContext.get().partitionId()
    held: list | None = None  # digest, n, best_chars, keep_id

    def out(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 4
        arrays = [pa.array([run] * len(rows), pa.int64()), pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])]
        return pa.RecordBatch.from_arrays(arrays, names=["run", "digest", "n", "best_chars", "keep_id"])

    for batch in batches:
        hits = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "best_chars", "keep_id"))):
            if held is not None and row[0] == held[0]:
                held[1] += row[1]
                if _precedes(row[2], row[3], held[2], held[3]):
                    held[2:] = row[2:]
                continue
            if held is not None and held[1] > 1:
                hits.append(held)
            held = list(row)
        yield out(hits)
    if held is not None and held[1] > 1:
        yield out([held])


def _compaction(runs: DataFrame) -> DataFrame:
    """All runs merged: run, digest, n, best_chars and keep_id of every hit."""
    parts = min(MOST_RUNS, sized(runs.count()))
    ordered = runs.select("digest", "n", "best_chars", "keep_id").repartitionByRange(parts, "digest").sortWithinPartitions("digest")
    return ordered.mapInArrow(_compacted, "run long, digest binary, n long, best_chars long, keep_id long")


class Lookup:
    """First and last digest and the filter of each run of an index, in order."""

    def __init__(self, runs: list[tuple[bytes, bytes, DigestFilter]]):
        self.first, self.last, self.filters = [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs]

    def might_contain(self, digests: list[bytes]) -> np.ndarray:
        """Whether the only run whose range a digest is in may have it."""
        out = np.zeros(len(digests), bool)
        runs: dict[int, list[int]] = {}
        for k, digest in enumerate(digests):
            run = bisect_left(self.last, digest)
            if run < len(self.last) and digest >= self.first[run]:
                runs.setdefault(run, []).append(k)
        for run, places in runs.items():
            out[places] = self.filters[run].might_contain([digests[k] for k in places])
        return out


def _lookup(index: DataFrame) -> Lookup:
    """What documents need to look digests up: one row a run, at most MOST_RUNS, and at most MOST_BITS of filters or 4,096 a run."""
    runs = index.groupBy("run").agg(F.min("digest").alias("first"), F.max("digest").alias("last"), F.count("*").alias("n")).collect()
    each = min(BITS_PER_DIGEST, MOST_BITS / max(1, 2 * sum(r["n"] for r in runs)))
    bits = {r["run"]: max(1 << 12, 1 << int(each * r["n"]).bit_length()) for r in runs}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("run").to_numpy()
            for run in np.unique(of).tolist():
                found = DigestFilter(bits[run])
                found.add([d.as_py() for d in batch.column("digest").filter(pa.array(of == run))])
                held = found.data.view("<i8")
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), run), pa.int64()), pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["run", "at", "word"])

    filters = {run: DigestFilter(b) for run, b in bits.items()}
    rows = index.select("run", "digest").mapInArrow(words, "run long, at long, word long").groupBy("run", "at").agg(F.bit_or("word").alias("word")).toArrow()
    of, at, word = (rows.column(c).to_numpy() for c in ("run", "at", "word"))
    order = np.argsort(of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(part):
            filters[int(of[part[0]])].data.view("<i8")[at[part]] = word[part]
    return Lookup(sorted(((bytes(r["first"]), bytes(r["last"]), filters[r["run"]]) for r in runs), key=lambda x: x[0]))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 100_000, digest_bits: int = 256
) -> DataFrame:
    """Group documents whose texts are equal but for white space.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    ``n_chars`` and ``key``, a hash of id and text. Other columns are ignored,
    whatever their names; texts of any length are compared whole. Of a group the row with the most code points stays, then the
    smallest id. Null texts are empty ones; a null id comes after all others
    and, if its row stays, keep_id is null; rows that repeat an id and a text
    are all marked alike. An empty table gives an empty result.

    A smaller ``digest_bits`` makes digests collide, to test what follows then.
    """
    rows = own(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sha = F.sha2(normalised(F.col("text")), 256)
    digest = F.unhex(F.substring(sha, 1, digest_bits // 4))
    log = written(rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), digest.alias("digest"), sha.alias("text_sha256"), F.xxhash64("doc_id", "text").alias("key")), "dedup-log")
    runs = written(log.select("digest", "n_chars", "doc_id").mapInArrow(lambda b: _flushes(b, memtable_rows), "run long, digest binary, n long, best_chars long, keep_id long"), "dedup-runs")
    hits = written(_compaction(runs), "dedup-index")
    discard(runs)
    known = docs.sparkSession.sparkContext.broadcast(_lookup(hits))
    size = digest_bits // 8

    def looked_up(found: bool):
        """The rows of the log whose digest may be in the index, or the others."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield batch.filter(pa.array(known.value.might_contain(batch.column("digest").to_pylist()) == found))

        return log.mapInArrow(each, log.schema)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").translate(None, _DROP) for t in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(t).digest()[:size] for t in texts]
            some = np.flatnonzero(known.value.might_contain(digests)).tolist()
            for a in range(0, len(some), 500):
                part = some[a : a + 500]
                yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in part], pa.binary()), pa.array([texts[k] for k in part], pa.binary())], names=["digest", "body"])

    bodies = rows.select("text").mapInArrow(passing, "digest binary, body binary")
    checked = bodies.groupBy("digest", "body").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
    clashes = written(checked.where("texts > 1").select("digest"), "dedup-clashes")

    sound = hits.join(clashes, "digest", "left_anti").drop("run")
    alone = looked_up(False).select("*", *(F.lit(None).cast("long").alias(c) for c in ("group_n", "best_chars", "keep_id")))
    out = looked_up(True).join(sound.withColumnRenamed("n", "group_n"), "digest", "left").unionByName(alone)
    if not clashes.isEmpty():
        # By whole texts for the few digests that several texts have.
        bodied = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text"), digest.alias("digest"), F.encode(normalised(F.col("text")), "utf-8").alias("body"))
        bodied = bodied.join(clashes, "digest", "left_semi").select("*", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
        exact = _merged(bodied.select("digest", "body", F.lit(1).cast("long").alias("n"), F.col("n_chars").alias("best_chars"), F.col("doc_id").alias("keep_id")), "digest", "body")
        resolved = bodied.join(exact.withColumnRenamed("n", "group_n"), ["digest", "body"], "left")
        keep = ["doc_id", "key", "n_chars", "text_sha256", "group_n", "best_chars", "keep_id"]
        out = out.join(clashes, "digest", "left_anti").select(*keep).unionByName(resolved.withColumn("text_sha256", F.sha2("body", 256)).select(*keep))
    alone = F.col("group_n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars")))).alias("kept"),
        "text_sha256",
        "n_chars",
        "key",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: one row of each group, with all their columns.

    Rows that repeat an id and a text are one document. Digests and ids are
    shuffled, and texts that other rows have too; all others stay in place.
    """
    found = exact_groups(docs, id_col, text_col).select("key", F.col("kept").alias("stays"))
    return staying(docs, F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), found, [id_col, text_col])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, row that stays and digest for every document."""
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
