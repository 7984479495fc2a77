"""Near-duplicate documents by Order MinHash.

A sketch takes the two k-mers (five words, labelled with how often the same
k-mer came before) with the least hash values and keeps them in the order of
the text, so two texts share a sketch more often the smaller their edit
distance is (Marçais et al. 2019). Documents that share a sketch are
candidates; a banded alignment of their words decides.

Equal word sequences are one node from the start. In each bucket the nodes are
compared with the bucket's least one, then those in another class than it with
the least of them. After that every node that is in another class than its
bucket's least one is compared with all nodes of other classes in the bucket,
so a link between two documents that share a sketch is never lost.

A text of a few dozen words has too few k-mers left after its edits to share a
sketch surely. Short texts are also put into buckets of pairs of words, the
rarest first and so many that no link is lost ("prefix"): each edit takes away
two pairs at most, so near texts have a known number of pairs in common.

Lengths and
counts of words, which bound the edit distance from below, spare most of these
alignments, the first of them inside Spark's join.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.alignment import similar
from nearfield.llm.common import SHINGLE_WORDS, SIMILARITY, discard, held, keyed, own, sized, staying, table, written
from nearfield.llm.components import components

#: So many that nine of ten pairs at the edit threshold share one.
SKETCHES = 72
#: Rounds of leaders before all that are left are compared; the result doesn't depend on it.
ROUNDS = 2
#: Counters of words in a profile of up to so many words, and of longer ones; kept compressed. 64-bit numbers of its bitmap, which holds a third as many counters, up to 3 in unary.
_FINE, _FINE_WORDS, _PROFILE, _BITMAP, _UNARY = 2048, 1024, 256, 32, 3
#: Rows of a bucket that a stray node meets in one task.
_BLOCK = 4000
#: Texts of so many words, and longer ones near to these, lose no link. Counters of pairs of words: at least, at most, and pairs for each.
SHORT_WORDS, _LEAST_COUNTERS, _MOST_COUNTERS, _PAIRS_PER_COUNTER = 50, 1 << 16, 1 << 22, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MOST_KNOWN = 250_000
#: Bytes of text that are taken at a time, and k-mers that are sketched at a time.
_TEXT_BYTES, _KMERS = 2 << 20, 1 << 16
#: Low bits of a hash value that carry the place of its k-mer; longer texts take more.
_PLACE_BITS = 24


def word_hashes(texts: list[str | None], known: dict[bytes, bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Digest and word hashes of each text; letter case doesn't count."""
    out = []
    for text in texts:
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        try:
            joined = b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > _MOST_KNOWN:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh32_digest(w)[::-1]
            joined = b"".join(map(known.__getitem__, words))
        out.append((xxhash.xxh3_128_digest(b" ".join(words)), np.frombuffer(joined, "<u4")))
    return out


def _kmers(words: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled k-mers of all texts, one after the other, and where each text's begin.

    Texts under ``k`` words have one k-mer; none may be empty.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    padded = np.concatenate([*words, np.zeros(k, np.uint32)]).astype(np.uint64)
    total = int(sizes.sum())
    end = np.repeat(starts + sizes, sizes)
    place = np.arange(total)
    kmers = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            mixed = (kmers ^ padded[j : j + total]) * _MIX
            mixed ^= mixed >> np.uint64(29)
            kmers = np.where(place + j < end, mixed, kmers)
        counts = np.maximum(1, sizes - k + 1)
        firsts = np.cumsum(counts) - counts
        kmers = kmers[np.repeat(starts - firsts, counts) + np.arange(int(counts.sum()))]
        # Label by occurrence those k-mers that their text has several times.
        of = np.repeat(np.arange(len(words), dtype=np.uint64), counts)
        named = kmers ^ of * np.uint64(0xC2B2AE3D27D4EB4F)
        ordered = np.sort(named)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            flags = np.zeros(1 << 18, bool)
            flags[(twice >> np.uint64(40)) & np.uint64((1 << 18) - 1)] = True
            some = np.flatnonzero(flags[(named >> np.uint64(40)) & np.uint64((1 << 18) - 1)])
            order = some[np.argsort(named[some], kind="stable")]
            new = np.concatenate([[True], named[order][1:] != named[order][:-1]])
            runs = np.flatnonzero(new)
            rank = np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))
            kmers[order] += rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        kmers *= _MIX
        kmers ^= kmers >> np.uint64(32)
    return kmers, firsts


def sketches(words: list[np.ndarray], multipliers: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of sketches for each text, of which none may be empty."""
    out = np.zeros((len(words), len(multipliers)), np.uint64)
    a = 0
    while a < len(words):
        b, held = a, 0
        while b < len(words) and (b == a or held + len(words[b]) <= _KMERS):
            held += len(words[b])
            b += 1
        kmers, firsts = _kmers(words[a:b], k)
        counts = np.diff(np.append(firsts, len(kmers)))
        bits = max(_PLACE_BITS, int(counts.max()).bit_length())
        mask = np.uint64((1 << bits) - 1)
        place = (np.arange(len(kmers)) - np.repeat(firsts, counts)).astype(np.uint64)
        high, single = kmers & ~mask, counts == 1
        most = np.uint64(0xFFFFFFFFFFFFFFFF)
        with np.errstate(over="ignore"):
            for s, m in enumerate(multipliers):
                values = high * m  # its low bits stay empty
                values += place
                one = (np.minimum.reduceat(values, firsts) & mask).astype(np.int64) + firsts
                values[one] = most
                two = np.where(single, one, (np.minimum.reduceat(values, firsts) & mask).astype(np.int64) + firsts)
                early, late = kmers[np.minimum(one, two)], kmers[np.maximum(one, two)]
                keys = (early * _MIX ^ late) * m
                out[a:b, s] = keys ^ (keys >> np.uint64(31))
        a = b
    return out.view(np.int64)


def _signatures(docs: DataFrame, count: int, seed: int) -> DataFrame:
    """A number for each row, its key and doc_id, digest of the words, their hashes and the sketches."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    multipliers = np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = held("near words", dict)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _TEXT_BYTES, side="right")))
                part = batch.slice(a, b - a)
                found = word_hashes(part.column("text").to_pylist(), known)
                sizes = np.array([count if len(w) else 0 for _, w in found])
                keys = sketches([w for _, w in found if len(w)], multipliers)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.ravel()))
                digests, words = pa.array([d for d, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())
                arrays = [pa.array(np.arange(row, row + len(part))), part.column("key"), part.column("doc_id"), digests, words, lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "key", "doc_id", "digest", "words", "sketches"])
                row += len(part)
                a = b

    return docs.mapInArrow(each, f"row long, key long, doc_id {kind}, digest binary, words binary, sketches array<long>")


def _prefix_sizes(least: float) -> np.ndarray:
    """How many pairs of words a text of n words takes, for n up to the longest text near to a short one.

    Texts whose longer one has L words and that are ``e`` edits apart have
    L - 1 - 2 e pairs in common, so of any order of all pairs both have one of
    these among the first n - 1 - (L - 1 - 2 e) + 1. L is at least n, and at most n / least.
    """
    longest = int(SHORT_WORDS / least + 1e-9)
    out = np.zeros(longest + 1, np.int64)
    for n in range(1, longest + 1):
        longer = np.arange(n, int(n / least + 1e-9) + 1)
        common = np.maximum(1, longer - 1 - 2 * np.floor(longer * (1 - least) + 1e-9).astype(np.int64))
        out[n] = max(1, n - int(common.min()))
    return out


def prefix_keys(words: list[np.ndarray], sizes: np.ndarray, counters: np.ndarray) -> list[np.ndarray]:
    """The pairs of words under which each short text is looked for: the rarest by ``counters``, then the least hashes."""
    pairs, firsts = _kmers(words, 2)
    of = np.repeat(np.arange(len(words)), np.diff(np.append(firsts, len(pairs))))
    order = np.lexsort((pairs, counters[(pairs % np.uint64(len(counters))).astype(np.int64)], of))
    keys = (pairs[order] ^ np.uint64(0xA0761D6478BD642F)).view(np.int64)
    return [keys[a : a + sizes[len(w)]] for a, w in zip(firsts.tolist(), words)]


def _short_buckets(texts: DataFrame, least: float) -> DataFrame:
    """node and bucket for texts (node, words) short enough. How rare a pair is comes from counters over all of them."""
    sizes = _prefix_sizes(least)
    texts = texts.where(F.length("words").between(4, 4 * (len(sizes) - 1)))
    held_pairs = texts.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0] // 4
    many = min(_MOST_COUNTERS, max(_LEAST_COUNTERS, 1 << (held_pairs // _PAIRS_PER_COUNTER).bit_length()))
    split = lambda batch: [np.frombuffer(w, "<u4") for w in batch.column("words").to_pylist()]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(many, np.int64)
        for batch in batches:
            if len(batch):
                counts += np.bincount((_kmers(split(batch), 2)[0] % np.uint64(many)).astype(np.int64), minlength=many)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["at", "n"])

    rows = texts.select("words").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most _MOST_COUNTERS
    counters = np.zeros(many, np.uint32)
    counters[rows.column("at").to_numpy()] = np.minimum(rows.column("n").to_numpy(), (1 << 32) - 1)
    counters = texts.sparkSession.sparkContext.broadcast(counters)

    def keyed_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = prefix_keys(split(batch), sizes, counters.value)
                nodes = np.repeat(batch.column("node").to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(keys), pa.int64())], names=["node", "bucket"])

    return texts.select("node", "words").mapInArrow(keyed_, "node long, bucket long")


def _of(bodies: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of those nodes; where these are few, only their rows are moved later."""
    nodes = written(nodes.select(F.col("node").alias("key")).distinct(), "near-wanted")
    return keyed(bodies, F.col("node"), nodes, nodes.count(), "left_semi")


def _confirmed(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """Those pairs (u, v) whose words align well enough."""
    bodies = _of(bodies, pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    joined = pairs.hint("merge").join(bodies.select(F.col("node").alias("u"), F.col("words").alias("a")), "u")
    joined = joined.join(bodies.select(F.col("node").alias("v"), F.col("words").alias("b")).hint("merge"), "v").select("u", "v", "a", "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near pairs", dict)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist())]
                keep = pa.array(similar(texts, least))
                yield pa.RecordBatch.from_arrays([part.column("u").filter(keep), part.column("v").filter(keep)], names=["u", "v"])

    return joined.mapInArrow(each, "u long, v long")


def _profiles(bodies: DataFrame) -> DataFrame:
    """node, n (words), a bitmap of the words, and counts: how many words fall to each of many counters, as bytes that stop at 255, compressed."""
    maps = [f"m{k}" for k in range(_BITMAP)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(a, 1000) for x in batches for a in range(0, len(x), 1000)):
            words = [np.frombuffer(w, "<u4") for w in batch.column("words").to_pylist()]
            sizes = [_FINE if len(w) <= _FINE_WORDS else _PROFILE for w in words]
            counts = [zlib.compress(np.minimum(np.bincount(w % k, minlength=k), 255).astype(np.uint8).tobytes()) for w, k in zip(words, sizes)]
            small = 64 * _BITMAP // _UNARY
            few = np.array([np.bincount(w % small, minlength=small) for w in words]).reshape(-1, small, 1)
            packed = np.packbits((few > np.arange(_UNARY)).reshape(len(words), -1), axis=1, bitorder="little").view("<i8").reshape(-1, _BITMAP)
            arrays = [batch.column("node"), pa.array([len(w) for w in words], pa.int32()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(packed[:, k].copy()) for k in range(_BITMAP))], names=["node", "n", "counts", *maps])

    return bodies.mapInArrow(each, "node long, n int, counts binary, " + ", ".join(f"{m} long" for m in maps))


def _apart(left: str, right: str) -> Column:
    """How many bits of one bitmap the other lacks; each edit takes away one at most."""
    lacking = [F.bit_count(F.col(f"{left}{k}").bitwiseAND(F.bitwise_not(F.col(f"{right}{k}")))) for k in range(_BITMAP)]
    return sum(lacking[1:], lacking[0])


def _near_enough(pairs: DataFrame, most: float) -> DataFrame:
    """Those pairs (u, v, their lengths n and m, their counts a and b) that may be within an edit distance of ``most`` of the longer text; none that is nearer is lost."""

    def unpacked(profiles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts by many counters, and whether a profile has as many; one with few has only the first of them."""
        counts = [np.frombuffer(zlib.decompress(x), np.uint8) for x in profiles]
        out = np.zeros((len(counts), _FINE), np.int16)
        for row, c in zip(out, counts):
            row[: len(c)] = c
        return out, np.array([len(c) == _FINE for c in counts], bool)

    def folded(counts: np.ndarray) -> np.ndarray:
        return np.minimum(counts.reshape(len(counts), -1, _PROFILE).sum(axis=1), 255)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                # A text is in many pairs; its profile is unpacked once for these.
                a, b = (part.column(c).dictionary_encode() for c in "ab")
                (a, fine_a), (b, fine_b) = ((m[x.indices.to_numpy()], f[x.indices.to_numpy()]) for x in (a, b) for m, f in (unpacked(x.dictionary.to_pylist()),))
                longer = np.maximum(part.column("n").to_numpy(), part.column("m").to_numpy())
                # Each edit takes one word away, adds one, or both.
                differ = lambda x, y: np.maximum(np.maximum(x - y, 0).sum(axis=1), np.maximum(y - x, 0).sum(axis=1))
                apart = np.where(fine_a & fine_b, differ(a, b), differ(folded(a), folded(b)))
                keep = pa.array(apart <= np.floor(longer * most + 1e-9))
                yield pa.RecordBatch.from_arrays([part.column("u").filter(keep), part.column("v").filter(keep)], names=["u", "v"])

    return pairs.select("u", "v", "n", "m", "a", "b").mapInArrow(each, "u long, v long")


def _possible(pairs: DataFrame, profiles: DataFrame, most: float) -> DataFrame:
    """Those pairs (u, v) that :func:`_near_enough` leaves by their profiles."""
    side = lambda v, n, c: profiles.select(F.col("node").alias(v), F.col("n").alias(n), F.col("counts").alias(c))
    return _near_enough(pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v"), most)


def _left_over(shared: DataFrame, met: DataFrame, classed: Callable, bodies: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) that the rounds of leaders leave to compare.

    A node of another class than its bucket's leader ("stray") meets all nodes
    of other classes in the bucket. Those that are linked to the leader itself
    are left out where the triangle inequality allows it: where the stray is
    so far from the leader that it can't be near to what is near to the leader.
    Large buckets are split into blocks, by the strays in them.
    """
    direct = met.select(F.col("u").alias("leader"), F.col("v").alias("node"))
    unlinked = written(classed(shared.join(direct, ["leader", "node"], "left_anti")), "near-unlinked")
    found = written(unlinked.where("c <> lc"), "near-found")
    loose = written(unlinked.join(found.select("bucket").distinct(), "bucket", "left_semi"), "near-loose")
    profiled = lambda nodes: written(_profiles(_of(bodies, nodes)), "near-profiles", compression="zstd")
    profiles = profiled(loose.select("node").unionByName(found.select(F.col("leader").alias("node"))))
    # d(stray, leader) <= d(stray, x) + d(x, leader), lengths of near texts being within a factor of ``least``.
    reach = (1 - least) / least + (1 - least) / least**2
    close = _possible(found.select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), profiles, reach)
    close = written(close.select(F.col("u").alias("node"), F.col("v").alias("leader"), F.lit(True).alias("close")), "near-close")
    strays = written(found.join(close, ["node", "leader"], "left").withColumn("close", F.coalesce("close", F.lit(False))), "near-strays")
    linked = shared.join(strays.where("close").select("bucket").distinct(), "bucket", "left_semi").join(direct, ["leader", "node"], "left_semi")
    met_too = written(loose.withColumn("linked", F.lit(False)).unionByName(classed(linked).withColumn("linked", F.lit(True))), "near-met")
    if not met_too.where("linked").isEmpty():
        discard(profiles)
        profiles = profiled(met_too.select("node").unionByName(strays.select(F.col("leader").alias("node"))))
    # A stray meets the loose under one token of the bucket, and under another, if it is close, the linked.
    loose_token, linked_token = F.shiftleft("bucket", 1), F.shiftleft("bucket", 1) + 1
    here = strays.select("node", "c", F.explode(F.when(F.col("close"), F.array(loose_token, linked_token)).otherwise(F.array(loose_token))).alias("token"))
    there = met_too.select("node", "c", "lc", F.when(F.col("linked"), linked_token).otherwise(loose_token).alias("token"))
    # Each node's tokens, at most two for each sketch: a pair is looked at under the first that it shares.
    maps = [F.col(f"m{k}") for k in range(_BITMAP)]
    bits = profiles.select("node", "n", "counts", sum(map(F.bit_count, maps[1:]), F.bit_count(maps[0])).alias("bits"), *maps)
    mine = written(here.groupBy("node").agg(F.collect_list("token").alias("mine")).join(bits, "node"), "near-mine", compression="zstd")
    theirs = written(there.groupBy("node").agg(F.collect_list("token").alias("theirs")).join(bits, "node"), "near-theirs", compression="zstd")
    blocks = there.groupBy("token").agg(F.ceil(F.count("*") / _BLOCK).cast("long").alias("blocks")).where("blocks > 1")
    blocks = written(blocks, "near-blocks")
    split = lambda df: df.join(blocks, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    here = split(here).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks").join(mine, "node")
    there = split(there).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(theirs, "node")
    there = there.select("token", "block", "theirs", F.col("node").alias("v"), F.col("c").alias("d"), F.col("lc").alias("ld"), F.col("n").alias("m"), F.col("counts").alias("b"), F.col("bits").alias("t"), *(F.col(f"m{k}").alias(f"o{k}") for k in range(_BITMAP)))
    allowed = F.floor(F.greatest("n", "m") * (1 - least) + 1e-9)
    # Bits that one lacks, and so what the other lacks: the difference of their totals.
    alike = (F.abs(F.col("n") - F.col("m")) <= allowed) & (_apart("m", "o") <= allowed - F.greatest(F.lit(0), F.col("t") - F.col("bits")))
    once = (F.col("d") == F.col("ld")) | (F.col("node") < F.col("v"))  # strays are on both sides
    # Inside a lambda, since the join's generated method would else be too large for the JVM to compile.
    shared_first = F.transform(F.array(F.lit(1)), lambda place: F.element_at(F.array_intersect("mine", "theirs"), place))
    first = F.get(shared_first, F.lit(0)) == F.col("token")
    pairs = here.join(there, ["token", "block"]).where((F.col("c") != F.col("d")) & once & alike & first)
    # Both profiles are in the row, so the finer counts decide where the pair was made; each pair is made once.
    found_near = _near_enough(pairs.select(F.col("node").alias("u"), "v", "n", "m", F.col("counts").alias("a"), "b"), 1 - least)
    out = written(found_near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-possible")
    discard(unlinked, found, loose, strays, close, met_too, profiles, mine, theirs, blocks)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float, count: int, seed: int, rounds: int) -> DataFrame:
    """What near_groups returns, with key and stays (whether a row is its class's first) for each row."""
    rows = own(docs, doc_id=id_col, text=text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    signed = written(_signatures(rows, count, seed), "near-signatures", compression="zstd")
    place = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id"), F.col("key"))
    nodes = written(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min(place).alias("best"), F.count("*").alias("n")), "near-nodes")
    first = nodes.select(F.col("node").alias("row"))
    buckets = signed.select("row", "sketches").join(first.hint("merge"), "row", "left_semi").select(F.col("row").alias("node"), F.explode("sketches").alias("bucket"))
    short = signed.where(F.length("words") <= 8 * SHORT_WORDS).select("row", "words").join(first.hint("merge"), "row", "left_semi").select(F.col("row").alias("node"), "words")
    short = written(short, "near-short", compression="zstd")
    buckets = written(buckets.unionByName(_short_buckets(short, least)), "near-buckets")
    discard(short)

    met = None  # links found so far
    of = None  # node and component
    tried = None  # pairs compared so far

    def compared(pairs: DataFrame, width: int | None = None) -> None:
        """Compare those pairs (u, v) that haven't been, and bring links and components up to date."""
        nonlocal met, of, tried
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = written(pairs.coalesce(width) if width else pairs, "near-pairs")
        if pairs.isEmpty():
            return
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = written(_confirmed(pairs, bodies, least), "near-links")
        met = found if met is None else met.unionByName(found)
        discard(of)
        of = written(components(met), "near-components")

    def classed(df: DataFrame, node: str, name: str) -> DataFrame:
        if of is None:
            return df.withColumn(name, F.col(node))
        named = df.join(of.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left")
        return named.withColumn(name, F.coalesce(name, node))

    def led_by(df: DataFrame) -> DataFrame:
        leaders = df.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
        leaders = written(leaders, "near-leaders")
        led = written(df.join(leaders.hint("merge"), "bucket").where("node <> leader").select("bucket", "node", "leader"), "near-led")
        discard(leaders)
        return led

    apart = lambda df: classed(classed(df, "node", "c"), "leader", "lc").where("c <> lc")
    shared = led_by(buckets)
    discard(buckets)
    # Words of the nodes that share a bucket, fetched once.
    meeting = shared.select(F.col("node").alias("key")).unionByName(shared.select(F.col("leader").alias("key"))).distinct()
    meeting = written(meeting, "near-meeting")
    some = keyed(signed.select("row", "words"), F.col("row"), meeting, meeting.count(), "left_semi")
    bodies = written(some.withColumnRenamed("row", "node"), "near-bodies", compression="zstd")
    discard(meeting)
    led, width = shared, None  # later rounds are as small as what is left for them
    for turn in range(rounds):
        compared(led.select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), width)
        if turn < rounds - 1:
            left = written(apart(led).select("bucket", "node"), "near-left")
            led = led_by(left)
            discard(left)
            width = sized(led.count())
    if led is not shared:
        discard(led)
    if met is not None:
        compared(_left_over(shared, met, lambda df: classed(classed(df, "node", "c"), "leader", "lc"), bodies, least))
    discard(shared, bodies)

    if of is None:
        named = nodes.withColumn("component", F.lit(None).cast("long"))
    else:
        named = written(nodes.join(of, "node", "left"), "near-named")
    whole = named.where("component is not null").groupBy("component").agg(F.min("best").alias("best"), F.sum("n").alias("class_size"), F.count("*").alias("texts"))
    whole = written(whole, "near-classes")
    linked = named.where("component is not null").select("digest", "component").join(whole, "component").drop("component")
    alone = named.where("component is null").select("digest", "best", F.col("n").alias("class_size"), F.lit(1).cast("long").alias("texts"))
    by_digest = written(linked.unionByName(alone), "near-digests")
    out = signed.select("doc_id", "key", "digest").join(by_digest.hint("merge"), "digest")
    return out.select("doc_id", "key", F.col("best.doc_id").alias("class_id"), "class_size", "texts", place.eqNullSafe(F.col("best")).alias("stays"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = SIMILARITY,
    count: int = SKETCHES,
    seed: int = 11,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The class of near copies that each document belongs to.

    One row per input row: doc_id, class_id (the least doc_id of the class),
    class_size (rows), texts (different word sequences in the class). Two
    documents are linked if the edit distance of their words, over the longer
    length, is at most 1 - ``least``; classes are what links connect. Links of
    texts of up to SHORT_WORDS words are all found where ``least`` is 0.7 or more. Texts
    without words, nulls among them, form one class. A null id is a row like
    others and is never class_id unless its class has no other. Repeated rows
    and ids are rows of their own. Other columns are ignored, whatever their
    names. Texts of any length are compared whole; an alignment holds two rows
    of its band, its time grows with length times allowed distance. An empty
    table gives an empty result.
    """
    return _classes(docs, id_col, text_col, least, count, seed, rounds).select("doc_id", "class_id", "class_size", "texts")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the least id (null last) of each class, with all its columns.

    Rows that repeat an id and a text are one document; one of them stays.
    Only ids and hashes are shuffled, and rows that repeat; texts stay in place.
    """
    found = _classes(docs, id_col, text_col, SIMILARITY, SKETCHES, 11, ROUNDS).select("key", "stays")
    return staying(docs, F.xxhash64(f"`{id_col}`", f"`{text_col}`"), found, [id_col, text_col])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies for every document."""
    return near_groups(table(spark, sf_dir, "documents"))
