import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm.packing import CAPACITY, cut_lengths, pack, powers_of_two
from nearfield.llm.token_files import ShardReader, ShardWriter, bits_for, file_system, pack_bits, read_tokens, unpack_bits, write_tokens
from nearfield.llm.tokenization import TextEncoder, default_vocabulary

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, start int, ids int, sequence_id int"


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(default_vocabulary(), most_words=3000)


def docs(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], SCHEMA)


PIECES = ["a", "the", " ", "  ", "\n", "\n\n", " \n", "\t", ".", ",", "'s", "don't", "12", "é", "\u00a0", "<|endoftext|>", "***", "日本", "...", "\x1c", "\U0001f642", "foo.", " bar", "\r\n", "\u2003"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.none(), min_size=1, max_size=6))
def test_encoding_by_words_equals_the_library(texts):
    e = TextEncoder(default_vocabulary(), most_words=50, slice_bytes=20) if not hasattr(test_encoding_by_words_equals_the_library, "e") else test_encoding_by_words_equals_the_library.e
    test_encoding_by_words_equals_the_library.e = e
    got = e.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [e.whole(t or "").tolist() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.integers(1, 300), st.integers(0, 50), st.randoms(use_true_random=False))
def test_bits_round_trip(bits, n, first, rng):
    ids = np.array([rng.randrange(1 << bits) for _ in range(n)], "<u4")
    first = min(first, n)
    assert (unpack_bits(pack_bits(ids, bits), bits, n - first, first) == ids[first:]).all()


def test_fewest_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 17, n).astype("<u4") for n in (0, 5, 3000, 1, 64, 0, 129)]
    with open(tmp_path / "s", "wb") as out:
        writer = ShardWriter(out, 17, block_ids=64)
        for k, ids in enumerate(parts):
            writer.add(None if k == 1 else k, ids)
        writer.close()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "s")) as source:
        reader = ShardReader(source)
        assert all((reader.document(k) == ids).all() for k, ids in enumerate(parts))
        assert [(d, x.tolist()) for d, _, x in reader.documents()] == [(None if k == 1 else k, x.tolist()) for k, x in enumerate(parts)]
    with pytest.raises(ValueError):
        ShardWriter(open(tmp_path / "t", "wb"), 3).add(0, np.array([8], "<u4"))


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta,", "gamma.", "délta", "12"]) for _ in range(n))


def sample(rng):
    rows = [(k, words(rng, rng.choice([0, 1, 5, 40, 700, 5000]))) for k in range(60)]
    return rows + [(100, None), (None, "no id"), (3, "again"), (3, "again")]


def test_files_hold_every_document_in_order(spark, encoder):
    rows = sample(random.Random(1))
    got = read_tokens(write_tokens(docs(spark, rows).repartition(5), block_ids=100)).orderBy("start").collect()
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in got] == [k for k, _ in expected]
    start = 0
    for r, (_, text) in zip(got, expected):
        ids = np.append(encoder.whole(text or ""), np.uint32(2)).astype("<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)
    assert read_tokens(write_tokens(docs(spark, []))).count() == 0


def test_large_tasks_write_several_shards(spark, encoder):
    rows = sample(random.Random(3))
    frame = docs(spark, rows).repartition(5)
    one, several = write_tokens(frame), write_tokens(frame, block_ids=100, shard_ids=1500)
    assert several.count() > one.count() and several.agg({"n_docs": "sum"}).first()[0] == len(rows)
    longest = max(len(encoder.whole(t or "")) + 1 for _, t in rows)
    assert all(r["n_tokens"] < 1500 + longest for r in several.collect())
    key = lambda r: (r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"]))
    assert [key(r) for r in read_tokens(several).orderBy("start").collect()] == [key(r) for r in read_tokens(one).orderBy("start").collect()]


def test_schemes_of_spark_that_arrow_has_under_another_name(tmp_path):
    fs, path = file_system(f"file://{tmp_path}")
    assert isinstance(fs, pafs.LocalFileSystem) and path == str(tmp_path)
    try:
        fs, path = file_system("s3a://bucket/folder?region=us-east-1")
    except ImportError:  # built without it
        return
    assert path == "bucket/folder"


@given(st.integers(1, 20_000))
def test_cuts_add_up(n):
    cuts = cut_lengths(n, CAPACITY)
    assert sum(cuts) == n and all(0 < c <= CAPACITY for c in cuts)
    assert all(c * (CAPACITY // c) >= 0.975 * CAPACITY for c in cuts)
    assert sum(powers_of_two(n)) == n


def test_packing_is_a_partition_with_little_padding(spark, encoder):
    rows = [(k, t) for k, t in sample(random.Random(2)) if k != 3]
    frame = pack(docs(spark, rows).repartition(3)).withColumn("crc", F.crc32("ids"))
    got = frame.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {k for k, _ in rows}
    for k, text in rows:
        ids = np.append(encoder.whole(text or ""), np.uint32(1)).astype("<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert bytes(r["ids"]) == ids[at : at + r["length"]].tobytes() and r["crc"] == zlib.crc32(r["ids"])
            at += r["length"]
        assert at == len(ids)
    real = stored = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= CAPACITY
        real += at
        stored += at if at & (at - 1) == 0 else CAPACITY
    assert stored <= 1.03 * real
    assert pack(docs(spark, [])).count() == 0
