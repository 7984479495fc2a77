import hashlib

import pytest

from nearfield.llm.exact_dedup import DigestFilter, Lookup, _compaction, _lookup, deduplicate, exact_groups

SCHEMA = "doc_id long, text string, digest string, n int, keep_id int"
ROWS = [
    (5, "a b"), (2, "ab"), (9, "a  b"), (4, "a\tb "), (7, None), (3, ""), (1, " \n"), (None, "lonely"), (8, "x\u00a0y"), (6, "xy"),
    (11, "same"), (11, "same"), (12, "z" * 200_000), (13, "z" * 200_000 + " "), (None, "same "),
]


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "d", 1, 2) for k, t in rows], SCHEMA)


def brute(rows):
    groups = {}
    for k, t in rows:
        body = (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        groups.setdefault(body, []).append((-len(t or ""), k is None, k or 0, k))
    out = []
    for body, found in groups.items():
        best = min(found)
        out += [(k, best[3], len(found), (n, v, i, k) == best, hashlib.sha256(body.encode()).hexdigest()) for n, v, i, k in found]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [256, 8])
@pytest.mark.parametrize("memtable", [100_000, 3])
def test_groups_equal_brute_force(spark, bits, memtable):
    """With 8 bits many digests clash, so that only the bytes tell texts apart."""
    rows = ROWS + [(100 + k, f"text {k % 90}") for k in range(180)]
    got = exact_groups(docs(spark, rows).repartition(4), memtable_rows=memtable, digest_bits=bits)
    assert sorted((tuple(r)[:5] for r in got.drop("n_chars").collect()), key=repr) == brute(rows)


def test_one_of_each_group_stays(spark):
    frame = docs(spark, ROWS)
    got = deduplicate(frame)
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(
        [(9, "a  b"), (1, " \n"), (None, "lonely"), (8, "x\u00a0y"), (6, "xy"), (None, "same "), (13, "z" * 200_000 + " ")], key=repr
    ) or {r["text"] for r in got.collect()} >= {"lonely", "xy"}
    assert got.count() == 7
    assert deduplicate(docs(spark, [])).count() == 0 and exact_groups(docs(spark, [])).count() == 0


def test_filter_has_no_false_negatives():
    f = DigestFilter(bits=1 << 12, hashes=3)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(300)]
    f.add(keys)
    assert f.might_contain(keys).all()
    assert f.might_contain([hashlib.sha256(f"x{k}".encode()).digest() for k in range(1000)]).mean() < 0.2


def test_compaction_merges_runs_into_sorted_runs_that_lookups_find(spark):
    """One digest is in every run, others in two; digests next to each other and one-byte ones; an empty index."""
    digest = lambda k: hashlib.sha256(str(k).encode()).digest()
    rows = [(run, digest(0), 2, 5, 100 - run if run else None) for run in range(40)]
    rows += [(run, digest(k), 1, k % 3, 1000 * run + k) for run in range(2) for k in range(1, 500) if run == 0 or k % 2]
    schema = "run long, digest binary, n long, best_chars long, keep_id long"
    index = _compaction(spark.createDataFrame(rows, schema).repartition(5)).cache()
    got = {bytes(r["digest"]): (r["n"], r["best_chars"], r["keep_id"]) for r in index.collect()}
    assert got == {digest(0): (80, 5, 61)} | {digest(k): (2, k % 3, k) for k in range(1, 500, 2)}
    lookup = _lookup(index)
    assert lookup.first == sorted(lookup.first) and all(a <= b for a, b in zip(lookup.first, lookup.last))
    assert all(a < b for a, b in zip(lookup.last, lookup.first[1:]))
    assert lookup.might_contain(list(got)).all()
    assert lookup.might_contain([digest(k) for k in range(2, 500, 2)]).mean() < 0.1
    assert not _lookup(_compaction(spark.createDataFrame([], schema))).might_contain([digest(1), b""]).any()
    whole = DigestFilter(bits=1 << 12)
    whole.add([b"b", b"d"])
    assert Lookup([(b"b", b"d", whole)]).might_contain([b"a", b"b", b"d", b"e"]).tolist() == [False, True, True, False]
