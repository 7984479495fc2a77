"""Cases that the driver's tables don't hold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import l2_normalize, register_sql
from nearfield.operators import exact, kmeans, metrics, pq
from nearfield.operators import kernels
from nearfield.operators.kernels import BestK
from nearfield.plans import FlatIndexL2, IVFIndex
from nearfield.sources import random_bytes, random_vectors, read_npy
from nearfield.streaming import search_stream

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in rows], SCHEMA)


def as_queries(df):
    return df.withColumnRenamed("vec_id", "query_id")


def hits(df):
    return [(r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 6)) for r in df.orderBy("query_id", "rank").collect()]


def test_zero_vector_stays_zero(spark):
    v = frame(spark, [(0, [0, 0]), (1, [3, 4])]).select(l2_normalize("embedding").alias("n")).collect()
    assert v[0]["n"] == [0.0, 0.0]
    assert np.allclose(v[1]["n"], [0.6, 0.8])


def test_ties_go_to_the_lower_id_and_k_is_clamped(spark):
    data = frame(spark, [(5, [1, 0]), (2, [2, 0]), (9, [0, 0]), (7, [-1, 0])])
    for kernel in ("gemm", "expression"):
        got = hits(exact.knn(as_queries(frame(spark, [(1, [1, 0])])), data, 10, True, kernel))
        assert got == [(1, 1, 2, 0.0), (1, 2, 5, 0.0), (1, 3, 9, 2.0), (1, 4, 7, 4.0)]


def test_raw_queries_scale_distances_not_ids(spark):
    data = frame(spark, [(k, [k + 1, 3 - k]) for k in range(4)])
    one, ten = (as_queries(frame(spark, [(0, [f, f])])) for f in (1, 10))
    index = FlatIndexL2(2).add(data)
    assert [h[2] for h in hits(index.search(one, 4))] == [h[2] for h in hits(index.search(ten, 4))]
    assert hits(index.search(ten, 1))[0][3] < 0


def test_small_cells_give_up_nothing(spark):
    data = frame(spark, [(k, [1, 0.01 * k]) for k in range(3)] + [(10 + k, [0.01 * k, 1]) for k in range(2)])
    start = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, centroid array<double>")
    index = IVFIndex(2, 2, nprobe=2).train(data, init=start, iterations=1)
    assert len(hits(index.search(as_queries(frame(spark, [(0, [1, 1])])), 5))) == 5
    padded = index.search(as_queries(frame(spark, [(0, [1, 1])])), 7, padded_form=True).first()["hits"]
    assert [h["vec_id"] for h in padded[:2]] == [0, 0] and [h["distance"] for h in padded[:2]] == [0.0, 0.0]


def test_antiparallel_vector_has_a_cell(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0])], "cell int, centroid array<double>")
    data = frame(spark, [(0, [-5, 0])])
    assert exact.nearest_centroid(data, c).first()["cell"] == 0
    assert kmeans.assign(data, c).first()["cell"] == 0
    assert exact.min_centroid_distance(data, c).first()["distance"] == pytest.approx(4.0, abs=1e-6)


def test_empty_cell_keeps_its_direction(spark):
    data = frame(spark, [(0, [1, 0]), (1, [1, 0.1])])
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "cell int, centroid array<double>")
    by_step = {r["cell"]: r["centroid"] for r in kmeans.step(data, c, 2).collect()}
    by_gemm = {r["cell"]: r["centroid"] for r in kmeans.train(data, c, 1).collect()}
    assert np.allclose(by_step[1], [-0.1, 0.0]) and np.allclose(by_step[0], by_gemm[0])


@pytest.mark.parametrize("bad", [[1.0], [1.0, None], [1.0, float("nan")], None])
def test_unsound_vectors_raise(spark, bad):
    data = spark.createDataFrame([(0, bad)], SCHEMA)
    with pytest.raises(Exception, match="no id or no vector"):
        FlatIndexL2(2).add(data).search(as_queries(frame(spark, [(0, [1, 1])])), 1).collect()


def test_untrained_index_raises(spark):
    with pytest.raises(ValueError):
        IVFIndex(2).search(as_queries(frame(spark, [(0, [1, 1])])), 1)
    with pytest.raises(ValueError):
        FlatIndexL2(2).search(as_queries(frame(spark, [(0, [1, 1])])), 1)


def test_full_probe_equals_flat_and_recall_grows(spark):
    data = random_vectors(spark, 300, 8, 1)
    q = as_queries(random_vectors(spark, 10, 8, 2))
    flat = FlatIndexL2(8).add(data).search(q, 5, True).cache()
    index = IVFIndex(8, 6).train(data, seed=2)
    recalls = [metrics.recall(flat, IVFIndex(8, 6, nprobe=n, centroids=index.centroids, cells=index.cells).search(q, 5)).first()["recall"] for n in (1, 3, 6, 99)]
    assert recalls == sorted(recalls) and recalls[-1] == recalls[-2] == 1.0
    assert hits(index.search_auto(q, 5, 4.0)) == hits(flat)


def test_added_vectors_are_found_and_index_is_stored(spark, tmp_path):
    data = random_vectors(spark, 100, 8, 1)
    index = IVFIndex(8, 4, use_pq=True, nprobe=4).train(data, codes=16, pq_iterations=2)
    index = index.add(frame(spark, [(1000, [9, 0, 0, 0, 0, 0, 0, 0])]))
    assert index.size == 101
    index.save(str(tmp_path))
    loaded = IVFIndex.load(spark, str(tmp_path), 8, use_pq=True, nprobe=4)
    q = as_queries(random_vectors(spark, 3, 8, 9))
    for scoring in ("adc", "code_dot"):
        assert hits(index.search(q, 4, scoring=scoring)) == hits(loaded.search(q, 4, scoring=scoring))


def test_codebook_settles_and_lowers_error(spark):
    data = random_vectors(spark, 200, 8, 4)
    first = pq.initial_codebook(data, 8, 2, 8)
    last = pq.train_codebook(data, 8, 2, 8, iterations=5)

    def error(book):
        coded = pq.encode_parts(pq.subvectors(data, 8, 2), book).join(book, ["subspace", "code"])
        return coded.agg(F.sum(F.aggregate(F.zip_with("part", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))).first()[0]

    assert error(last) < error(first)


def test_npy_source_reads_ranges(spark, tmp_path):
    x = np.random.default_rng(0).random((1000, 6)).astype(np.float64)
    np.save(tmp_path / "x.npy", x)
    got = read_npy(spark, str(tmp_path / "x.npy"), part_bytes=str(6 * 8 * 300))
    assert got.rdd.getNumPartitions() == 4
    rows = got.orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(1000))
    assert np.allclose([r["embedding"] for r in rows], x.astype(np.float32))


def test_generators_repeat(spark):
    assert random_vectors(spark, 20, 3, 1).collect() == random_vectors(spark, 20, 3, 1).repartition(7).orderBy("vec_id").collect()
    ids = spark.createDataFrame([(7, "x"), (3, "y"), (7, "z")], "vec_id long, other string")
    assert random_vectors(spark, ids, 3, 1).orderBy("vec_id").collect() == random_vectors(spark, 8, 3, 1).where("vec_id in (3, 7)").unionByName(random_vectors(spark, 8, 3, 1).where("vec_id = 7")).orderBy("vec_id").collect()
    b = [x for r in random_bytes(spark, 50, 4, 1).collect() for x in r["embedding"]]
    assert 0 <= min(b) and max(b) <= 255


def test_stream_of_queries(spark, tmp_path):
    data = random_vectors(spark, 50, 4, 1)
    q = as_queries(random_vectors(spark, 6, 4, 2)).coalesce(1)
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    search_stream(stream, FlatIndexL2(4).add(data), 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert hits(got) == hits(FlatIndexL2(4).add(data).search(q, 3))


def test_sql_functions(spark):
    register_sql(spark)
    assert spark.sql("select vec_dot(array(1D, 2D), array(3D, 4D)) d, vec_squared_l2(array(1D, 2D), array(3D, 4D)) e").first().asDict() == {"d": 11.0, "e": 8.0}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 6), st.lists(st.lists(st.integers(0, 3), min_size=3, max_size=3), min_size=1, max_size=30))
def test_best_k_equals_sorting(k, step, table):
    d = np.array(table, float).T  # three queries
    best = BestK(3, k)
    for a in range(0, d.shape[1], step):
        best.block(d[:, a : a + step], np.arange(a, min(a + step, d.shape[1])), 0)
    for q in range(3):
        mine = [(x, i) for qq, x, i in zip(best.query, best.distance, best.id) if qq == q]
        assert mine == sorted((x, i) for i, x in enumerate(d[q]))[:k]


def random_frame(spark, n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return frame(spark, list(enumerate(x)))


def test_many_queries_meet_the_data_in_blocks(spark, monkeypatch):
    from nearfield.operators import kernels

    data = random_frame(spark, 90, 4, 1).repartition(3)
    expected = hits(exact.self_knn(data, 4))
    monkeypatch.setattr(kernels, "BROADCAST_BYTES", 64)
    monkeypatch.setattr(kernels, "BLOCK_ROWS", 7)
    joined = exact.self_knn(data, 4)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    assert hits(joined) == expected == hits(exact.self_knn(data, 4, "expression"))


@pytest.mark.parametrize("kind", ["vectors", "adc", "code_dot"])
def test_probes_beyond_a_broadcast_give_the_same(spark, monkeypatch, kind):
    from nearfield.operators import kernels

    data = random_frame(spark, 80, 8, 2)
    index = IVFIndex(8, 5, kind != "vectors", 2, subspaces=2).train(data, iterations=1, codes=6, pq_iterations=1, seed=1)
    queries = as_queries(data.where("vec_id % 9 = 0"))
    how = {} if kind == "vectors" else {"scoring": kind}
    expected = hits(index.search(queries, 6, **how))
    assert len(expected) > 20
    monkeypatch.setattr(kernels, "BROADCAST_BYTES", 64)
    assert hits(index.search(queries, 6, **how)) == expected


def test_repeated_ids_stay_rows(spark):
    data = frame(spark, [(1, [1, 0]), (1, [0, 1]), (2, [1, 0.1])])
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell int, centroid array<double>")
    assert sorted(r["cell"] for r in exact.nearest_centroid(data, c).collect()) == [0, 0, 1]
    index = IVFIndex(2, 2, nprobe=2, use_pq=True, subspaces=2).train(data, init=c, iterations=1, codes=2, pq_iterations=1)
    assert index.size == 3


def test_recall_of_codes_in_clusters(spark):
    """100 nearest of 100 queries by codes in all cells, among 2,000 vectors around 40 centres."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, 2000)] + 0.15 * r.normal(size=(2000, 16))
    data = frame(spark, list(enumerate(x)))
    queries = as_queries(data.where("vec_id % 20 = 0"))
    index = IVFIndex(16, 8, True, 8, subspaces=4).train(data, iterations=3, codes=32, pq_iterations=8, seed=2)
    truth = FlatIndexL2(16).add(data).search(queries, 100, True)
    assert metrics.recall(truth, index.search(queries, 100)).first()["recall"] > 0.7


def test_an_offer_sorts_only_the_queries_it_concerns(monkeypatch):
    best = BestK(10_000, 5)
    best.offer(np.repeat(np.arange(10_000), 5), np.tile(np.arange(5.0), 10_000), np.tile(np.arange(5), 10_000))
    sorted_rows, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    best.offer(np.array([7, 7]), np.array([0.5, 9.0]), np.array([9, 8]))
    assert max(sorted_rows) < 20
    assert best.ids[7].tolist() == [0, 9, 1, 2, 3] and best.worst[7] == 3.0


def test_queries_and_vectors_are_copied_to_the_root_of_the_tasks(spark, monkeypatch):
    copied = []
    monkeypatch.setattr(kernels, "BROADCAST_BYTES", 64)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "36")
    try:
        data = random_vectors(spark, 500, 8, 1)
        seen = kernels.passing(as_queries(data), data, lambda ids, x: len(ids), lambda ids, q, n: iter([kernels.pa.RecordBatch.from_arrays([kernels.pa.array(ids), kernels.pa.array(np.full(len(ids), n)), kernels.pa.array(np.zeros(len(ids)))], names=["query_id", "vec_id", "distance"])]))
        rows = seen.collect()
        copied = [(r["query_id"], r["vec_id"]) for r in rows]
        near = hits(exact.self_knn(data, 3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(copied) == 500 * 6  # not 36
    met = {}
    for q, n in copied:
        met[q] = met.get(q, 0) + n
    assert set(met.values()) == {500}  # each query meets each vector once
    x = kernels.normalized(np.array([r["embedding"] for r in data.orderBy("vec_id").collect()], float))
    d = 2 - 2 * (x @ x.T)
    want = [(q, rank + 1, int(v), round(float(d[q, v]), 6)) for q in range(500) for rank, v in enumerate(np.lexsort((np.arange(500), d[q]))[:3])]
    assert [(q, r, v) for q, r, v, _ in near] == [w[:3] for w in want]


@pytest.mark.parametrize("scale", [1.0, 1e-14, 1e-200, 1e9])
def test_single_precision_leaves_out_no_nearest_vector(scale):
    rng = np.random.default_rng(3)
    x = kernels.normalized(np.concatenate([rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(5, 16)), 40, axis=0), np.zeros((3, 16))]))
    q = np.concatenate([x[::7] * scale, x[300:302] * scale * (1 + 1e-9), np.zeros((1, 16))])
    best, factors = BestK(len(q), 6), kernels.Factors(q)
    for a in range(0, len(x), 50):
        best.product(factors, kernels.Factors(x[a : a + 50]), np.arange(a, min(a + 50, len(x))), 0)
    d = 2.0 - 2.0 * np.einsum("ij,kj->ik", q, x)
    for row, ids, distances in zip(d, best.ids, best.distances):
        assert np.allclose(distances, np.sort(row)[:6], rtol=0, atol=1e-14 * max(1.0, scale))
        assert len(set(ids.tolist())) == 6


def test_expression_ranks_few_pairs_and_loses_none(spark):
    data = random_vectors(spark, 3000, 6, 4).unionByName(frame(spark, [(5000 + k, [0, 0, 0, 0, 0, k]) for k in range(3)]).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")))
    queries = as_queries(data.where("vec_id % 100 = 0"))
    found = exact.bounded(queries, data, 2, True)
    assert found.count() < queries.count() * 3003 / 4
    assert hits(exact.knn(queries, data, 2, True, "expression")) == hits(exact.knn(queries, data, 2, True))
    plan = exact.distances(queries, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.split("Join")[0]  # compiled products, one column for each element


def test_all_pairs_are_ranked_by_slices(spark, monkeypatch):
    from nearfield.operators import topk

    monkeypatch.setattr(kernels, "PAIRS_PER_SLICE", 9)
    data = random_vectors(spark, 90, 4, 1).unionByName(random_vectors(spark, 90, 4, 1).withColumn("vec_id", F.col("vec_id") + 1000))
    queries = as_queries(data.where("vec_id % 7 = 0"))
    got = exact.ranked_pairs(queries, data, True)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    place = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"] % 1000, round(r["distance"], 9)) for r in df.collect())
    assert place(got) == place(topk.order_by_distance(exact.distances(queries, data, True)))


def test_pairs_are_ranked_where_they_are_made(spark):
    data = random_vectors(spark, 300, 8, 1)
    plan = exact.ranked_pairs(as_queries(data.where("vec_id % 3 = 0")), data, True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("CartesianProduct")[0]  # vectors are shuffled, pairs aren't


@pytest.mark.parametrize("held, at_once", [(1 << 25, 1 << 23), (500, 1 << 23), (500, 7), (500, 150)])
def test_ranked_pairs_of_copies_are_ranked_by_id(spark, monkeypatch, held, at_once):
    monkeypatch.setattr(kernels, "RANKED_PAIRS", held)
    monkeypatch.setattr(kernels, "PAIRS_PER_SLICE", at_once)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(131, 64))
    x[rng.permutation(131)[:60]] = x[0]
    x[7], x[9, 3] = 0, np.nan
    ids = rng.permutation(131)
    ids[10:14], ids[20:23] = ids[0], ids[1]  # ids that occur again, with other vectors or the same
    x[20:23] = x[1]
    data = frame(spark, list(zip(ids.tolist(), x)))
    queries = data.where(F.col("vec_id").isin(ids[:9].tolist()))
    u, rows = kernels.normalized(x), {}
    for i in np.flatnonzero(np.isin(ids, ids[:9])):
        rows.setdefault(int(ids[i]), []).extend((2 - 2 * float(u[i] @ u[j]), int(ids[j])) for j in range(131))
    want = {q: [i for _, i in sorted(pairs, key=lambda p: (not np.isnan(p[0]), 0 if np.isnan(p[0]) else -p[0], p[1]))] for q, pairs in rows.items()}
    got = {}
    for r in sorted(exact.ranked_pairs(as_queries(queries), data, True, with_distance=False).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
    assert got == want


@pytest.mark.parametrize("width", [0, 1, 64, 300, 4096])
def test_products_of_equal_vectors_are_equal(width):
    rng = np.random.default_rng(2)
    for n in (8, 56, 72, 256):
        q, x = rng.normal(size=(n, width)), np.tile(rng.normal(size=width), (n, 1))
        q[-1] = q[0]
        product = kernels._products(q, x)
        assert np.allclose(product, q @ x.T)
        assert (product == product[:, :1]).all() and (product[0] == product[-1]).all()
