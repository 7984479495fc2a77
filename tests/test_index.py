"""Stored indexes, exact search from them, seeding, codebooks, thresholds and the .npy sink, against brute force."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.operators import exact, ivf, kernels, kmeans, metrics, pq, threshold
from nearfield.plans import FlatIndexL2, IVFIndex
from nearfield.plans.storage import versions
from nearfield.queries import query_rows, vectors
from nearfield.sources import read_npy, write_npy

SCHEMA = "vec_id long, embedding array<double>"
DATA = "/root/testdata/sf0.01"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(e) for e in v]) for k, v in enumerate(x)], SCHEMA)


def as_queries(df):
    return df.withColumnRenamed("vec_id", "query_id")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 6)) for r in df.collect())


def clusters(n, seed=1, centres=20, dim=8, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))


def unit(x):
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-8)


def nearest(q, x, k):
    d = 2 - 2 * unit(q) @ unit(x).T
    return [(i, rank + 1, int(j), round(float(d[i, j]), 6)) for i in range(len(q)) for rank, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:k])]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    x = clusters(1000)
    data = frame(spark, x).repartition(4)
    path = str(tmp_path_factory.mktemp("index"))
    return x, data, path, IVFIndex(8, 20, nprobe=2).train(data, seed=3, iterations=5, seeding="oversampled").save(path, rows_per_file=40)


def test_stored_index_finds_what_the_unsaved_one_finds(spark, stored):
    x, data, path, index = stored
    unsaved = IVFIndex(8, 20, nprobe=2, centroids=index.centroids).add(data)
    q = as_queries(data.where("vec_id % 50 = 0"))
    assert hits(index.search(q, 7)) == hits(unsaved.search(q, 7)) == hits(IVFIndex.load(spark, path, 8, nprobe=2).search(q, 7))
    assert index.size == 1000 and hits(index.search_auto(q, 7, 0.3)) == hits(unsaved.search_auto(q, 7, 0.3))


def test_search_reads_files_of_probed_cells_only(spark, stored):
    x, data, path, index = stored
    found = index.search(as_queries(data.where("vec_id = 0")), 3)
    assert 0 < len(index.stored.files([0])) < len(index.stored.files())
    read = index._cells(index._probed(as_queries(data.where("vec_id = 0")))).inputFiles()
    assert 0 < len(read) < len(index.stored.files()) / 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "PushedFilters: [In(cell" in plan  # the scan; no vector is assigned again
    hot = index.stored.manifest.groupBy("cell").agg(F.countDistinct("file").alias("files"), F.sum("rows").alias("rows")).orderBy(F.desc("rows")).first()
    assert hot["files"] > 1


def test_saving_a_loaded_index_loses_nothing(spark, stored, tmp_path):
    x, data, _, index = stored
    path = str(tmp_path / "i")
    first = index.save(path)
    files = set(first.stored.files())
    loaded = IVFIndex.load(spark, path, nprobe=20)
    more = loaded.add(frame(spark, [x[0], 2 * x[0]], 5000))
    again = more.save(path)
    assert versions(spark, path) == [1, 2] and (first.size, more.size, again.size) == (1000, 1002, 1002)
    assert files < set(again.stored.files())  # the vectors of the first version weren't written again
    q = as_queries(data.where("vec_id = 0"))
    assert {h[2] for h in hits(again.search(q, 3))} == {0, 5000, 5001} == {h[2] for h in hits(more.search(q, 3))}
    assert hits(loaded.search(q, 3)) == hits(IVFIndex.load(spark, path, nprobe=20, version=1).search(q, 3))
    (tmp_path / "i" / "versions" / "00000003" / "manifest").mkdir(parents=True)  # a save that didn't end
    assert IVFIndex.load(spark, path).size == 1002 and IVFIndex.load(spark, path).save(path).stored.version == 4
    with pytest.raises(ValueError):
        IVFIndex.load(spark, path, 9)
    with pytest.raises(FileNotFoundError):
        IVFIndex.load(spark, path, version=3)
    with pytest.raises(FileNotFoundError):
        IVFIndex.load(spark, str(tmp_path / "none"))


def test_exact_search_from_few_cells(spark, stored):
    x, data, path, index = stored
    q = as_queries(data.where("vec_id % 25 = 0"))
    expected = [(25 * i, *rest) for i, *rest in nearest(x[::25], x, 6)]
    assert hits(index.search_exact(q, 6)) == expected
    share = index.cells_needed(q, 6).count() / (40 * 20)
    assert share < 0.5, share
    assert hits(IVFIndex(8, 20, nprobe=1, centroids=index.centroids).add(data).search_exact(q, 6)) == expected


def test_exact_search_with_odd_vectors(spark):
    x = np.concatenate([clusters(60, 2), np.zeros((2, 8)), clusters(3, 2) * 1e-9, clusters(1, 5) * 1e9])
    data = frame(spark, x)
    for nprobe, k in ((1, 5), (3, 64), (1, 100)):
        index = IVFIndex(8, 6, nprobe=nprobe).train(data, seed=1, iterations=2)
        got, expected = hits(index.search_exact(as_queries(data), k)), nearest(x, x, k)
        assert [h[:2] for h in got] == [h[:2] for h in expected]
        assert np.allclose([h[3] for h in got], [h[3] for h in expected], atol=2e-6)


def test_many_queries_probe_the_same_cells(spark, stored, monkeypatch):
    x, data, path, index = stored
    q = as_queries(data.where("vec_id % 10 = 0"))
    expected = hits(index.search_exact(q, 4))
    monkeypatch.setattr(kernels, "BROADCAST_BYTES", 64)
    monkeypatch.setattr(ivf, "BLOCK_CELLS", 7)
    assert hits(index.search_exact(q, 4)) == expected


def test_queries_pass_groups_once(spark, monkeypatch):
    data = frame(spark, clusters(300, 3)).repartition(3)
    monkeypatch.setattr(kernels, "BROADCAST_BYTES", 64)
    monkeypatch.setattr(kernels, "GROUP_BYTES", 300 * 8 * 8 // 6)
    monkeypatch.setattr(kernels, "BLOCK_ROWS", 7)
    found = kernels.block_topk(as_queries(data), data, 4, True)
    per_group = found.withColumn("g", F.spark_partition_id()).groupBy("g", "query_id").count()
    groups = found.rdd.getNumPartitions()
    assert groups >= 6 and per_group.agg(F.max("count")).first()[0] == 4
    assert found.count() == 300 * 4 * groups  # k rows for each query and group, not for each pair of blocks
    assert hits(exact.self_knn(data, 4)) == nearest(clusters(300, 3), clusters(300, 3), 4)


@pytest.mark.parametrize("cutoff", [0.9, 0.2, 0.0, -0.5, 7.0])
@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("broadcast", [True, False])
def test_threshold_search_equals_brute_force(spark, monkeypatch, cutoff, normalize, broadcast):
    x = np.concatenate([clusters(150, 4), np.zeros((2, 8)), clusters(3, 4) * 1e-9])
    q = np.concatenate([clusters(12, 4) * 3, np.zeros((1, 8))])
    monkeypatch.setattr(threshold, "BLOCK", 5)
    if not broadcast:
        monkeypatch.setattr(kernels, "BROADCAST_BYTES", 64)
    data, queries = frame(spark, x).repartition(3), as_queries(frame(spark, q))
    s = (unit(q) if normalize else q) @ unit(x).T
    expected = sorted((i, j) for i, j in zip(*np.nonzero(s > cutoff)))
    got = exact.within(queries, data, 2 - 2 * cutoff, normalize).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == expected
    assert np.allclose([2 - 2 * s[r["query_id"], r["vec_id"]] for r in got], [r["distance"] for r in got])
    top = exact.threshold_knn(queries, data, cutoff, 3, normalize)
    best = sorted((i, rank + 1, int(j)) for i in range(len(q)) for rank, j in enumerate([j for j in np.lexsort((np.arange(len(x)), -s[i].round(12))) if s[i, j] > cutoff][:3]))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in top.collect()) == best
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()


def test_threshold_skips_blocks(spark):
    x, q = unit(clusters(5000, 6)), unit(clusters(40, 6))
    pivots = unit(clusters(32, 6))
    blocks = threshold.arranged(np.arange(5000), x, pivots)
    assert sum(len(b.ids) for b in blocks) == 5000
    looked = sum(d.size for _, _, d in threshold.near_blocks(q, blocks, pivots, 0.98))
    assert looked < 0.3 * 5000 * 40
    assert threshold.arranged(np.zeros(0, int), np.zeros((0, 8)), pivots) == []
    assert exact.within(as_queries(frame(spark, q)).limit(0), frame(spark, x[:5]), 1.0).count() == exact.within(as_queries(frame(spark, q[:2])), frame(spark, x[:5]).limit(0), 1.0).count() == 0


@pytest.mark.parametrize("subspaces, codes, shortlist", [(16, 64, 60)])
def test_shortlist_ranked_again_has_recall(spark, subspaces, codes, shortlist):
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    data = vectors(spark, DATA)
    q = as_queries(data.where("vec_id % 10 = 0"))
    index = IVFIndex(64, 8, True, 8, subspaces=subspaces).train(data, seed=1, iterations=2, codes=codes, pq_iterations=10)
    truth = FlatIndexL2(64).add(data).search(q, 5, True)
    recall = metrics.recall(truth, index.search(q, 5, shortlist=shortlist)).first()["recall"]
    assert recall >= 0.9 and recall > metrics.recall(truth, index.search(q, 5)).first()["recall"]
    exact_distance = {(h[0], h[2]): h[3] for h in hits(FlatIndexL2(64).add(data).search(q, 500, True))}
    assert all(exact_distance[h[0], h[2]] == h[3] for h in hits(index.search(q, 5, shortlist=shortlist)))


def test_recall_of_a_trained_inverted_file(spark):
    """100 nearest of the given embeddings, in 7 of 8 trained cells."""
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    data = vectors(spark, DATA)
    index = IVFIndex(64, 8, nprobe=7).train(data, seed=2, iterations=5, seeding="oversampled")
    q = query_rows(data)
    assert metrics.recall(FlatIndexL2(64).add(data).search(q, 100, True), index.search(q, 100)).first()["recall"] >= 0.9


def test_draw_equals_brute_force(spark):
    x = clusters(400, 8)
    data = frame(spark, np.concatenate([x, x[:5]])).repartition(5)
    chosen = x[:3]
    u = {r[0]: r[1] for r in data.select("vec_id", (F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))).collect()}
    w = 2 - 2 * (kernels.unit(np.concatenate([x, x[:5]])) @ kernels.unit(chosen).T).max(axis=1)
    key = {k: -np.log(u[k]) / w[k] for k in range(405) if w[k] > 1e-12}
    got = kmeans.exponential_draw(data, chosen, 50, 9).collect()
    assert [r["vec_id"] for r in got] == sorted(key, key=lambda k: (key[k], k))[:50]
    assert kmeans.exponential_draw(frame(spark, x[:3]), chosen, 50, 9).count() == 0


def test_draw_follows_the_weights(spark):
    """Of 400 vectors at squared distance 2 and 400 at 0.02, a draw of 100 takes hardly any of the near ones."""
    a = np.tile([1.0, 0.0], (400, 1)) + np.linspace(0.14, 0.142, 400)[:, None] * [0, 1]
    b = np.tile([0.0, 1.0], (400, 1)) + np.linspace(0, 0.002, 400)[:, None] * [1, 0]
    got = kmeans.exponential_draw(frame(spark, np.concatenate([a, b])), np.array([[1.0, 0.0]]), 100, 4)
    assert got.where("vec_id < 400").count() <= 8


def test_oversampled_seeds(spark):
    x = clusters(600, 9, centres=10)
    data = frame(spark, x).repartition(3)
    a, b = (kmeans.to_matrix(kmeans.oversampled(data.repartition(n), 10, seed=2, rounds=3)) for n in (2, 7))
    assert np.array_equal(a, b) and all(any(np.allclose(v, y) for y in x) for v in a)
    spread = (2 - 2 * (unit(x) @ unit(a).T)).min(axis=1).mean()
    drawn = (2 - 2 * (unit(x) @ unit(x[:10]).T)).min(axis=1).mean()
    assert spread < 0.5 * drawn  # nearly every cluster has a seed
    assert len(kmeans.to_matrix(kmeans.oversampled(data, 1))) == 1
    with pytest.raises(ValueError):
        kmeans.oversampled(frame(spark, np.tile(x[:1], (50, 1))), 4)
    with pytest.raises(ValueError):
        kmeans.oversampled(data.limit(0), 4)


def naive_seeds(candidates, weights, cells, seed):
    rng = np.random.default_rng(seed)
    x, picked = kernels.unit(candidates), []
    for _ in range(cells):
        p = weights * ((2 - 2 * x @ x[picked].T).min(axis=1).clip(0) if picked else 1.0)
        p[picked] = 0.0
        picked.append(int(rng.choice(len(x), p=p / p.sum())))
    return picked


def test_seeds_equal_one_by_one_draws():
    x, w = clusters(80, 3), np.arange(1.0, 81.0)
    assert kmeans.weighted_seeds(x, w, 12, 5).tolist() == naive_seeds(x, w, 12, 5)
    assert len(set(kmeans.weighted_seeds(np.tile(x[:2], (5, 1)), np.ones(10), 6, 1).tolist())) == 6


def test_picked_seeds_equal_brute_force(spark):
    """Seeds drawn row by row: the least of -log(u) / weight each time."""
    x = clusters(100, 12)
    data = frame(spark, x)
    got = kmeans.to_matrix(kmeans.initial(data, 4, seed=6, far=2))
    first = [r["vec_id"] for r in data.orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id").limit(2).collect()]
    chosen = list(first)
    for turn in range(2):
        u = {r[0]: r[1] for r in data.select("vec_id", (F.pmod(F.xxhash64("vec_id", F.lit(7 + turn)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))).collect()}
        w = (2 - 2 * unit(x) @ unit(x[chosen]).T).min(axis=1).clip(1e-12)
        chosen.append(min((k for k in range(100) if k not in chosen), key=lambda k: (-np.log(u[k]) / w[k], k)))
    assert np.allclose(got, x[chosen])


def test_code_sums_and_codebook(spark):
    x = clusters(300, 11)
    data = frame(spark, x).repartition(4)
    book = unit(x)[:6].reshape(6, 2, 4).transpose(1, 0, 2).copy()
    parts = unit(x).reshape(300, 2, 1, 4)
    code = ((parts - book) ** 2).sum(axis=-1).argmin(axis=2)
    rows = pq.code_sums(data, book).groupBy("subspace", "code").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(d))).alias(f"t{d}") for d in range(4))).collect()
    assert {(r["subspace"], r["code"]): r["n"] for r in rows} == {(s, c): int((code[:, s] == c).sum()) for s in range(2) for c in range(6) if (code[:, s] == c).any()}
    for r in rows:
        assert np.allclose([r[f"t{d}"] for d in range(4)], unit(x).reshape(300, 2, 4)[code[:, r["subspace"]] == r["code"], r["subspace"]].sum(axis=0))
    start = spark.createDataFrame([(s, c, book[s, c].tolist()) for s in range(2) for c in range(6)], "subspace int, code int, centroid array<double>")
    one = pq.train_step(pq.subvectors(data, 8, 2), start, 4)
    assert np.allclose(pq.books(one), pq.books(pq.train_codebook(data, 8, 2, iterations=1, init=start)))
    settled = pq.books(pq.train_codebook(data, 8, 2, iterations=100, init=start))
    assert np.allclose(settled, pq.books(pq.train_codebook(data, 8, 2, iterations=101, init=start)))
    some = pq.books(pq.train_codebook(data, 8, 2, iterations=3, init=start, most_rows=100))
    assert some.shape == settled.shape and not np.allclose(some, settled)


def test_trained_random_search_and_codes_equal_brute_force(spark):
    """Searches after random training, from the index's own centroids and codebook."""
    x = clusters(200, 13)
    data = frame(spark, x).repartition(3)
    q = as_queries(data.where("vec_id % 20 = 0"))
    index = IVFIndex(8, 6, True, 2, subspaces=4).train(data, seed=3, iterations=2, codes=8, pq_iterations=3)
    c, book = unit(kmeans.to_matrix(index.centroids)), pq.books(index.codebook)
    cell = (unit(x) @ c.T).argmax(axis=1)
    part = lambda y: y.reshape(len(y), 4, 1, 2)
    table = ((part(unit(x)) - book) ** 2).sum(axis=-1)
    code = table.argmin(axis=2)
    vectors_, codes_ = [], []
    for i in range(0, 200, 20):
        probed = np.lexsort((np.arange(6), 2 - 2 * unit(x[i : i + 1])[0] @ c.T))[:2]
        rows = [j for j in range(200) if cell[j] in probed]
        d = {j: 2 - 2 * unit(x)[i] @ unit(x)[j] for j in rows}
        vectors_ += [(i, n + 1, j, round(d[j], 6)) for n, j in enumerate(sorted(rows, key=lambda j: (d[j], j))[:5])]
        a = {j: sum(table[i, s, code[j, s]] for s in range(4)) for j in rows}
        codes_ += [(i, n + 1, round(a[j], 6)) for n, j in enumerate(sorted(rows, key=lambda j: (a[j], j))[:5])]
    plain = IVFIndex(8, 6, False, 2, centroids=index.centroids).add(data)
    assert hits(plain.search(q, 5)) == vectors_
    assert [(h[0], h[1], h[3]) for h in hits(index.search(q, 5))] == codes_


def test_npy_sink(spark, tmp_path):
    x = np.random.default_rng(0).random((1000, 6)).astype(np.float32)
    rows = frame(spark, x).orderBy(F.desc("vec_id")).repartition(5)
    path = str(tmp_path / "x")
    write_npy(rows, path, part_bytes=str(6 * 4 * 100))
    assert len([f for f in os.listdir(path) if f.endswith(".npy")]) > 5
    (tmp_path / "x" / "part-000000-000000-lost.npy").write_bytes(b"of an attempt that failed")
    back = lambda: {r["vec_id"]: r["embedding"] for r in read_npy(spark, path, part_bytes="500").collect()}
    got = back()
    assert sorted(got) == list(range(1000)) and np.array_equal(np.array([got[k] for k in range(1000)], np.float32), x)
    write_npy(frame(spark, x[:10]), path)
    assert len(back()) == 1010 and np.allclose(back()[1003], x[3])
    write_npy(frame(spark, x[:7]), path, mode="overwrite", dtype="float64")
    assert len(back()) == 7
    write_npy(rows.limit(0), str(tmp_path / "none"))
    assert read_npy(spark, str(tmp_path / "none")).count() == 0
    for bad in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, None)], [(0, [None])]):
        with pytest.raises(Exception, match="same width"):
            write_npy(spark.createDataFrame(bad, SCHEMA).coalesce(1), str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad" / "_index.json")


def test_batches_of_parts(spark):
    """Angles of assigned vectors, zero rows included."""
    x = np.concatenate([clusters(20, 1), np.zeros((1, 8))])
    c = kmeans.to_frame(spark, clusters(3, 2))
    got = {r["vec_id"]: r["angle"] for r in kmeans.assign(frame(spark, x), c, with_vector=True).collect()}
    cosine = (unit(x) @ unit(clusters(3, 2)).T).max(axis=1)
    assert all(abs(got[k] - np.arccos(min(1, cosine[k]))) < 1e-6 for k in range(20)) and got[20] == np.pi
    assert kernels.matrix(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
