"""The registered queries over the driver's tables, and their DuckDB SQL.

Vectors are scaled by 1 + vec_id % 7, since the stored ones have norm 1 and
would hide where normalization matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import argmax, distance_of, dot, l2_normalize, squared_l2, vector_add
from nearfield.operators import exact, ivf, kmeans, metrics, pq, topk
from nearfield.plans import FlatIndexL2, IVFIndex
from nearfield.scratch import shared_folder
from nearfield.sources import random_bytes, random_vectors, read_npy, write_npy

DIM, QUERIES, K, CELLS, CODES, SUBSPACES = 64, 100, 5, 16, 32, 4
WIDTH = DIM // SUBSPACES
#: Candidates by codes that are ranked again, and rows of a file of the indexes that queries store.
SHORTLIST, ROWS_PER_FILE = 50, 4096


def _r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 7))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", scaled.alias("embedding"))


def query_rows(data: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by QUERIES."""
    return data.where(F.col("vec_id") % QUERIES == 0).withColumnRenamed("vec_id", "query_id")


def first_centroids(data: DataFrame, cells: int = CELLS) -> DataFrame:
    return data.where(F.col("vec_id") < cells).select(F.col("vec_id").cast("int").alias("cell"), F.col("embedding").alias("centroid"))


def first_codebook(data: DataFrame) -> DataFrame:
    parts = pq.subvectors(data.where(F.col("vec_id") < CODES), DIM, SUBSPACES)
    return parts.select("subspace", F.col("vec_id").cast("int").alias("code"), F.col("part").alias("centroid"))


def _hits(df: DataFrame, value: str = "distance") -> DataFrame:
    return df.select("query_id", "rank", "vec_id", _r(value).alias(value))


def _long(df: DataFrame, array: str, keys: list[str], name: str = "value") -> DataFrame:
    """Elements of an array as rows, for results that are compared by value."""
    rows = df.select(*keys, F.posexplode(array).alias("pos", "x"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), _r("x").alias(name))


def _pairs(data: DataFrame) -> DataFrame:
    """Each vector beside vector 0."""
    one = data.where("vec_id = 0").select(F.col("embedding").alias("b"))
    return data.withColumnRenamed("embedding", "a").join(F.broadcast(one), how="cross")


def _bytes(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor((x + 1) * 127.5).cast("int"))


def _indexed(s: SparkSession, d: str, n_probe: int = 3) -> tuple[DataFrame, IVFIndex]:
    data = vectors(s, d)
    index = IVFIndex(DIM, CELLS, nprobe=n_probe)
    return data, index.train(data, init=first_centroids(data), iterations=0)


def _trained(s: SparkSession, d: str) -> DataFrame:
    """Search in an index after two rounds of training from given centroids."""
    data = vectors(s, d)
    index = IVFIndex(DIM, 8, nprobe=3).train(data, init=first_centroids(data, 8), iterations=2)
    return _hits(index.search(query_rows(data), K))


def _ivf_codes(s: SparkSession, d: str, scoring: str) -> DataFrame:
    """Search of codes in cells, with given centroids and codebook."""
    data, book = _pq_parts(s, d)
    index = IVFIndex(DIM, CELLS, True, 4, centroids=first_centroids(data), codebook=book).add(data)
    return _hits(index.search(query_rows(data), K, scoring=scoring))


def _eight(s: SparkSession, d: str, n_probe: int = 3) -> tuple[DataFrame, IVFIndex]:
    """An index of eight cells after two rounds of training from given centroids."""
    data = vectors(s, d)
    return data, IVFIndex(DIM, 8, nprobe=n_probe).train(data, init=first_centroids(data, 8), iterations=2)


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Train, store, load, search."""
    data, index = _eight(s, d)
    path = shared_folder(s, "index")
    index.save(path, ROWS_PER_FILE)
    return _hits(IVFIndex.load(s, path, nprobe=3).search(query_rows(data), K))


def _appended(s: SparkSession, d: str) -> DataFrame:
    """Store a part of the vectors, load, add the rest, store again, load, search."""
    data, index = _eight(s, d)
    path = shared_folder(s, "index")
    odd = F.col("vec_id") % 2 == 1
    IVFIndex(DIM, 8, centroids=index.centroids).add(data.where(odd)).save(path, ROWS_PER_FILE)
    IVFIndex.load(s, path).add(data.where(~odd)).save(path, ROWS_PER_FILE)
    return _hits(IVFIndex.load(s, path, nprobe=3).search(query_rows(data), K))


def _exact_from_index(s: SparkSession, d: str) -> DataFrame:
    """The k nearest of all vectors from the cells that can hold them."""
    data, index = _eight(s, d)
    return _hits(index.save(shared_folder(s, "index"), ROWS_PER_FILE).search_exact(query_rows(data), K))


def _feature_index(s: SparkSession, d: str) -> tuple[DataFrame, IVFIndex]:
    """A stored index of the parts' features in 32 cells, from oversampled seeds."""
    data = features(s, d)
    return data, IVFIndex(4, 32).train(data, seed=5, iterations=3, seeding="oversampled").save(shared_folder(s, "index"), ROWS_PER_FILE)


def _exact_features(s: SparkSession, d: str) -> DataFrame:
    """The nearest parts by features, from the few cells that can hold them."""
    data, index = _feature_index(s, d)
    return _hits(index.search_exact(data.where(F.col("vec_id") % QUERIES == 0).withColumnRenamed("vec_id", "query_id"), K))


def _cells_needed(s: SparkSession, d: str) -> DataFrame:
    """How many of the eight cells an exact search reads for each query."""
    data, index = _eight(s, d)
    return index.cells_needed(query_rows(data), K).groupBy("query_id").agg(F.count("*").alias("cells"))


def _recall_100(s: SparkSession, d: str) -> DataFrame:
    data, index = _eight(s, d, 7)
    q = query_rows(data)
    return metrics.recall(FlatIndexL2(DIM).add(data).search(q, 100, True), index.search(q, 100)).select(_r("recall").alias("recall"))


def _rerank(s: SparkSession, d: str) -> DataFrame:
    """A shortlist by codes, ranked again by the vectors."""
    data, book = _pq_parts(s, d)
    index = IVFIndex(DIM, CELLS, True, 4, centroids=first_centroids(data), codebook=book).add(data)
    return _hits(index.search(query_rows(data), K, shortlist=SHORTLIST))


def _train_rounds(s: SparkSession, d: str) -> DataFrame:
    """The codebook after two rounds of one pass each."""
    data, book = _pq_parts(s, d)
    moved = pq.train_codebook(data, DIM, SUBSPACES, iterations=2, init=book)
    return _long(moved.select(F.col("subspace").cast("long").alias("subspace"), F.col("code").cast("long").alias("code"), "centroid"), "centroid", ["subspace", "code"])


def _npy(s: SparkSession, d: str) -> DataFrame:
    """The embeddings, written as .npy files and read back."""
    path = shared_folder(s, "npy")
    write_npy(s.read.parquet(f"{d}/embeddings.parquet"), path)
    return _long(read_npy(s, path).select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", ["vec_id"])


def features(s: SparkSession, d: str) -> DataFrame:
    """A vector of four largest values per part of lineitem."""
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("vec_id"))
    found = rows.agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("x"), F.max("l_tax").alias("t"))
    return found.select("vec_id", F.array(F.col("q") / 50, F.col("p") / 100000, F.col("x") * 10, F.col("t") * 12.5).alias("embedding"))


def _pq_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    data = vectors(s, d)
    return data, first_codebook(data)


def _codes(data: DataFrame, book: DataFrame) -> DataFrame:
    return pq.encode(data, book, DIM, SUBSPACES)


def _ivf_exact_recall(s: SparkSession, d: str) -> DataFrame:
    data, index = _indexed(s, d)
    q = query_rows(data)
    return metrics.recall(FlatIndexL2(DIM).add(data).search(q, K, True), index.search(q, K)).select(_r("recall").alias("recall"))


def _kmeans_assign(s: SparkSession, d: str) -> DataFrame:
    data = vectors(s, d)
    return kmeans.assign(data, kmeans.train(data, first_centroids(data, 8), iterations=2)).select("vec_id", F.col("cell").cast("long").alias("cell"))


def _kmeans_step(s: SparkSession, d: str) -> DataFrame:
    data = vectors(s, d)
    return _long(kmeans.step(data, first_centroids(data), DIM).withColumn("cell", F.col("cell").cast("long")), "centroid", ["cell"])


def _shift(s: SparkSession, d: str) -> DataFrame:
    data = vectors(s, d)
    start = first_centroids(data)
    return metrics.centroid_shift(start, kmeans.step(data, start, DIM)).select(_r("shift").alias("shift"))


def _sums(s: SparkSession, d: str) -> DataFrame:
    data = vectors(s, d)
    unit = data.select("vec_id", l2_normalize("embedding").alias("embedding"))
    found = kmeans.cluster_sums(exact.nearest_centroid(unit, first_centroids(data), keep=("embedding",)), DIM)
    return _long(found.withColumn("cell", F.col("cell").cast("long")), "total", ["cell", "n"])


def _train_step(s: SparkSession, d: str) -> DataFrame:
    data, book = _pq_parts(s, d)
    moved = pq.train_step(pq.subvectors(data, DIM, SUBSPACES), book, WIDTH)
    return _long(moved.select(F.col("subspace").cast("long").alias("subspace"), F.col("code").cast("long").alias("code"), "centroid"), "centroid", ["subspace", "code"])


def _nested_text(df: DataFrame) -> DataFrame:
    """Nested hits as one row per query: number, first id, sum of distances."""
    return df.select("query_id", F.size("hits").cast("long").alias("n"), F.array_join(F.transform("hits", lambda h: h["vec_id"].cast("string")), ",").alias("ids"), _r(F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["distance"])).alias("total"))


def _split_rows(s: SparkSession, d: str) -> DataFrame:
    data = vectors(s, d)
    both = topk.split(FlatIndexL2(DIM).add(data).search(query_rows(data), K))
    return both.select("query_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("ids"), _r(F.aggregate("distances", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def _flat(s: SparkSession, d: str, normalize: bool = False, kernel: str = "gemm") -> DataFrame:
    data = vectors(s, d)
    return _hits(FlatIndexL2(DIM).add(data).search(query_rows(data), K, normalize, kernel))


def _with_data(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(vectors(s, d))


def _adc(s: SparkSession, d: str) -> DataFrame:
    data, book = _pq_parts(s, d)
    return _hits(pq.adc(query_rows(data), _codes(data, book), book, K, DIM, SUBSPACES))


def _code_dot(s: SparkSession, d: str) -> DataFrame:
    data, book = _pq_parts(s, d)
    codes = _codes(data, book)
    return _hits(pq.code_dot(codes.where(F.col("vec_id") % QUERIES == 0).withColumnRenamed("vec_id", "query_id"), codes, K))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made vector of floats and one of bytes for every given vector's id."""
    ids = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    made = [make(spark, ids, DIM, 5).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")) for make in (random_vectors, random_bytes)]
    return made[0].unionByName(made[1])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """A function of (spark, sf_dir) for each operator."""
    return {
        "l2_normalize": _with_data(lambda v: _long(v.select("vec_id", l2_normalize("embedding").alias("e")), "e", ["vec_id"])),
        "squared_l2": _with_data(lambda v: _pairs(v).select("vec_id", _r(squared_l2("a", "b")).alias("value"))),
        "vector_add": _with_data(lambda v: _long(_pairs(v).select("vec_id", vector_add("a", "b").alias("e")), "e", ["vec_id"])),
        "dot_product": _with_data(lambda v: _pairs(v).select("vec_id", _r(dot("a", "b")).alias("value"))),
        "distance_from_similarity": _with_data(lambda v: _pairs(v).select("vec_id", _r(distance_of(dot(l2_normalize("a"), l2_normalize("b")))).alias("distance"))),
        "u8_dot": lambda s, d: _pairs(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", _bytes(F.col("embedding").cast("array<double>")).alias("embedding"))).select("vec_id", dot("a", "b").cast("long").alias("value")),
        "vector_argmax": _with_data(lambda v: v.select("vec_id", argmax("embedding").alias("pos"))),
        "filter_below": lambda s, d: exact.filter_below(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", 10.0).groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least")),
        "range_search": _with_data(lambda v: exact.within(query_rows(v), v, 1.5).select("query_id", "vec_id", _r("distance").alias("distance"))),
        "threshold_topk": _with_data(lambda v: _hits(exact.threshold_knn(query_rows(v), v, 0.2, K, True), "similarity")),
        "flat_knn_raw_query": _flat,
        "flat_knn_normalized": lambda s, d: _flat(s, d, True),
        "flat_knn_expression": lambda s, d: _flat(s, d, True, "expression"),
        "knn_self_join": _with_data(lambda v: _hits(exact.self_knn(v, K))),
        "knn_nested": _with_data(lambda v: _nested_text(topk.nested(FlatIndexL2(DIM).add(v).search(query_rows(v), K)))),
        "knn_split": _split_rows,
        "knn_exploded": _with_data(lambda v: _hits(topk.exploded(topk.split(FlatIndexL2(DIM).add(v).search(query_rows(v), K))))),
        "pair_sort": _with_data(lambda v: exact.ranked_pairs(query_rows(v), v, True, with_distance=False).select("query_id", "rank", "vec_id")),
        "nearest_centroid": _with_data(lambda v: exact.nearest_centroid(v, first_centroids(v)).select("vec_id", F.col("cell").cast("long").alias("cell"))),
        "min_centroid_distance": _with_data(lambda v: exact.min_centroid_distance(v, first_centroids(v)).select("vec_id", _r("distance").alias("distance"))),
        "cluster_sum_count": _sums,
        "kmeans_step": _kmeans_step,
        "kmeans_assign": _kmeans_assign,
        "centroid_shift": _shift,
        "ivf_search": lambda s, d: (lambda v, i: _hits(i.search(query_rows(v), K)))(*_indexed(s, d)),
        "ivf_search_auto": lambda s, d: (lambda v, i: _hits(i.search_auto(query_rows(v), K, 1.5)))(*_indexed(s, d)),
        "ivf_search_radius": lambda s, d: (lambda v, i: _hits(i.search_auto(query_rows(v), K)))(*_indexed(s, d)),
        "ivf_padded": lambda s, d: (lambda v, i: _nested_text(i.search(query_rows(v), 40, padded_form=True)))(*_indexed(s, d, 1)),
        "ivf_trained_search": _trained,
        "ivf_stored_search": _stored,
        "ivf_appended_search": _appended,
        "ivf_exact_search": _exact_from_index,
        "ivf_cells_needed": _cells_needed,
        "feature_exact_search": _exact_features,
        "ivf_recall_at_100": _recall_100,
        "ivf_pq_rerank": _rerank,
        "pq_train_rounds": _train_rounds,
        "npy_round_trip": _npy,
        "kmeans_oversampled": _with_data(lambda v: kmeans.oversampled(v, CELLS, seed=3)),
        "ivf_pq_adc": lambda s, d: _ivf_codes(s, d, "adc"),
        "ivf_pq_code_dot": lambda s, d: _ivf_codes(s, d, "code_dot"),
        "recall_at_k": _ivf_exact_recall,
        "pq_encode": lambda s, d: (lambda v, b: _codes(v, b).select("vec_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes")))(*_pq_parts(s, d)),
        "pq_code_count": lambda s, d: (lambda v, b: pq.encode_parts(pq.subvectors(v, DIM, SUBSPACES), b).groupBy(F.col("subspace").cast("long").alias("subspace"), F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n")))(*_pq_parts(s, d)),
        "pq_code_dot": _code_dot,
        "pq_adc": _adc,
        "pq_train_step": _train_step,
        "feature_knn": lambda s, d: (lambda f: _hits(exact.knn(f.where(F.col("vec_id") % QUERIES == 0).withColumnRenamed("vec_id", "query_id"), f, K, True)))(features(s, d)),
        "kmeanspp_init": _with_data(lambda v: kmeans.initial(v, CELLS, seed=3, far=2)),
        "ivf_train_random": _with_data(lambda v: IVFIndex(DIM, CELLS, nprobe=4).train(v, seed=3).search(query_rows(v), K)),
        "ivf_pq_search": _with_data(lambda v: IVFIndex(DIM, CELLS, True, 4).train(v, init=first_centroids(v), iterations=2, codes=16, pq_iterations=3).search(query_rows(v), K)),
        "generate_vectors": _generated,
    }


_V = """v AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 7)) AS e FROM embeddings)"""
_U = _V + """, u AS MATERIALIZED (SELECT vec_id, e, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS n FROM v)"""
_ROUND = "round({0}, 6) + 0.0"


def _knn_sql(left: str = "n", k: int = K, where: str = "TRUE", pairs: str = "") -> str:
    """CTEs that end in ``h``: query_id, rank, vec_id, d."""
    pairs = pairs or f"SELECT q.vec_id AS query_id, x.vec_id, 2 - 2 * list_dot_product(q.{left}, x.n) AS d FROM u q, u x WHERE q.vec_id % {QUERIES} = 0"
    return f"{_U}, p AS ({pairs}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p WHERE {where}), h AS (SELECT * FROM r WHERE rank <= {k})"


def _hits_sql(ctes: str) -> str:
    return f"WITH {ctes} SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, {_ROUND.format('d')} AS distance FROM h"


def _elements(ctes: str, rows: str, keys: str) -> str:
    """Elements of the list ``e`` of ``rows`` as rows."""
    return f"WITH {ctes}, rows AS ({rows}) SELECT {keys}, CAST(i - 1 AS BIGINT) AS pos, {_ROUND.format('e[i]')} AS value FROM rows, range(1, len(e) + 1) t(i)"


_CENTROIDS = f"c AS (SELECT vec_id AS cell, n FROM u WHERE vec_id < {CELLS})"
_SIMILAR = f"{_CENTROIDS}, s AS (SELECT u.vec_id, c.cell, list_dot_product(u.n, c.n) AS s FROM u, c)"
_CELL = f"{_SIMILAR}, a AS MATERIALIZED (SELECT vec_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) AS k FROM s) WHERE k = 1)"


def _sums_of(a: str, name: str) -> str:
    """Per cell and element the sum of the normalized vectors."""
    return f"{name} AS MATERIALIZED (SELECT cell, i, count(*) AS n, sum(u.n[i]) AS t FROM {a} JOIN u USING (vec_id), range(1, {DIM + 1}) g(i) GROUP BY ALL)"


def _step_sql(cells: str, sums: str, name: str, rate: float) -> str:
    """Damped step from ``cells`` (cell, e)."""
    return f"""{name} AS MATERIALIZED (SELECT c.cell, list(c.e[i] + {rate} * (coalesce(t, 0) / (coalesce(n, 0) + 1e-9) - c.e[i]) ORDER BY i) AS e
      FROM {cells} c CROSS JOIN range(1, {DIM + 1}) g(i) LEFT JOIN {sums} USING (cell, i) GROUP BY c.cell)"""


def _assign_sql(cells: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT vec_id, cell FROM (SELECT u.vec_id, c.cell, row_number() OVER (PARTITION BY u.vec_id
      ORDER BY list_dot_product(u.n, list_transform(c.e, lambda x: x / (sqrt(list_dot_product(c.e, c.e)) + 1e-8))) DESC, c.cell) AS k FROM u, {cells} c) WHERE k = 1)"""


def _ivf_sql(probe: str, k: int = K) -> str:
    pairs = f"SELECT b.vec_id AS query_id, x.vec_id, 2 - 2 * list_dot_product(q.n, x.n) AS d FROM b JOIN u q ON q.vec_id = b.vec_id JOIN a ON a.cell = b.cell JOIN u x ON x.vec_id = a.vec_id"
    probes = f"b AS (SELECT vec_id, cell FROM (SELECT *, 2 - 2 * s AS cd, row_number() OVER (PARTITION BY vec_id ORDER BY 2 - 2 * s, cell) AS k FROM s WHERE vec_id % {QUERIES} = 0) WHERE {probe})"
    return f"{_U}, {_CELL}, {probes}, p AS ({pairs}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p), h AS (SELECT * FROM r WHERE rank <= {k})"


_PARTS = f"w AS MATERIALIZED (SELECT vec_id, s AS subspace, list_slice(n, s * {WIDTH} + 1, (s + 1) * {WIDTH}) AS e FROM u, range({SUBSPACES}) g(s))"
_BOOK = f"{_PARTS}, b AS (SELECT subspace, vec_id AS code, e AS c FROM w WHERE vec_id < {CODES})"
_D2 = "list_sum(list_transform(range(1, len(w.e) + 1), lambda i: (w.e[i] - b.c[i]) * (w.e[i] - b.c[i])))"
_CODED = f"{_BOOK}, dist AS MATERIALIZED (SELECT w.vec_id, w.subspace, b.code, {_D2} AS d FROM w JOIN b USING (subspace)), o AS MATERIALIZED (SELECT vec_id, subspace, code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, subspace ORDER BY d, code) AS k FROM dist) WHERE k = 1)"
_PROBED = f"{_SIMILAR}, a AS MATERIALIZED (SELECT vec_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) AS k FROM s) WHERE k = 1), b4 AS MATERIALIZED (SELECT vec_id AS query_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY 2 - 2 * s, cell) AS k FROM s WHERE vec_id % {QUERIES} = 0) WHERE k <= 4)"
_RANKED = f"h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) WHERE rank <= {K}) SELECT query_id, rank, vec_id, {_ROUND.format('d')} AS distance FROM h"
_IDS = "string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank)"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the rows of those queries."""
    pair = "SELECT a.vec_id, a.e AS a, b.e AS b, a.n AS an, b.n AS bn FROM u a, u b WHERE b.vec_id = 0"
    one = lambda x, name="value": f"WITH {_U}, pr AS ({pair}) SELECT vec_id, {_ROUND.format(x)} AS {name} FROM pr"
    features_ = "f AS (SELECT l_partkey AS vec_id, [max(l_quantity) / 50, max(l_extendedprice) / 100000, max(l_discount) * 10, max(l_tax) * 12.5] AS e FROM lineitem GROUP BY l_partkey), u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS n FROM f)"
    stepped = f"{_U}, {_CELL}, {_sums_of('a', 'm')}, c0 AS (SELECT vec_id AS cell, e FROM u WHERE vec_id < {CELLS}), {_step_sql('c0', 'm', 'c1', 0.9)}"
    eight = f"{_U}, c0 AS (SELECT vec_id AS cell, e FROM u WHERE vec_id < 8), {_assign_sql('c0', 'a0')}, {_sums_of('a0', 'm0')}, {_step_sql('c0', 'm0', 'c1', 0.9)}, {_assign_sql('c1', 'a1')}, {_sums_of('a1', 'm1')}, {_step_sql('c1', 'm1', 'c2', 0.81)}, {_assign_sql('c2', 'a2')}"
    unit = lambda e: f"list_transform({e}, lambda x: x / (sqrt(list_dot_product({e}, {e})) + 1e-8))"
    trained = lambda probed: f"{eight}, c3 AS (SELECT cell, {unit('e')} AS n FROM c2), s3 AS MATERIALIZED (SELECT u.vec_id AS query_id, c3.cell, list_dot_product(u.n, c3.n) AS s, row_number() OVER (PARTITION BY u.vec_id ORDER BY 2 - 2 * list_dot_product(u.n, c3.n), c3.cell) AS k FROM u, c3 WHERE u.vec_id % {QUERIES} = 0), p AS MATERIALIZED (SELECT s3.query_id, x.vec_id, 2 - 2 * list_dot_product(q.n, x.n) AS d FROM s3 JOIN u q ON q.vec_id = s3.query_id JOIN a2 ON a2.cell = s3.cell JOIN u x ON x.vec_id = a2.vec_id WHERE s3.k <= {probed})"
    ranked = lambda k: f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p QUALIFY rank <= {k}"
    feature_knn = f"WITH {features_}, p AS (SELECT q.vec_id AS query_id, x.vec_id, 2 - 2 * list_dot_product(q.n, x.n) AS d FROM u q, u x WHERE q.vec_id % {QUERIES} = 0), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) WHERE rank <= {K}) SELECT query_id, rank, vec_id, {_ROUND.format('d')} AS distance FROM h"
    nested = f"SELECT query_id, count(*) AS n, {_IDS} AS ids, {_ROUND.format('sum(d)')} AS total FROM h GROUP BY query_id"
    return {
        "l2_normalize": _elements(_U, "SELECT vec_id, n AS e FROM u", "vec_id"),
        "squared_l2": one("list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i])))"),
        "vector_add": _elements(f"{_U}, pr AS ({pair})", "SELECT vec_id, list_transform(range(1, len(a) + 1), lambda i: a[i] + b[i]) AS e FROM pr", "vec_id"),
        "dot_product": one("list_dot_product(a, b)"),
        "distance_from_similarity": one("2 - 2 * list_dot_product(an, bn)", "distance"),
        "u8_dot": "WITH y AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor((x + 1) * 127.5)) AS e FROM embeddings) SELECT a.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS value FROM y a, y b WHERE b.vec_id = 0",
        "vector_argmax": f"WITH {_V} SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS pos FROM v",
        "filter_below": "SELECT l_partkey, count(*) AS n, min(l_quantity) AS least FROM lineitem WHERE l_quantity < 10 GROUP BY l_partkey",
        "range_search": f"WITH {_knn_sql(where='d < 1.5', k=1 << 30)} SELECT query_id, vec_id, {_ROUND.format('d')} AS distance FROM h",
        "threshold_topk": f"WITH {_knn_sql(where='1 - d / 2 > 0.2')} SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, {_ROUND.format('1 - d / 2')} AS similarity FROM h",
        "flat_knn_raw_query": _hits_sql(_knn_sql("e")),
        "flat_knn_normalized": _hits_sql(_knn_sql()),
        "flat_knn_expression": _hits_sql(_knn_sql()),
        "knn_self_join": _hits_sql(_knn_sql(pairs="SELECT q.vec_id AS query_id, x.vec_id, 2 - 2 * list_dot_product(q.n, x.n) AS d FROM u q, u x")),
        "knn_nested": f"WITH {_knn_sql('e')} {nested}",
        "knn_split": f"WITH {_knn_sql('e')} SELECT query_id, ids, total FROM ({nested})",
        "knn_exploded": _hits_sql(_knn_sql("e")),
        "pair_sort": f"WITH {_U} SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 2 - 2 * list_dot_product(q.n, x.n) DESC, x.vec_id) AS rank FROM u q, u x WHERE q.vec_id % {QUERIES} = 0",
        "nearest_centroid": f"WITH {_U}, {_CELL} SELECT vec_id, cell FROM a",
        "min_centroid_distance": f"WITH {_U}, {_SIMILAR} SELECT vec_id, {_ROUND.format('least(4.0, min(2 - 2 * s))')} AS distance FROM s GROUP BY vec_id",
        "cluster_sum_count": f"WITH {_U}, {_CELL}, {_sums_of('a', 'm')} SELECT cell, n, CAST(i - 1 AS BIGINT) AS pos, {_ROUND.format('t')} AS value FROM m",
        "kmeans_step": _elements(stepped, "SELECT cell, e FROM c1", "cell"),
        "kmeans_assign": f"WITH {eight} SELECT vec_id, cell FROM a2",
        "centroid_shift": f"WITH {stepped} SELECT {_ROUND.format('avg(abs(c0.e[i] - c1.e[i]))')} AS shift FROM c0 JOIN c1 USING (cell), range(1, {DIM + 1}) z(i)",
        "ivf_search": _hits_sql(_ivf_sql("k <= 3")),
        "ivf_search_auto": _hits_sql(_ivf_sql("cd <= 1.5")),
        "ivf_search_radius": _hits_sql(_ivf_sql("cd <= 0.45")),
        "ivf_padded": f"WITH {_ivf_sql('k <= 1', 40)} SELECT q.vec_id AS query_id, CAST(40 AS BIGINT) AS n, concat_ws(',', nullif(rtrim(repeat('0,', CAST(40 - count(h.vec_id) AS INT)), ','), ''), string_agg(CAST(h.vec_id AS VARCHAR), ',' ORDER BY rank)) AS ids, {_ROUND.format('coalesce(sum(d), 0)')} AS total FROM (SELECT vec_id FROM u WHERE vec_id % {QUERIES} = 0) q LEFT JOIN h ON h.query_id = q.vec_id GROUP BY q.vec_id",
        "recall_at_k": f"WITH {_ivf_sql('k <= 3')}, e1 AS (SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 2 - 2 * list_dot_product(q.n, x.n), x.vec_id) AS k FROM u q, u x WHERE q.vec_id % {QUERIES} = 0) SELECT {_ROUND.format(f'count(h.vec_id) / ({K}.0 * count(DISTINCT e1.query_id))')} AS recall FROM e1 LEFT JOIN h ON h.query_id = e1.query_id AND h.vec_id = e1.vec_id WHERE e1.k <= {K}",
        "pq_encode": f"WITH {_U}, {_CODED} SELECT vec_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY subspace) AS codes FROM o GROUP BY vec_id",
        "pq_code_count": f"WITH {_U}, {_CODED} SELECT subspace, code, count(*) AS n FROM o GROUP BY ALL",
        "pq_code_dot": f"WITH {_U}, {_CODED}, p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(2 - 2 * sum(q.code * x.code) AS DOUBLE) AS d FROM o q JOIN o x USING (subspace) WHERE q.vec_id % {QUERIES} = 0 GROUP BY ALL), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) WHERE rank <= {K}) SELECT query_id, rank, vec_id, d + 0.0 AS distance FROM h",
        "pq_adc": f"WITH {_U}, {_CODED}, p AS (SELECT q.vec_id AS query_id, x.vec_id, list_sum(list(q.d ORDER BY subspace)) AS d FROM dist q JOIN o x USING (subspace, code) WHERE q.vec_id % {QUERIES} = 0 GROUP BY ALL), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) WHERE rank <= {K}) SELECT query_id, rank, vec_id, {_ROUND.format('d')} AS distance FROM h",
        "ivf_trained_search": f"WITH {eight}, c3 AS (SELECT cell, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS n FROM c2), b3 AS (SELECT vec_id AS query_id, cell FROM (SELECT u.vec_id, c3.cell, row_number() OVER (PARTITION BY u.vec_id ORDER BY 2 - 2 * list_dot_product(u.n, c3.n), c3.cell) AS k FROM u, c3 WHERE u.vec_id % {QUERIES} = 0) WHERE k <= 3), p AS (SELECT b3.query_id, x.vec_id, 2 - 2 * list_dot_product(q.n, x.n) AS d FROM b3 JOIN u q ON q.vec_id = b3.query_id JOIN a2 ON a2.cell = b3.cell JOIN u x ON x.vec_id = a2.vec_id), {_RANKED}",
        "ivf_stored_search": f"WITH {trained(3)}, {_RANKED}",
        "ivf_appended_search": f"WITH {trained(3)}, {_RANKED}",
        "ivf_exact_search": _hits_sql(_knn_sql()),
        "ivf_cells_needed": f"WITH {trained(3)}, l AS (SELECT query_id, max(d) AS far FROM ({ranked(K)}) GROUP BY query_id HAVING count(*) = {K}), w AS (SELECT a2.cell, max(acos(least(1, greatest(-1, list_dot_product(u.n, c3.n) / sqrt(list_dot_product(u.n, u.n)))))) AS r FROM a2 JOIN u USING (vec_id) JOIN c3 USING (cell) GROUP BY a2.cell) SELECT s3.query_id, count(*) AS cells FROM s3 JOIN w USING (cell) LEFT JOIN l USING (query_id) WHERE far IS NULL OR 2 - 2 * cos(greatest(0, acos(least(1, greatest(-1, s))) - r - 1e-6)) <= far GROUP BY s3.query_id",
        "ivf_recall_at_100": f"WITH {trained(7)}, h AS ({ranked(100)}), e1 AS (SELECT q.vec_id AS query_id, x.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 2 - 2 * list_dot_product(q.n, x.n), x.vec_id) AS k FROM u q, u x WHERE q.vec_id % {QUERIES} = 0 QUALIFY k <= 100), n1 AS (SELECT e1.query_id, count(h.vec_id) / count(*) AS share FROM e1 LEFT JOIN h ON h.query_id = e1.query_id AND h.vec_id = e1.vec_id GROUP BY e1.query_id) SELECT {_ROUND.format('avg(share)')} AS recall FROM n1",
        "ivf_pq_rerank": f"WITH {_U}, {_CODED}, {_PROBED}, p0 AS (SELECT b4.query_id, x.vec_id, list_sum(list(q.d ORDER BY q.subspace)) AS d FROM b4 JOIN a USING (cell) JOIN o x ON x.vec_id = a.vec_id JOIN dist q ON q.vec_id = b4.query_id AND q.subspace = x.subspace AND q.code = x.code GROUP BY ALL), sl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM p0 QUALIFY k <= {SHORTLIST}), p AS (SELECT sl.query_id, sl.vec_id, 2 - 2 * list_dot_product(q.n, x.n) AS d FROM sl JOIN u q ON q.vec_id = sl.query_id JOIN u x ON x.vec_id = sl.vec_id), {_RANKED}",
        "pq_train_rounds": f"WITH {_U}, {_CODED}, t AS (SELECT subspace, o.code, i, avg(w.e[i]) AS x FROM o JOIN w USING (vec_id, subspace), range(1, {WIDTH + 1}) g(i) GROUP BY ALL), b1 AS MATERIALIZED (SELECT b.subspace, b.code, list(coalesce(t.x, b.c[g.i]) ORDER BY g.i) AS c FROM b CROSS JOIN range(1, {WIDTH + 1}) g(i) LEFT JOIN t ON t.subspace = b.subspace AND t.code = b.code AND t.i = g.i GROUP BY ALL), o1 AS MATERIALIZED (SELECT w.vec_id, w.subspace, b1.code FROM w JOIN b1 USING (subspace) QUALIFY row_number() OVER (PARTITION BY w.vec_id, w.subspace ORDER BY {_D2.replace('b.c', 'b1.c')}, b1.code) = 1), t1 AS (SELECT subspace, o1.code, i, avg(w.e[i]) AS x FROM o1 JOIN w USING (vec_id, subspace), range(1, {WIDTH + 1}) g(i) GROUP BY ALL) SELECT b1.subspace, b1.code, CAST(g.i - 1 AS BIGINT) AS pos, {_ROUND.format('coalesce(t1.x, b1.c[g.i])')} AS value FROM b1 CROSS JOIN range(1, {WIDTH + 1}) g(i) LEFT JOIN t1 ON t1.subspace = b1.subspace AND t1.code = b1.code AND t1.i = g.i",
        "npy_round_trip": f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, {_ROUND.format('e[i]')} AS value FROM v, range(1, len(e) + 1) t(i)",
        "ivf_pq_adc": f"WITH {_U}, {_CODED}, {_PROBED}, p AS (SELECT b4.query_id, x.vec_id, list_sum(list(q.d ORDER BY q.subspace)) AS d FROM b4 JOIN a USING (cell) JOIN o x ON x.vec_id = a.vec_id JOIN dist q ON q.vec_id = b4.query_id AND q.subspace = x.subspace AND q.code = x.code GROUP BY ALL), {_RANKED}",
        "ivf_pq_code_dot": f"WITH {_U}, {_CODED}, {_PROBED}, p AS (SELECT b4.query_id, x.vec_id, CAST(2 - 2 * sum(q.code * x.code) AS DOUBLE) AS d FROM b4 JOIN a USING (cell) JOIN o x ON x.vec_id = a.vec_id JOIN o q ON q.vec_id = b4.query_id AND q.subspace = x.subspace GROUP BY ALL), {_RANKED}",
        "pq_train_step": f"WITH {_U}, {_CODED}, t AS (SELECT subspace, o.code, i, avg(w.e[i]) AS x FROM o JOIN w USING (vec_id, subspace), range(1, {WIDTH + 1}) g(i) GROUP BY ALL) SELECT b.subspace, b.code, CAST(g.i - 1 AS BIGINT) AS pos, {_ROUND.format('coalesce(t.x, b.c[g.i])')} AS value FROM b CROSS JOIN range(1, {WIDTH + 1}) g(i) LEFT JOIN t ON t.subspace = b.subspace AND t.code = b.code AND t.i = g.i",
        "feature_exact_search": feature_knn,
        "feature_knn": feature_knn,
    }
