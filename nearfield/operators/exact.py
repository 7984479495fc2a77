"""Exact nearest neighbours and the other joins by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import distance_of, dot, l2_normalize
from nearfield.operators.kernels import BROADCAST_BYTES, all_ranked, few, gemm_topk
from nearfield.operators.threshold import range_scan
from nearfield.operators.threshold import threshold_topk as scan_threshold
from nearfield.operators.topk import top_k

RADIUS = 0.45


def small(df: DataFrame, dim: int = 64) -> DataFrame:
    """A broadcast hint, if the rows are few enough for one; else the frame as it is."""
    most = BROADCAST_BYTES // (8 * dim)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _elements(df: DataFrame, keep: list[str], v: Column, dim: int, name: str) -> DataFrame:
    """The columns to keep, one for each element, and ``two``, which is null unless there are ``dim`` elements and none is null."""
    rows = df.select(*keep, v.alias("v"))
    whole = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull())
    return rows.select(*keep, F.when(whole, 2.0).alias(f"{name}_two"), *(F.coalesce(F.get("v", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"{name}{i}") for i in range(dim)))


def distances(queries: DataFrame, data: DataFrame, normalize_query: bool = False, most: str | None = None) -> DataFrame:
    """Every query's distance to every vector: the plain form, for small or filtered inputs.

    Elements are columns that can't be null, so that Spark compiles the sum of
    products: higher-order functions over two arrays aren't compiled. The data
    is dealt out first, since a few files may hold many vectors. With ``most``,
    a column of the queries, only distances that aren't larger.
    """
    first = queries.select(F.size("embedding").alias("d")).first()
    dim = max(0, first["d"]) if first and first["d"] is not None else 0
    q = l2_normalize("embedding") if normalize_query else F.col("embedding")
    left = _elements(queries, ["query_id"] if most is None else ["query_id", most], q, dim, "q")
    right = _elements(data, ["vec_id"], l2_normalize("embedding"), dim, "x").repartition(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dot_ = F.lit(0.0)
    for i in range(dim):
        dot_ = dot_ + F.col(f"q{i}") * F.col(f"x{i}")
    distance = F.col("q_two") - F.col("x_two") * dot_
    pairs = right.join(small(left, max(1, dim)), how="cross")
    if most is not None:
        pairs = pairs.where(F.coalesce(distance <= F.col(most), F.lit(True)))
    return pairs.select("query_id", "vec_id", distance.alias("distance"))


def bounded(queries: DataFrame, data: DataFrame, k: int, normalize_query: bool) -> DataFrame:
    """Distances among which every query's k nearest are, from the expression of :func:`distances`.

    The k-th nearest of some vectors is at least as far as the k-th nearest of
    all, so pairs beyond it needn't be ranked. Some are four times the root of
    k times all, so that both steps rank few rows.
    """
    n = data.count()
    share = 4 * (n * k) ** 0.5 / max(1, n)
    if share >= 0.5:
        return distances(queries, data, normalize_query)
    some = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    nearest = top_k(distances(queries, some, normalize_query), k)
    # NaN counts as larger than any number: where fewer than k were found, nothing is left out.
    limit = nearest.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("distance")).alias("most"))
    limited = queries.select("query_id", "embedding").join(limit, "query_id", "left").withColumn("most", F.coalesce("most", F.lit(float("nan"))))
    return distances(limited, data, normalize_query, "most")


def knn(queries: DataFrame, data: DataFrame, k: int, normalize_query: bool = False, kernel: str = "gemm") -> DataFrame:
    """The k nearest vectors: query_id, rank, vec_id, distance.

    Vectors are normalized, queries only on demand, as a flat index does.
    Ties go to the lower vec_id; k larger than the data gives all of it.
    ``kernel`` "expression" keeps everything in the JVM and is many times slower;
    it is for queries that fit a broadcast.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    found = gemm_topk(queries, data, k, normalize_query) if kernel == "gemm" else bounded(queries, data, k, normalize_query)
    return top_k(found, k).select("query_id", "rank", "vec_id", "distance")


def self_knn(data: DataFrame, k: int, kernel: str = "gemm") -> DataFrame:
    """The k nearest vectors of every vector, itself included, both sides normalized."""
    return knn(data.withColumnRenamed("vec_id", "query_id"), data, k, True, kernel)


def ranked_again(hits: DataFrame, queries: DataFrame, data: DataFrame, k: int, dim: int) -> DataFrame:
    """Of each query's ``hits`` (a shortlist) the k nearest by their vectors: query_id, rank, vec_id, distance.

    Queries are normalized. Vectors are fetched by id; a shortlist of a proven
    size is broadcast to them, so that they stay where they are. All rows of an
    id that occurs several times in the data are ranked.
    """
    listed = hits.select("query_id", "vec_id").join(queries.select("query_id", l2_normalize("embedding").alias("q")).dropDuplicates(["query_id"]), "query_id")
    rows = few(listed, dim)
    if rows is not None:
        listed = F.broadcast(data.sparkSession.createDataFrame(rows)) if rows.num_rows else listed
    found = data.select("vec_id", "embedding").join(listed, "vec_id").select("query_id", "vec_id", distance_of(dot("q", l2_normalize("embedding"))).alias("distance"))
    return top_k(found, k).select("query_id", "rank", "vec_id", "distance")


def ranked_pairs(queries: DataFrame, data: DataFrame, normalize_query: bool = False, with_distance: bool = True) -> DataFrame:
    """All vectors of each query in descending order of distance, ranked from 1: what ``topk.order_by_distance`` does with all :func:`distances`.

    No pair is a row before it has its rank.
    """
    return all_ranked(queries, data, normalize_query, with_distance)


def within(queries: DataFrame, data: DataFrame, radius: float, normalize_query: bool = True) -> DataFrame:
    """All vectors nearer than ``radius``: query_id, vec_id, distance."""
    return range_scan(queries, data, radius, normalize_query)


def threshold_knn(queries: DataFrame, data: DataFrame, threshold: float, k: int, normalize_query: bool = False) -> DataFrame:
    """Of the vectors with a similarity above ``threshold``, the k most similar of each query."""
    found = scan_threshold(queries, data, threshold, k, normalize_query).withColumn("similarity", 1 - F.col("distance") / 2)
    return top_k(found, k, "similarity", descending=True).select("query_id", "rank", "vec_id", "similarity")


def _beside_centroids(data: DataFrame, centroids: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Every row with its normalized vector x and all normalized centroids, an array that is broadcast once."""
    c = centroids.select("cell", l2_normalize("centroid").alias("c"))
    if small(c) is c:
        raise ValueError("too many centroids for an array in every task")
    book = c.agg(F.collect_list(F.struct("cell", "c")).alias("book"))
    rows = data.select("vec_id", *(F.col(k).alias(f"kept_{k}") for k in keep), l2_normalize("embedding").alias("x"))
    return rows.join(F.broadcast(book), how="cross")


def nearest_centroid(data: DataFrame, centroids: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the columns to ``keep`` and the cell with the most similar centroid; ties go to the lowest cell.

    Decided within each row: nothing is shuffled and ids may repeat.
    """
    best = F.array_max(F.transform("book", lambda b: F.struct(dot("x", b["c"]).alias("s"), (-b["cell"]).alias("cell"))))
    return _beside_centroids(data, centroids, keep).select("vec_id", *(F.col(f"kept_{k}").alias(k) for k in keep), (-best["cell"]).cast("int").alias("cell"))


def min_centroid_distance(data: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id and the distance to its nearest centroid, at most 4; decided within each row."""
    best = F.array_max(F.transform("book", lambda b: dot("x", b["c"])))
    return _beside_centroids(data, centroids, ()).select("vec_id", F.least(F.lit(4.0), distance_of(best)).alias("distance"))


def filter_below(rows: DataFrame, value: Column | str, cutoff: float) -> DataFrame:
    """Rows whose value is under the cutoff; positions travel as the rows' own columns."""
    value = F.col(value) if isinstance(value, str) else value
    return rows.where(value < cutoff)
