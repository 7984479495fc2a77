"""Search in the cells of an inverted file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import distance_of, dot, l2_normalize
from nearfield.operators.exact import RADIUS
from nearfield.operators.kernels import BLOCK_CELLS, column, cosine_distance, few, matrix, normalized, scan_topk
from nearfield.operators.kmeans import to_matrix
from nearfield.operators.topk import top_k


#: Angles are right up to this.
SLACK = 1e-6


def probe_scan(queries: DataFrame, centroids: DataFrame, n_probe: int | None = None, radius: float | None = None, radii: np.ndarray | None = None) -> DataFrame:
    """Cells to search for each query: query_id, cell, distance of the centroid, normalized query q.

    The ``n_probe`` nearest, ties to the lower cell; or all within ``radius``; or,
    given the angles ``radii`` between each centroid and its farthest vector,
    all that can hold a vector as near as the query's column ``limit``. Decided
    within each row against the centroids, which the driver has as well.
    """
    shared = queries.sparkSession.sparkContext.broadcast((normalized(to_matrix(centroids)), radii))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, radii = shared.value
        for batch in batches:
            for a in range(0, len(batch), step := max(1, BLOCK_CELLS // max(1, len(c)))):
                some = batch.slice(a, step)
                q = normalized(matrix(some.column("embedding")))
                similarity = q @ c.T
                d = 2.0 - 2.0 * similarity
                if radii is not None:
                    between = np.arccos(np.clip(similarity, -1.0, 1.0)) - radii - SLACK
                    near = 2.0 - 2.0 * np.cos(np.maximum(0.0, between)) <= some.column("limit").to_numpy(zero_copy_only=False)[:, None]
                    at, cell = np.nonzero(near & (radii >= 0))
                elif radius is not None:
                    at, cell = np.nonzero(d <= radius)
                else:
                    best = np.argsort(d, axis=1, kind="stable")[:, :n_probe]
                    at, cell = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                lists = pa.ListArray.from_arrays(np.arange(0, q.shape[1] * len(at) + 1, q.shape[1], dtype=np.int32), pa.array(q[at].ravel()))
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(d[at, cell]), lists], names=["query_id", "cell", "distance", "q"])

    columns = ["query_id", F.col("embedding").cast("array<double>").alias("embedding"), *(["limit"] if radii is not None else [])]
    return queries.select(*columns).mapInArrow(each, "query_id long, cell int, distance double, q array<double>")


def probes(queries: DataFrame, centroids: DataFrame, n_probe: int = 1) -> DataFrame:
    """The ``n_probe`` cells nearest to each query: query_id, cell, q."""
    return probe_scan(queries, centroids, n_probe).select("query_id", "cell", "q")


def probes_within(queries: DataFrame, centroids: DataFrame, radius: float = RADIUS) -> DataFrame:
    """All cells whose centroid is within the radius of the query."""
    return probe_scan(queries, centroids, radius=radius).select("query_id", "cell", "q")


def probes_needed(queries: DataFrame, centroids: DataFrame, radii: np.ndarray, first_hits: DataFrame, k: int) -> DataFrame:
    """All cells that can hold one of a query's k nearest, given ``first_hits`` from some of them.

    The farthest of k hits is a limit. Vectors of a cell are at least as far as
    the angle to its centroid less the cell's radius; cells beyond the limit
    are left out. Fewer hits than k are no limit. ``radii`` of -1 are empty cells.
    """
    limits = first_hits.groupBy("query_id").agg(F.max("distance").alias("limit"), F.count("*").alias("n")).where(F.col("n") >= k)
    rows = queries.join(limits.select("query_id", "limit"), "query_id", "left")
    return probe_scan(rows.withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), centroids, radii=radii).select("query_id", "cell", "q")


def settled(probed: DataFrame, dim: int) -> DataFrame:
    """The probes as rows of the plan, if they fit a broadcast, so that whatever reads them doesn't look for them again."""
    rows = few(probed.select("query_id", "cell", "q"), dim)
    if rows is None:
        return probed
    return probed.sparkSession.createDataFrame(rows if rows.num_rows else [], None if rows.num_rows else probed.select("query_id", "cell", "q").schema)


def search_cells(probed: DataFrame, cells: DataFrame, k: int, dim: int) -> DataFrame:
    """The k nearest vectors in the probed cells: query_id, rank, vec_id, distance.

    Probes that fit a broadcast go to the vectors, which stay where they are; of
    cells stored by cell only the probed ones are read. More probes meet the
    cells in an equi-join. Empty cells and queries without a probe give no rows.
    """
    rows = few(probed.select("query_id", "cell", "q"), dim)
    if rows is not None:
        ids, at = np.unique(column(rows, "query_id").to_numpy(), return_inverse=True)
        q = np.zeros((len(ids), dim))
        if len(ids):
            q[at] = matrix(column(rows, "q"))
        found = scan_topk(cells, "embedding", ids, q, k, cosine_distance, (at, column(rows, "cell").to_numpy()))
    else:
        vectors = cells.select("cell", "vec_id", l2_normalize("embedding").alias("x"))
        found = vectors.join(probed, "cell").select("query_id", "vec_id", distance_of(dot("q", "x")).alias("distance"))
    return top_k(found, k).select("query_id", "rank", "vec_id", "distance")
