"""Search by a threshold, with results of any length, that skips blocks out of reach.

Vectors are grouped around pivots and sorted by their angle to them. If a query
is at angle a from a pivot and looks no further than angle t, only vectors
between a - t and a + t from that pivot can be hits (the triangle inequality on
the sphere); blocks outside aren't multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.kernels import BLOCK_CELLS, FOUND, BestK, angles, column, few, matrix, normalized, passing, unit

#: Vectors that serve as pivots, and vectors of a block.
PIVOTS, BLOCK = 32, 512
#: Angles are right up to this; blocks at the edge are looked into.
SLACK = 1e-6


@dataclass
class Block:
    """Vectors around one pivot, with the least and the largest angle to it."""

    ids: np.ndarray
    x: np.ndarray
    pivot: int
    least: float
    most: float


def arranged(ids: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> list[Block]:
    """Vectors in blocks around their nearest pivot, ordered by the angle to it."""
    x = normalized(x)
    if not len(x):
        return []
    similarity = x @ pivots.T
    nearest = similarity.argmax(axis=1)
    angle = angles(similarity.max(axis=1), x)
    order = np.lexsort((angle, nearest))
    own, starts = np.unique(nearest[order], return_index=True)
    return [
        Block(ids[rows], x[rows], int(p), float(angle[rows[0]]), float(angle[rows[-1]]))
        for p, all_ in zip(own, np.split(order, starts[1:]))
        for rows in (all_[a : a + BLOCK] for a in range(0, len(all_), BLOCK))
    ]


def reach(q: np.ndarray, similarity: float) -> np.ndarray:
    """The angle up to which each query can have a vector of that similarity or more.

    Vectors have at most length 1, so for a similarity from 0 on the angle is
    bounded by the query's length; below 0 it isn't, and nothing is skipped.
    """
    if similarity < 0:
        return np.full(len(q), np.pi)
    norm = np.sqrt((q * q).sum(axis=1))
    return np.arccos(np.clip(similarity / np.maximum(norm, 1e-300), -1.0, 1.0))


def near_blocks(q: np.ndarray, blocks: list[Block], pivots: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, Block, np.ndarray]]:
    """(places of queries, block, their distances to it) wherever a query can have a hit."""
    to_pivot = np.arccos(np.clip(unit(q) @ pivots.T, -1.0, 1.0))
    far = reach(q, similarity) + SLACK
    for block in blocks:
        a = to_pivot[:, block.pivot]
        at = np.flatnonzero((a - far <= block.most) & (a + far >= block.least))
        tall = max(1, BLOCK_CELLS // len(block.ids))
        for some in (at[k : k + tall] for k in range(0, len(at), tall)):
            yield some, block, 2.0 - 2.0 * (q[some] @ block.x.T)


def threshold_scan(queries: DataFrame, data: DataFrame, hit: Callable[[np.ndarray], np.ndarray], similarity: float, normalize_query: bool, k: int | None = None) -> DataFrame:
    """query_id, vec_id, distance of all pairs whose distance ``hit`` accepts, none of which is below ``similarity``.

    With ``k`` only what can be among a query's k nearest, per task. Queries that
    fit a broadcast go to the vectors; more of them pass by groups of vectors
    that tasks hold. There is no join.
    """
    pivots = matrix(column(data.select("embedding").limit(PIVOTS).toArrow(), "embedding"))  # any vectors will do
    if not len(pivots):
        return data.sparkSession.createDataFrame([], FOUND)
    pivots = unit(pivots)

    def found(query_ids: np.ndarray, q: np.ndarray, blocks: list[Block], best: BestK | None) -> Iterator[pa.RecordBatch]:
        for at, block, distance in near_blocks(q, blocks, pivots, similarity):
            right = hit(distance) if best is None else hit(distance) & (distance <= best.worst[at][:, None])
            r, c = np.nonzero(right)
            if not len(r):
                continue
            if best is None:
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at[r]]), pa.array(block.ids[c]), pa.array(distance[r, c])], names=["query_id", "vec_id", "distance"])
            else:
                best.offer(at[r], distance[r, c], block.ids[c])

    def meet(query_ids: np.ndarray, q: np.ndarray, blocks: list[Block]) -> Iterator[pa.RecordBatch]:
        best = None if k is None else BestK(len(q), k)
        yield from found(query_ids, normalized(q) if normalize_query else q, blocks, best)
        if best is not None:
            yield best.table(query_ids)

    rows = few(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), pivots.shape[1])
    if rows is None:
        return passing(queries, data, lambda ids, x: arranged(ids, x, pivots), meet)
    q = matrix(column(rows, "embedding"))
    shared = data.sparkSession.sparkContext.broadcast((column(rows, "query_id").to_numpy(), normalized(q) if normalize_query and len(q) else q))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        best = None if k is None else BestK(len(query_ids), k)
        for batch in batches if len(query_ids) else ():
            blocks = arranged(batch.column("vec_id").to_numpy(), matrix(batch.column("embedding")), pivots)
            yield from found(query_ids, q, blocks, best)
        if best is not None:
            yield best.table(query_ids)

    return data.select("vec_id", "embedding").mapInArrow(each, FOUND)


def range_scan(queries: DataFrame, data: DataFrame, radius: float, normalize_query: bool = True) -> DataFrame:
    """All vectors nearer than ``radius`` to each query: query_id, vec_id, distance."""
    return threshold_scan(queries, data, lambda d: d < radius, 1 - radius / 2, normalize_query)


def threshold_topk(queries: DataFrame, data: DataFrame, threshold: float, k: int, normalize_query: bool = False) -> DataFrame:
    """Per task the k nearest of the vectors with a similarity above ``threshold``: query_id, vec_id, distance."""
    return threshold_scan(queries, data, lambda d: 1 - d / 2 > threshold, threshold, normalize_query, k)
