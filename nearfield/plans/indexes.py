"""Flat and inverted-file indexes over vector tables.

An index is an immutable holder of DataFrames: ``add`` and ``train`` return a
new one. Vectors have the columns vec_id and embedding, queries query_id and
embedding; results are query_id, rank, vec_id, distance.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import exact, ivf, kmeans, pq
from nearfield.operators.kernels import MOST_LISTED_CELLS
from nearfield.operators.topk import padded
from nearfield.plans.storage import ROWS_PER_FILE, Stored, store, versions
from nearfield.schema import checked


@dataclass(frozen=True)
class FlatIndexL2:
    """Exact search over all vectors."""

    dim: int
    data: DataFrame | None = None

    def add(self, vectors: DataFrame) -> FlatIndexL2:
        rows = checked(vectors, dim=self.dim)
        return replace(self, data=rows if self.data is None else self.data.unionByName(rows))

    def train(self, vectors: DataFrame) -> FlatIndexL2:
        """Nothing to train; there so that both indexes can be used alike."""
        return self

    def search(self, queries: DataFrame, k: int, normalize_query: bool = False, kernel: str = "gemm") -> DataFrame:
        """Distances are 2 - 2 * q.x with x normalized, and q only on demand."""
        if self.data is None:
            raise ValueError("the index is empty")
        return exact.knn(checked(queries, "query_id", dim=self.dim, name="query_id"), self.data, k, normalize_query, kernel)


@dataclass(frozen=True)
class IVFIndex:
    """Search in the cells nearest to a query, over vectors or over their codes.

    ``cells`` are the vectors that were added since the index was stored, or all
    of an index that never was. A stored index (``stored``) keeps its cells in
    files; a search reads those of its probed cells.
    """

    dim: int
    num_centroids: int = 32
    use_pq: bool = False
    nprobe: int = 1
    centroids: DataFrame | None = None
    cells: DataFrame | None = None
    codebook: DataFrame | None = None
    subspaces: int = pq.SUBSPACES
    stored: Stored | None = None

    @cached_property
    def size(self) -> int:
        """Vectors in the index; those on storage are known from the manifest, others are counted once."""
        return (0 if self.cells is None else self.cells.count()) + (self.stored.size if self.stored else 0)

    def train(
        self, vectors: DataFrame, init: DataFrame | None = None, seed: int = 0, iterations: int = kmeans.ITERATIONS, codes: int = pq.CODES, pq_iterations: int = pq.ITERATIONS, seeding: str = "picks"
    ) -> IVFIndex:
        """A fresh index over ``vectors``; ``init`` gives the first centroids.

        Else they are drawn: row by row with ``seeding`` "picks", in a few rounds
        of many rows with "oversampled".
        """
        rows = checked(vectors, dim=self.dim)
        draw = kmeans.initial if seeding == "picks" else kmeans.oversampled
        start = init if init is not None else draw(rows, self.num_centroids, seed)
        centroids = kmeans.train(rows, start, iterations)
        book = pq.train_codebook(rows, self.dim, self.subspaces, codes, pq_iterations, seed) if self.use_pq else None
        return replace(self, centroids=centroids, codebook=book, cells=None, stored=None).add(vectors)

    def add(self, vectors: DataFrame) -> IVFIndex:
        """Assign vectors to the nearest cells; they can be found from then on."""
        if self.centroids is None:
            raise ValueError("the index isn't trained")
        rows = checked(vectors, dim=self.dim)
        placed = kmeans.assign(rows, self.centroids, with_vector=True)  # within each row: ids may repeat
        if self.codebook is not None:
            placed = pq.encode(placed, self.codebook, self.dim, self.subspaces, keep=("cell", "angle", "embedding"))
            placed = placed.select("vec_id", "embedding", "cell", "angle", "codes")
        return replace(self, cells=placed if self.cells is None else self.cells.unionByName(placed))

    def _ready(self, queries: DataFrame) -> DataFrame:
        if self.centroids is None or self.cells is None and self.stored is None:
            raise ValueError("the index isn't trained")
        return checked(queries, "query_id", dim=self.dim, name="query_id")

    def _cells(self, probed: DataFrame | None = None) -> DataFrame:
        """The vectors, of a stored index those in the files of probed cells."""
        if self.stored is None:
            return self.cells
        cells = None
        if probed is not None:
            listed = probed.select("cell").distinct().limit(MOST_LISTED_CELLS + 1).toArrow()
            cells = listed.column("cell").to_pylist() if listed.num_rows <= MOST_LISTED_CELLS else None
        rows = self.stored.cells(cells)
        return rows if self.cells is None else rows.unionByName(self.cells)

    def _probed(self, rows: DataFrame) -> DataFrame:
        return ivf.settled(ivf.probes(rows, self.centroids, min(self.nprobe, self.num_centroids)), self.dim)

    def search(self, queries: DataFrame, k: int, padded_form: bool = False, scoring: str = "adc", shortlist: int | None = None) -> DataFrame:
        """The k nearest in the ``nprobe`` nearest cells; with codes, by ``scoring`` adc or code_dot.

        With a ``shortlist`` of at least k, that many are found by codes and
        ranked again by their vectors; distances are then exact.
        """
        rows = self._ready(queries)
        probed = self._probed(rows)
        cells = self._cells(probed)
        if not self.use_pq:
            hits = ivf.search_cells(probed, cells, k, self.dim)
        else:
            most = max(k, shortlist or 0)
            if scoring == "adc":
                hits = pq.adc(probed.select("query_id", "cell", F.col("q").alias("embedding")), cells, self.codebook, most, self.dim, self.subspaces)
            else:
                codes = pq.encode(rows.withColumnRenamed("query_id", "vec_id"), self.codebook, self.dim, self.subspaces).withColumnRenamed("vec_id", "query_id")
                hits = pq.code_dot(probed.select("query_id", "cell").join(codes, "query_id"), cells.select("cell", "vec_id", "codes"), most)
            if shortlist:
                hits = exact.ranked_again(hits, rows, cells, k, self.dim)
        return padded(hits, rows, k) if padded_form else hits

    def search_auto(self, queries: DataFrame, k: int, radius: float = exact.RADIUS) -> DataFrame:
        """The k nearest in all cells whose centroid is within ``radius``."""
        rows = self._ready(queries)
        probed = ivf.settled(ivf.probes_within(rows, self.centroids, radius), self.dim)
        return ivf.search_cells(probed, self._cells(probed), k, self.dim)

    def radii(self) -> np.ndarray:
        """The largest angle between each centroid and a vector of its cell; -1 where there is none."""
        out = self.stored.radii(self.num_centroids) if self.stored else np.full(self.num_centroids, -1.0)
        if self.cells is not None:
            for row in self.cells.groupBy("cell").agg(F.max("angle")).collect():  # one row per cell
                out[row[0]] = max(out[row[0]], row[1])
        return out

    def cells_needed(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, cell and q of all cells that can hold one of the k nearest of all vectors.

        The ``nprobe`` nearest cells are searched for k vectors; that gives a
        limit which most other cells can't reach.
        """
        rows = self._ready(queries)
        probed = self._probed(rows)
        first = ivf.search_cells(probed, self._cells(probed), k, self.dim)
        return ivf.settled(ivf.probes_needed(rows, self.centroids, self.radii(), first, k), self.dim)

    def search_exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest of all vectors, from those cells only that can hold them."""
        needed = self.cells_needed(queries, k)
        return ivf.search_cells(needed, self._cells(needed), k, self.dim)

    def save(self, path: str, rows_per_file: int = ROWS_PER_FILE) -> IVFIndex:
        """Store the index as a new version at ``path`` and return it as it is there.

        An index that was loaded from the same path adds files for its unsaved
        vectors only. Earlier versions stay as they are.
        """
        if self.centroids is None or self.cells is None and self.stored is None:
            raise ValueError("the index isn't trained")
        path = path.rstrip("/")
        same = self.stored is not None and self.stored.path == path
        settings = {"dim": self.dim, "num_centroids": self.num_centroids, "use_pq": self.codebook is not None, "subspaces": self.subspaces}
        kept = store(path, self.cells if same else self._cells(), self.centroids, self.codebook, settings, self.stored if same else None, rows_per_file)
        return self.load(kept.spark, path, nprobe=self.nprobe, version=kept.version)

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int | None = None, use_pq: bool | None = None, nprobe: int = 1, version: int | None = None) -> IVFIndex:
        """The index at ``path``: its current version, or an earlier one.

        ``dim`` and ``use_pq`` are stored with it; a different ``dim`` is an error, ``use_pq``
        False searches the vectors although there are codes.
        """
        path = path.rstrip("/")
        there = versions(spark, path)
        if not there or version is not None and version not in there:
            raise FileNotFoundError(f"no such version of an index at {path}")
        stored = Stored(spark, path, there[-1] if version is None else version)
        said = stored.settings
        if dim is not None and dim != said["dim"]:
            raise ValueError(f"the index has vectors of {said['dim']} elements")
        codes = said["use_pq"] and use_pq is not False
        centroids = kmeans.to_frame(spark, kmeans.to_matrix(stored.centroids))
        return cls(said["dim"], said["num_centroids"], codes, nprobe, centroids, None, stored.codebook if said["use_pq"] else None, said["subspaces"], stored)
