"""Product quantization: codebooks, codes, and distances from codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import l2_normalize, squared_l2, subvector
from nearfield.operators.exact import small
from nearfield.operators.kernels import column, few, matrix, normalized, scan_topk
from nearfield.operators.topk import top_k

SUBSPACES, CODES, ITERATIONS = 4, 32, 100
MOST_CODES = 256


def subvectors(data: DataFrame, dim: int, subspaces: int = SUBSPACES) -> DataFrame:
    """vec_id, subspace and the part of the normalized vector that lies in it."""
    if dim % subspaces:
        raise ValueError(f"{dim} elements don't divide into {subspaces} subspaces")
    width = dim // subspaces
    vectors = data.select("vec_id", l2_normalize("embedding").alias("v"))
    parts = F.array(*(subvector("v", s, width) for s in range(subspaces)))
    return vectors.select("vec_id", F.posexplode(parts).alias("subspace", "part"))


def initial_codebook(data: DataFrame, dim: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 0) -> DataFrame:
    """Codes from the parts of rows drawn by hash: subspace, code, centroid."""
    if not 1 <= codes <= MOST_CODES:
        raise ValueError(f"between 1 and {MOST_CODES} codes")
    rows = data.select("vec_id").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(codes).collect()
    numbers = data.sparkSession.createDataFrame([(r["vec_id"], k) for k, r in enumerate(rows)], "vec_id long, code int")
    drawn = data.join(F.broadcast(numbers), "vec_id")
    return subvectors(drawn, dim, subspaces).join(F.broadcast(numbers), "vec_id").select("subspace", "code", F.col("part").alias("centroid"))


def encode_parts(parts: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, subspace, code: the nearest code of each part, the lowest of equal ones."""
    book = codebook.groupBy("subspace").agg(F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("book"))
    near = F.array_min(F.transform("book", lambda b: F.struct(squared_l2("part", b["centroid"]).alias("d"), b["code"].alias("code"))))
    return parts.join(small(book), "subspace").select("vec_id", "subspace", near["code"].alias("code"), "part")


def train_step(parts: DataFrame, codebook: DataFrame, width: int) -> DataFrame:
    """One round of Lloyd's algorithm in every subspace; a code that nothing is nearest to stays."""
    sums = encode_parts(parts, codebook).groupBy("subspace", "code").agg(F.count("*").alias("n"), F.array(*(F.sum(F.get("part", F.lit(d))) for d in range(width))).alias("total"))
    moved = F.coalesce(F.transform("total", lambda t: t / F.col("n")), F.col("centroid"))
    return codebook.join(sums, ["subspace", "code"], "left").select("subspace", "code", moved.alias("centroid"))


def code_sums(data: DataFrame, book: np.ndarray) -> DataFrame:
    """subspace, code, n and total (sum of parts) of each code, from one pass over the vectors.

    A task adds up the parts of all subspaces in batches and sends a row for
    each code at most.
    """
    shared = data.sparkSession.sparkContext.broadcast(book)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        subspaces, codes, width = book.shape
        n, total = np.zeros(subspaces * codes, np.int64), np.zeros((subspaces * codes, width))
        for batch in batches:
            if not len(batch):
                continue
            x = normalized(matrix(batch.column("embedding")))
            flat = (part_distances(x, book).argmin(axis=2) + np.arange(subspaces) * codes).ravel()
            n += np.bincount(flat, minlength=len(n))
            np.add.at(total, flat, x.reshape(-1, width))
        used = np.flatnonzero(n)
        arrays = [pa.array((used // codes).astype(np.int32)), pa.array((used % codes).astype(np.int32)), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["subspace", "code", "n", "total"])

    return data.select("embedding").mapInArrow(each, "subspace int, code int, n long, total array<double>")


def train_codebook(
    data: DataFrame, dim: int, subspaces: int = SUBSPACES, codes: int = CODES, iterations: int = ITERATIONS, seed: int = 0, init: DataFrame | None = None, most_rows: int | None = None
) -> DataFrame:
    """The codebook after so many rounds from ``init`` or from drawn rows, or earlier if it stops changing.

    A round is one pass over the vectors; with ``most_rows`` over about that
    many of them, drawn by hash. It brings ``subspaces * codes`` rows to the
    driver and no vectors. A code that nothing is nearest to stays.
    """
    if dim % subspaces:
        raise ValueError(f"{dim} elements don't divide into {subspaces} subspaces")
    book = books(init if init is not None else initial_codebook(data, dim, subspaces, codes, seed))
    rows = data.select("vec_id", "embedding")
    if most_rows is not None:
        share = most_rows / max(1, rows.count())
        rows = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("vec_id", F.lit(~seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.persist()
    try:
        for _ in range(iterations):
            sums = code_sums(rows, book).groupBy("subspace", "code").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(d))) for d in range(book.shape[2]))).alias("total"))
            moved = book.copy()
            for r in sums.collect():  # one row per code
                moved[r["subspace"], r["code"]] = np.array(r["total"]) / r["n"]
            still = np.abs(moved - book).max() < 1e-12
            book = moved
            if still:
                break
    finally:
        rows.unpersist()
    numbered = [(s, c, book[s, c].tolist()) for s in range(book.shape[0]) for c in range(book.shape[1])]
    return data.sparkSession.createDataFrame(numbered, "subspace int, code int, centroid array<double>")


def books(codebook: DataFrame) -> np.ndarray:
    """The codebook as an array by subspace, code and element; at most MOST_CODES rows a subspace."""
    rows = sorted(codebook.select("subspace", "code", "centroid").collect())
    subspaces = len({r["subspace"] for r in rows})
    return np.array([r["centroid"] for r in rows], float).reshape(subspaces, -1, len(rows[0]["centroid"]))


def part_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row's parts to all codes: rows x subspaces x codes."""
    parts = x.reshape(len(x), book.shape[0], 1, book.shape[2])
    out = np.empty((len(x), *book.shape[:2]))
    for a in range(0, len(x), 1024):
        out[a : a + 1024] = ((parts[a : a + 1024] - book) ** 2).sum(axis=-1)
    return out


def encode(data: DataFrame, codebook: DataFrame, dim: int, subspaces: int = SUBSPACES, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the columns to ``keep`` and its codes, one per subspace in order.

    A vector's parts are coded within its row; nothing is shuffled.
    """
    if dim % subspaces:
        raise ValueError(f"{dim} elements don't divide into {subspaces} subspaces")
    shared = data.sparkSession.sparkContext.broadcast(books(codebook))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = part_distances(normalized(matrix(batch.column("embedding"))), shared.value).argmin(axis=2)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(batch.column(c) for c in keep), lists], names=["vec_id", *keep, "codes"])

    kinds = "".join(f"{c} {data.schema[c].dataType.simpleString()}, " for c in keep)
    return data.select("vec_id", "embedding", *(c for c in keep if c != "embedding")).mapInArrow(each, f"vec_id long, {kinds}codes array<smallint>")


def _probes(rows: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """Ids of the queries, a row of values of each, and where there is a cell column (row, cell)."""
    ids, at = np.unique(column(rows, "query_id").to_numpy(), return_inverse=True)
    all_values = matrix(column(rows, value))
    values = np.zeros((len(ids), all_values.shape[1]))
    values[at] = all_values
    return ids, values, (at, column(rows, "cell").to_numpy()) if "cell" in rows.column_names else None


def code_dot(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Rank by the dot product of code numbers, larger first: query_id, rank, vec_id, distance = 2 - 2 * score.

    ``queries`` has query_id, codes; with a cell column on both sides only rows
    of one cell meet. Queries that fit a broadcast go to the codes, more of them
    meet the codes in a join.
    """
    rows = few(queries, MOST_CODES)
    if rows is not None and rows.num_rows:
        ids, codes, probes = _probes(rows, "codes")
        found = scan_topk(data, "codes", ids, codes, k, lambda q, x: 2.0 - 2.0 * (q @ x.T), probes)
    else:
        score = F.aggregate(F.zip_with("qc", "codes", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
        q = queries.withColumnRenamed("codes", "qc")
        joined = data.join(q, "cell") if "cell" in queries.columns else data.join(small(q), how="cross")
        found = joined.select("query_id", "vec_id", (F.lit(2.0) - 2.0 * score).alias("distance"))
    return top_k(found, k).select("query_id", "rank", "vec_id", "distance")


def adc_tables(queries: DataFrame, codebook: DataFrame, dim: int, subspaces: int = SUBSPACES) -> DataFrame:
    """For each query the squared distances of its parts to all codes: query_id, table (subspace -> code -> distance)."""
    parts = subvectors(queries.withColumnRenamed("query_id", "vec_id"), dim, subspaces).withColumnRenamed("vec_id", "query_id")
    book = codebook.groupBy("subspace").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "centroid"))), lambda b: b["centroid"]).alias("book"))
    rows = parts.join(small(book), "subspace").select("query_id", "subspace", F.transform("book", lambda c: squared_l2("part", c)).alias("row"))
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("subspace", "row"))), lambda r: r["row"]).alias("table"))


def adc(queries: DataFrame, data: DataFrame, codebook: DataFrame, k: int, dim: int, subspaces: int = SUBSPACES) -> DataFrame:
    """Asymmetric distances (Jégou et al. 2011): exact query parts against the vectors' codes.

    ``queries`` has query_id, embedding and perhaps cell, ``data`` vec_id, codes
    and perhaps cell. Queries whose tables of distances fit a broadcast go to
    the codes, more of them meet the codes in a join.
    """
    book = books(codebook)
    rows = few(queries, max(dim, book.shape[0] * book.shape[1]))
    if rows is not None and rows.num_rows:
        ids, q, probes = _probes(rows, "embedding")
        tables = part_distances(normalized(q), book).reshape(len(ids), -1)
        offset = np.arange(book.shape[0]) * book.shape[1]

        def distance(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
            places = codes.astype(np.int64) + offset
            out = np.zeros((len(table), len(codes)))
            for s in range(places.shape[1]):
                out += table[:, places[:, s]]
            return out

        found = scan_topk(data, "codes", ids, tables, k, distance, probes)
    else:
        tables = adc_tables(queries.select("query_id", "embedding").dropDuplicates(["query_id"]), codebook, dim, subspaces)
        looked = F.transform(F.col("codes"), lambda c, s: F.get(F.get("table", s), c.cast("int")))
        distance = F.aggregate(looked, F.lit(0.0), lambda s, x: s + x)
        if "cell" in queries.columns:
            joined = data.join(queries.select("query_id", "cell").join(tables, "query_id"), "cell")
        else:
            joined = data.join(small(tables), how="cross")
        found = joined.select("query_id", "vec_id", distance.alias("distance"))
    return top_k(found, k).select("query_id", "rank", "vec_id", "distance")
