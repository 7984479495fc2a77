"""Spherical k-means with a damped step.

The loop runs on the driver, which holds the centroids and nothing else: one
row per cell and round comes back, vectors stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import l2_normalize
from nearfield.operators.exact import nearest_centroid
from nearfield.operators.kernels import BLOCK_CELLS, gemm_assign, matrix, normalized, unit

#: Rounds of drawing, and the squared distance up to which a vector counts as drawn.
ROUNDS, NEAR = 5, 1e-12
ITERATIONS, LEARNING_RATE, DECAY, GUARD = 10, 0.9, 0.9, 1e-9


def to_matrix(centroids: DataFrame) -> np.ndarray:
    """Centroids in order of their cells, which count from 0."""
    rows = sorted(centroids.select("cell", "centroid").collect())
    if [r["cell"] for r in rows] != list(range(len(rows))):
        raise ValueError("cells must be numbered from 0 without gaps")
    return np.array([r["centroid"] for r in rows], float)


def to_frame(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """A relation that the plan itself holds: counting or collecting it runs no job."""
    rows = pa.table({"cell": pa.array(np.arange(len(centroids)), pa.int32()), "centroid": pa.array([c.tolist() for c in centroids], pa.list_(pa.float64()))})
    return spark.createDataFrame(rows)


def cluster_sums(assigned: DataFrame, dim: int) -> DataFrame:
    """cell, n and the sum of the vectors of each cell, from (cell, embedding)."""
    sums = F.array(*(F.sum(F.get("embedding", F.lit(d))) for d in range(dim)))
    return assigned.groupBy("cell").agg(F.count("*").alias("n"), sums.alias("total"))


def step(data: DataFrame, centroids: DataFrame, dim: int, rate: float = LEARNING_RATE) -> DataFrame:
    """One damped round by expressions: cell and new centroid; an empty cell's mean is 0."""
    vectors = data.select("vec_id", l2_normalize("embedding").alias("embedding"))
    sums = cluster_sums(nearest_centroid(vectors, centroids, keep=("embedding",)), dim)
    joined = centroids.join(sums, "cell", "left")
    count = F.coalesce("n", F.lit(0)) + GUARD
    total = F.coalesce("total", F.array_repeat(F.lit(0.0), dim))
    moved = F.zip_with("centroid", total, lambda c, t: c + F.lit(rate) * (t / count - c))
    return joined.select("cell", moved.alias("centroid"))


def train(data: DataFrame, centroids: DataFrame, iterations: int = ITERATIONS, rate: float = LEARNING_RATE, decay: float = DECAY) -> DataFrame:
    """Centroids after that many rounds from the given ones; the rate shrinks from round to round."""
    c = to_matrix(centroids)
    for _ in range(iterations):
        total, n = np.zeros_like(c), np.zeros(len(c))
        sums = gemm_assign(data, c, sums=True).groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(d))) for d in range(c.shape[1]))).alias("total"))
        for row in sums.collect():  # one row per cell
            total[row["cell"]], n[row["cell"]] = row["total"], row["n"]
        c = c + rate * (total / (n[:, None] + GUARD) - c)
        rate *= decay
    return to_frame(data.sparkSession, c)


def assign(data: DataFrame, centroids: DataFrame, with_vector: bool = False) -> DataFrame:
    """vec_id and cell of every vector, and on demand the embedding between them."""
    return gemm_assign(data, to_matrix(centroids), with_vector=with_vector)


def initial(data: DataFrame, cells: int, seed: int = 0, far: int = 1) -> DataFrame:
    """Starting centroids: rows drawn by hash, then ``far`` rows drawn by their squared distance to them.

    The draw by distance takes the least of -log(u) / weight over all rows, u
    being a hash of the row; that is one top-1 job, not a pass on the driver.
    """
    spark = data.sparkSession
    far = min(far, cells - 1) if cells > 1 else 0
    first = data.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(cells - far).collect()
    chosen, ids = [list(r["embedding"]) for r in first], {r["vec_id"] for r in first}
    if len(chosen) < cells - far:
        raise ValueError("there are fewer vectors than cells")
    from nearfield.operators.exact import min_centroid_distance

    for turn in range(far):
        now = to_frame(spark, np.array(chosen, float))
        weight = F.greatest(F.col("distance"), F.lit(1e-12))
        u = (F.pmod(F.xxhash64("vec_id", F.lit(seed + 1 + turn)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
        row = min_centroid_distance(data, now).where(~F.col("vec_id").isin(list(ids))).orderBy(-F.log(u) / weight, "vec_id").limit(1)
        got = data.join(F.broadcast(row.select("vec_id")), "vec_id", "left_semi").first()
        if got is None:
            raise ValueError("there are fewer vectors than cells")
        chosen.append(list(got["embedding"]))
        ids.add(got["vec_id"])
    return to_frame(spark, np.array(chosen, float))


def exponential_draw(data: DataFrame, chosen: np.ndarray, most: int, seed: int) -> DataFrame:
    """Up to ``most`` rows drawn without replacement by their squared distance to the nearest of ``chosen``: key, vec_id, embedding.

    A row's key is -log(u) / weight, u a hash of seed and id; the least keys are
    the draw (Efraimidis and Spirakis 2006). A task passes on its least keys
    only. Rows at distance 0, such as the chosen ones, and
    zero vectors can't be drawn.
    """
    shared = data.sparkSession.sparkContext.broadcast(unit(chosen))
    u = (F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        best = None
        for batch in batches:
            if not len(batch):
                continue
            x = unit(matrix(batch.column("embedding")))
            step = max(1, BLOCK_CELLS // len(c))
            nearest = np.concatenate([(x[a : a + step] @ c.T).max(axis=1) for a in range(0, len(x), step)])
            weight = 2.0 - 2.0 * nearest
            with np.errstate(divide="ignore"):
                key = np.where((weight > NEAR) & x.any(axis=1), -np.log(batch.column("u").to_numpy()) / weight, np.inf)
            rows = pa.table({"key": pa.array(key), "vec_id": batch.column("vec_id"), "embedding": batch.column("embedding")}).filter(pa.array(np.isfinite(key)))
            best = rows if best is None else pa.concat_tables([best, rows])
            best = best.sort_by([("key", "ascending"), ("vec_id", "ascending")]).slice(0, most)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    drawn = data.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), u.alias("u")).mapInArrow(each, "key double, vec_id long, embedding array<double>")
    return drawn.orderBy("key", "vec_id").limit(most)


def weighted_seeds(candidates: np.ndarray, weights: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Places of ``cells`` candidates, drawn one by one by weight times squared distance to those drawn before."""
    rng = np.random.default_rng(seed)
    x = unit(candidates)
    picked = [int(rng.choice(len(x), p=weights / weights.sum()))]
    near = 2.0 - 2.0 * (x @ x[picked[0]])
    for _ in range(cells - 1):
        p = np.maximum(near, 0.0) * weights
        p[picked] = 0.0
        if p.sum() <= 0:  # copies of drawn ones are left
            p = np.ones(len(x))
            p[picked] = 0.0
        picked.append(int(rng.choice(len(x), p=p / p.sum())))
        near = np.minimum(near, 2.0 - 2.0 * (x @ x[picked[-1]]))
    return np.array(picked)


def oversampled(data: DataFrame, cells: int, seed: int = 0, rounds: int = ROUNDS, per_round: int | None = None) -> DataFrame:
    """Starting centroids by scalable k-means++ (Bahmani et al. 2012).

    From one row drawn by hash, each round draws ``per_round`` rows (as many as
    cells, unless given) at once by their squared distance to what was drawn so
    far. Each drawn row then weighs as many vectors as it is nearest to, and
    ``cells`` of them are drawn by weight and distance. That takes one pass a
    round and one for the weights, at any number of cells; the driver holds
    1 + rounds * per_round vectors.
    """
    first = data.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(1).collect()
    if not first:
        raise ValueError("there are fewer vectors than cells")
    chosen = np.array([first[0]["embedding"]], float)
    for turn in range(rounds):
        rows = exponential_draw(data, chosen, per_round or cells, seed + 1 + turn).collect()  # per_round rows
        if not rows:
            break
        chosen = np.concatenate([chosen, [r["embedding"] for r in rows]])
    if len(chosen) < cells:
        raise ValueError("there are fewer different vectors than cells, or too few rounds")
    weights = np.zeros(len(chosen))
    for row in gemm_assign(data, chosen, sums=True).groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row per candidate
        weights[row["cell"]] = row["n"]
    return to_frame(data.sparkSession, chosen[weighted_seeds(chosen, weights, cells, seed)])
