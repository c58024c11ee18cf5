"""Synthetic corpora: uniform on the sphere, and clustered mixtures of Gaussians.

Every row has a random stream of its own, given by the seed and its number, so
any partitioning makes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import rng

# Where the streams of queries and of cluster parameters begin.
CORPUS_STREAM, QUERY_STREAM, CLUSTER_STREAM = 0, 1 << 40, 1 << 41
ROWS_AT_ONCE = 4096


def normalize(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their norms (doubles rounded to float); zero rows stay."""
    norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    return np.where(norm[:, None] > 0, rows / np.where(norm > 0, norm, np.float32(1))[:, None], rows)


def _normals(states: np.ndarray, first: int, dim: int) -> np.ndarray:
    """dim normals of each stream, from output number `first` on."""
    even = dim + dim % 2
    return rng.gaussian(rng.outputs(states, np.arange(first, first + even)))[:, :dim].astype(np.float32)


def clusters(seed: int, count: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit means, and deviations per coordinate for a noise norm between 0.15 and 0.8."""
    states = rng.substream(seed, CLUSTER_STREAM + np.arange(count))
    means = normalize(_normals(states, 0, dim))
    u = rng.uniform(rng.outputs(states, np.array([dim + dim % 2])))[:, 0].astype(np.float32)
    spread = np.float32(0.15) + np.float32(0.65) * u
    return means, spread / np.sqrt(np.float32(dim))


def rows(dist: str, ids: np.ndarray, dim: int, seed: int, stream: int, made: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The vectors of some row numbers."""
    states = rng.substream(seed, stream + ids)
    if dist == "uniform":
        return normalize(_normals(states, 0, dim))
    means, sigma = made
    which = rng.bounded(rng.outputs(states, np.array([0]))[:, 0], len(means)).astype(np.int64)
    return normalize(means[which] + sigma[which, None] * _normals(states, 1, dim))


def generate(spark: SparkSession, dist: str, n: int, dim: int, n_clusters: int, seed: int, stream: int = CORPUS_STREAM, partitions: int | None = None) -> DataFrame:
    """id and embedding of n unit vectors; dist is gmm or uniform."""
    if dist not in ("gmm", "uniform"):
        raise ValueError(f"dist must be gmm or uniform, not {dist!r}")
    shared = spark.sparkContext.broadcast(clusters(seed, n_clusters, dim) if dist == "gmm" else None)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo in range(0, len(ids), ROWS_AT_ONCE):
                part = ids[lo : lo + ROWS_AT_ONCE]
                flat = rows(dist, part, dim, seed, stream, shared.value).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(flat, pa.float32()))], names=["id", "embedding"])

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(make, "id long, embedding array<float>")
