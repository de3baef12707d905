"""Inverted lists for vector search (O2): approximate top-k that reads a few lists, not all rows.

Centroids come from a spherical k-means over a bounded sample.  Every row goes to the list of its
nearest centroid; a search reads the lists whose centroids are nearest to its vector.  How many it
must read follows from the data: the fewest with which sampled queries find the wanted share of
their true neighbours in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTS = 100
#: Rows that centroids and probes are fitted on, at most; queries and neighbours for the latter.
SAMPLE_ROWS, SAMPLE_QUERIES, NEIGHBOURS = 50_000, 200, 10
RECALL = 0.95
SEED = 7

ROWS = "list int, chunk_id bigint, document_id bigint, version bigint, embedding array<float>"


@dataclass
class Lists:
    """Centroids (normalised, a row a list) and the number of lists that a search reads."""

    centroids: np.ndarray
    probes: int

    def nearest(self, vector: list[float]) -> list[int]:
        v = np.asarray(vector, np.float64)
        return np.argsort(-(self.centroids @ v), kind="stable")[: self.probes].tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


def usable(dimension: int):
    """Embeddings of that length with finite components that aren't all zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & (F.size(v) == dimension) & fine


def fit(rows: DataFrame, dimension: int, lists: int = LISTS, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, iterations: int = 12) -> Lists:
    """Fit on at most ``sample_rows`` rows ``(chunk_id, embedding)``, chosen by a hash of the id."""
    total = rows.count()
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < F.lit(int(1_100_000 * sample_rows / total) if total > sample_rows else 1_000_000)
    held = rows.where(usable(dimension) & share).select("chunk_id", "embedding").limit(sample_rows).collect()
    if not held:
        return Lists(np.zeros((1, dimension)), 1)
    held.sort(key=lambda r: r["chunk_id"])
    x = _unit(np.array([r["embedding"] for r in held], np.float64))
    rng = np.random.default_rng(SEED)
    count = max(1, min(lists, len(x) // 4))
    c = x[rng.choice(len(x), count, replace=False)]
    for _ in range(iterations):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=count) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()), replace=False)]
        c = _unit(sums)
    own = np.argmax(x @ c.T, axis=1)
    q = rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
    cosine = x[q] @ x.T
    cosine[np.arange(len(q)), q] = -2.0
    top = np.argsort(-cosine, axis=1, kind="stable")[:, : min(NEIGHBOURS, max(len(x) - 1, 1))]
    # The place of each neighbour's list in the order in which the query would read the lists.
    order = np.argsort(-(x[q] @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(count)[None, :].repeat(len(q), 0), 1)
    needed = np.sort(np.take_along_axis(place, own[top], 1).ravel())
    return Lists(c, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)


def assigned(rows: DataFrame, lists: Lists) -> DataFrame:
    """``ROWS`` of rows ``(chunk_id, document_id, version, embedding)``; unusable embeddings have no list."""
    dimension = lists.centroids.shape[1]
    held = rows.sparkSession.sparkContext.broadcast(lists.centroids.T.copy())  # lists x dimension numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
                near = np.argmax(x @ held.value, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near), *batch.columns], names=["list", *batch.schema.names])

    return rows.where(usable(dimension)).select("chunk_id", "document_id", "version", "embedding").mapInArrow(run, ROWS)


def candidates(index: DataFrame, lists: Lists, vector: list[float]) -> DataFrame:
    """The rows of the lists that a search for ``vector`` reads; the others' files aren't opened."""
    return index.where(F.col("list").isin(lists.nearest(vector)))
