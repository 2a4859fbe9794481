"""Approximate search with an inverted file: cells around centroids, exact scores within the cells looked at.

Centroids are fitted on a bounded sample; every row is put into its cell. A search brings the rows of a cell together and
scores them with the queries that look at it, so it scores ``probes`` of ``cells`` shares of the table; written partitioned by cell, a lone query prunes
the others. How many cells are looked at is chosen so that the sample's own recall reaches a target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semql.operators import neighbours

#: Rows that the centroids are fitted on, at most.
MAX_SAMPLE = 20_000


@dataclass
class CellIndex:
    centroids: np.ndarray
    probes: int

    def cells_of(self, vector: Column, n: int) -> Column:
        """The ``n`` nearest cells of each vector."""
        centroids = self.centroids

        @F.pandas_udf("array<int>")
        def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                known = rows.notna().to_numpy()
                out = np.full(len(rows), None, object)
                if known.any():
                    scores = np.stack(rows[known].to_numpy()).astype(np.float32) @ centroids.T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)
                    out[np.flatnonzero(known)] = list(best)
                yield pd.Series(out, index=rows.index)

        return cells(vector)

    def nearest_cells(self, vector) -> np.ndarray:
        """The cells that one query looks at."""
        return np.argsort(-(self.centroids @ np.asarray(vector, np.float32)), kind="stable")[: self.probes]

    def assign(self, rows: DataFrame, vector_col: str) -> DataFrame:
        return rows.withColumn("cell", self.cells_of(F.col(vector_col), 1)[0])

    def search(self, indexed: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str, query_vector: str) -> DataFrame:
        """``query_id, id, score, rank`` of the best ``k`` rows in the cells near each query."""
        centroids, n = self.centroids, self.probes
        blocks = neighbours.query_blocks(queries, query_id, query_vector)
        looked_at = lambda q: np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :n]
        # Rows of a cell together, so that a product of matrices scores them; a number of parts keeps all cores busy.
        parts = 2 * indexed.sparkSession.sparkContext.defaultParallelism
        together = indexed.where(F.col("cell").isNotNull()).repartition(parts, "cell").sortWithinPartitions("cell")
        return neighbours.ranked(neighbours.pairs(together, id_col, vector_col, blocks, centroids.shape[1], k=k, probes=looked_at), k)


def fit(rows: DataFrame, vector_col: str, id_col: str, cells: int | None = None, target: float = 0.97, max_sample: int = MAX_SAMPLE, rounds: int = 12, seed: int = 11) -> CellIndex:
    """Spherical k-means on at most ``max_sample`` rows, in the order of a hash of their ids; about one cell for the root of the sample."""
    known = rows.where(F.col(vector_col).isNotNull())
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(max_sample).select(vector_col).toPandas()[vector_col]
    if not len(sample):
        return CellIndex(np.zeros((1, 1), np.float32), 1)
    x = np.stack(sample.to_numpy()).astype(np.float32)
    n = min(len(x), cells or max(1, int(len(x) ** 0.5)))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    asked = x[rng.choice(len(x), min(200, len(x)), replace=False)]
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :10]
    own, order = (x @ centroids.T).argmax(axis=1), np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell in a query's order
    needed = np.take_along_axis(place, own[true], axis=1)
    probes = next(p for p in range(1, n + 1) if (needed < p).mean() >= target or p == n)
    return CellIndex(centroids, probes)
