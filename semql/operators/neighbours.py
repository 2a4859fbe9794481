"""Joins and searches by similarity: queries go out in blocks, rows are scored a few at a time.

The query side is streamed through the driver into blocks of a fixed number of vectors, each broadcast once; the
driver makes one at a time. Rows are read once for every few blocks, and a worker keeps these, the best rows of their queries so
far and one tile of scores, so that its memory depends on neither side. Rows are never shuffled before they are reduced
to results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4_096
#: Rows that are scored with a block at a time, and pairs that are scored again in double precision at a time.
TILE, PIECE = 512, 1 << 13
#: Blocks that a worker keeps in one pass over the rows, and best rows of queries.
KEPT_BLOCKS, KEPT_ROWS = 16, 1 << 20


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector, and these as a matrix."""
    known = np.flatnonzero(~np.asarray(column.is_null()))
    flat = column.take(pa.array(known)).flatten().to_numpy(zero_copy_only=False)
    return known, flat.reshape(len(known), dim).astype(np.float32, copy=False) if len(known) else np.zeros((0, dim), np.float32)


def query_blocks(queries: DataFrame, id_col: str, vector_col: str, block: int = BLOCK, length_col: str | None = None) -> list:
    """Broadcasts of ``(ids, matrix, lengths)``; the driver holds one block at a time."""
    blocks, ids, rows, lengths = [], [], [], []

    def close() -> None:
        if ids:
            blocks.append(queries.sparkSession.sparkContext.broadcast((np.asarray(ids), np.asarray(rows, np.float32), np.asarray(lengths, np.float64) if length_col else None)))

    length = F.col(length_col) if length_col else F.lit(None)
    for r in queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"), length.alias("n")).toLocalIterator():
        if len(ids) == block:
            close()
            ids, rows, lengths = [], [], []
        ids.append(r.i), rows.append(r.v), lengths.append(r.n)
    close()
    return blocks


#: Tiles are scored in single precision and what is picked again in double; sums of either differ by less.
SLACK = np.float32(1e-4)


def _exact(values: np.ndarray, lengths: np.ndarray | None, queries: np.ndarray, query_lengths: np.ndarray | None) -> np.ndarray:
    """Scores of pairs in double precision, summed in the order of the vector. With the lengths that vectors of counts had, of the counts."""
    a, b = values.astype(np.float64), queries.astype(np.float64)
    if lengths is None or query_lengths is None:
        return np.cumsum(a * b, axis=1)[:, -1]
    total = np.einsum("ij,ij->i", np.rint(a * lengths[:, None]), np.rint(b * query_lengths[:, None]))
    some = (lengths > 0) & (query_lengths > 0)
    return np.where(some, total / np.where(some, lengths, 1) / np.where(some, query_lengths, 1), 0.0)


class Best:
    """The best ``k`` rows of each of some queries so far; ties go to the lower id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def pick(self, scores: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and query of scores in single precision, by row and query in ``asked``, that may be among the best."""
        least = self.scores[asked, -1].astype(np.float32) - SLACK
        row, query = np.nonzero(scores >= least)
        if len(row) > 4 * self.k * len(asked) and len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k] - SLACK)
            row, query = np.nonzero(scores >= least)
        return row, query

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        better = scores >= self.scores[query, -1]
        query, ids, scores = query[better], ids[better], scores[better]
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate([np.repeat(touched, self.k), query])
        s = np.concatenate([self.scores[touched].reshape(-1), scores])
        i = np.concatenate([self.ids[touched].reshape(-1), ids])
        order = np.lexsort((i, -s, q))
        q = q[order]
        kept = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]  # k of each, as there were k before
        self.scores[touched], self.ids[touched] = s[kept].reshape(-1, self.k), i[kept].reshape(-1, self.k)


def _passes(blocks: list, k: int | None, block: int) -> list[list]:
    """Blocks that go through the rows together."""
    n = KEPT_BLOCKS if k is None else max(1, min(KEPT_BLOCKS, KEPT_ROWS // (k * block)))
    return [blocks[at : at + n] for at in range(0, len(blocks), n)] or [[]]


def _tiles(cells: np.ndarray | None, n: int) -> Iterator[tuple[slice, int]]:
    """Rows to score together, and their cell; rows of a cell stand together."""
    edges = [0, n] if cells is None else [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), n]
    for low, high in zip(edges, edges[1:], strict=False):
        for at in range(low, high, TILE):
            yield slice(at, min(at + TILE, high)), -1 if cells is None else int(cells[at])


def pairs(rows: DataFrame, id_col: str, vector_col: str, blocks: list, dim: int, least: float | None = None, k: int | None = None, length_col: str | None = None, block: int = BLOCK, probes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``query_id, id, score``: at ``least`` or above, and with ``k`` the best so many that each task has for each query.

    With ``probes``, which tells for each query the numbers of the cells that it looks at, rows have a ``cell`` and meet those queries only.
    """
    low = -np.inf if least is None else np.float32(least) - SLACK
    fields = ["id", "v", *["n"] * bool(length_col), *["cell"] * bool(probes)]

    def run(part: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(b.value[0]), k) for b in part] if k else []
        looking = [[] for _ in part]
        if probes:
            for i, b in enumerate(part):
                at = probes(b.value[1])
                order = np.argsort(at, axis=None, kind="stable")
                ends = np.cumsum(np.bincount(at.reshape(-1)))
                looking[i] = np.split((order // at.shape[1]).astype(np.int32), ends)

        def made(query_ids, ids, scores) -> Iterator[pa.RecordBatch]:
            passed = np.isfinite(scores) if least is None else scores >= least
            if passed.any():
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[passed]), pa.array(ids[passed]), pa.array(scores[passed])], names=["query_id", "id", "score"])

        for batch in batches:
            known, values = matrix(batch.column("v"), dim)
            ids = batch.column("id").to_numpy()[known]
            lengths = batch.column("n").to_numpy(zero_copy_only=False)[known] if length_col else None
            cells = batch.column("cell").to_numpy()[known] if probes else None
            for tile, cell in _tiles(cells, len(values)):
                x, x_ids, x_lengths = values[tile], ids[tile], lengths[tile] if length_col else None
                for i, b in enumerate(part):
                    query_ids, query_rows, query_lengths = b.value
                    asked = np.arange(len(query_ids)) if not probes else looking[i][cell] if cell < len(looking[i]) else []
                    if not len(asked):
                        continue
                    scores = x @ (query_rows if not probes else query_rows[asked]).T
                    if least is not None:
                        scores[scores < low] = -np.inf
                    row, query = best[i].pick(scores, asked) if k else np.nonzero(scores >= low)
                    query = asked[query]
                    for at in range(0, len(row), PIECE):
                        r, q = row[at : at + PIECE], query[at : at + PIECE]
                        exact = _exact(x[r], x_lengths[r] if length_col else None, query_rows[q], query_lengths[q] if query_lengths is not None else None)
                        if k:
                            best[i].add(q, x_ids[r], exact)
                        else:
                            yield from made(query_ids[q], x_ids[r], exact)
        for i, found in enumerate(best):
            for at in range(0, len(found.ids), PIECE):
                query_ids = np.repeat(part[i].value[0][at : at + PIECE], k)
                yield from made(query_ids, found.ids[at : at + PIECE].reshape(-1), found.scores[at : at + PIECE].reshape(-1))

    columns = {"id": F.col(id_col).cast("long"), "v": F.col(vector_col).cast("array<float>"), "n": F.col(length_col).cast("double") if length_col else None, "cell": F.col("cell") if probes else None}
    narrow = rows.where(F.col(vector_col).isNotNull()).select(*[columns[c].alias(c) for c in fields])
    parts = [narrow.mapInArrow(lambda batches, part=part: run(part, batches), "query_id long, id long, score double") for part in _passes(blocks, k, block)]
    return reduce(DataFrame.unionByName, parts)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def similarity_join(rows: DataFrame, queries: DataFrame, threshold: float, id_col: str, vector_col: str, query_id: str, query_vector: str, dim: int, block: int = BLOCK, cap: int | None = None, length_col: str | None = None, query_length: str | None = None) -> DataFrame:
    """``query_id, id, score`` of all pairs at ``threshold`` or above; with ``cap``, of the best so many of each query.

    Null vectors match nothing. The two columns of lengths make scores of vectors of counts exact.
    """
    blocks = query_blocks(queries, query_id, query_vector, block, query_length)
    found = pairs(rows, id_col, vector_col, blocks, dim, threshold, cap, length_col, block)
    return found if cap is None else ranked(found, cap).drop("rank")


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str, query_vector: str, dim: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of the highest score for each query, exactly: ``query_id, id, score, rank``; ties go to the lower id."""
    blocks = query_blocks(queries, query_id, query_vector, block)
    return ranked(pairs(rows, id_col, vector_col, blocks, dim, k=k, block=block), k)
