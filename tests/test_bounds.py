"""What a worker holds, and what a search gives, don't depend on how the rows are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semql.functions import embedders
from semql.operators import ann, neighbours


def test_few_texts_are_embedded_at_a_time(spark):
    class Few:
        model_id, dim = "few", 2

        def embed(self, texts):
            assert len(texts) <= 256, len(texts)
            return [None if not t else np.array([len(t), 1], np.float32) for t in texts]

    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), (F.col("id") % 5).cast("int"))).alias("t")).coalesce(1)
    found = rows.select("id", embedders.embed_column(F.col("t"), Few()).alias("v")).collect()
    assert {r.id: r.v for r in found} == {i: [float(i % 5), 1.0] if i % 7 and i % 5 else None for i in range(3000)}
    made = rows.select(embedders.scaled_column(F.col("t"), Few()).alias("m")).where("m.vector IS NOT NULL AND m.length IS NULL")
    assert made.count() == sum(1 for i in range(3000) if i % 7 and i % 5)


def test_kept_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(embedders, "_KEEP", 100)
    monkeypatch.setattr(embedders, "_CODES", {})
    e = embedders.HashingEmbedder()
    texts = [f"common word{i} word{i + 1}" for i in range(1000)]
    got = [v.tolist() for v in e.embed(texts)]
    assert len(embedders._CODES[256]) <= 110 and b"common" in embedders._CODES[256]
    monkeypatch.setattr(embedders, "_CODES", {})
    monkeypatch.setattr(embedders, "_KEEP", 10_000)
    assert got == [v.tolist() for v in e.embed(texts)]


@pytest.fixture(scope="module")
def vectors():
    x = np.random.default_rng(3).normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[900:1200] = x[100:400]  # ties
    return x


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>").repartition(2).cache()


def wanted(x, q, k, allowed=None):
    s = np.cumsum(x.astype(np.float64) * x[q].astype(np.float64), axis=1)[:, -1]
    ids = np.arange(len(x)) if allowed is None else np.flatnonzero(allowed)
    return [int(i) for i in ids[np.lexsort((ids, -s[ids]))][:k]]


def by_rank(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    return got


@pytest.mark.parametrize("kept", [1, 1 << 20])
def test_a_task_gives_each_query_its_best_rows_once(spark, vectors, kept, monkeypatch):
    monkeypatch.setattr(neighbours, "KEPT_ROWS", kept)  # with 1, every block is a pass of its own
    monkeypatch.setattr(neighbours, "TILE", 64)
    rows = table(spark, vectors)
    asked = rows.where("id % 20 = 0")
    blocks = neighbours.query_blocks(asked, "id", "v", 30)
    found = neighbours.pairs(rows, "id", "v", blocks, 16, k=10, block=30)
    assert found.count() == 2 * 75 * 10  # two tasks, however many tiles and batches
    assert by_rank(neighbours.nearest(rows, asked, 10, "id", "v", "id", "v", 16, 30)) == {q: wanted(vectors, q, 10) for q in range(0, 1500, 20)}


def test_a_search_gives_the_best_of_the_cells_looked_at(spark, vectors):
    rows = table(spark, vectors)
    index = ann.fit(rows, "v", "id", cells=12)
    index.probes = 3
    found = index.search(index.assign(rows, "v"), rows.where("id % 20 = 0"), 10, "id", "v", "id", "v")
    own, order = (vectors @ index.centroids.T).argmax(axis=1), np.argsort(-(vectors @ index.centroids.T), axis=1, kind="stable")
    assert by_rank(found) == {q: wanted(vectors, q, 10, np.isin(own, order[q, :3])) for q in range(0, 1500, 20)}
