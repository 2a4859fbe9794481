import numpy as np
import pytest

from semql.operators import ann, neighbours


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(10_000, None)], "id long, v array<float>").repartition(4)


def unit(n, d, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [7, 4096])
def test_nearest_and_join_are_exact(spark, block):
    x = unit(400, 16)
    rows = table(spark, x)
    asked = rows.where("id % 20 = 0")
    scores = x[::20] @ x.T
    got = {}
    for r in neighbours.nearest(rows, asked, 5, "id", "v", "id", "v", 16, block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for k, q in enumerate(range(0, 400, 20)):
        assert [i for _, i in sorted(got[q])] == np.argsort(-scores[k], kind="stable")[:5].tolist()
    pairs = {(r.query_id, r.id) for r in neighbours.similarity_join(rows, asked, 0.4, "id", "v", "id", "v", 16, block).collect()}
    capped = neighbours.similarity_join(rows, asked, 0.4, "id", "v", "id", "v", 16, block, cap=2).collect()
    for k in range(20):
        want = [i for i in np.argsort(-scores[k], kind="stable")[:2].tolist() if scores[k, i] >= np.float32(0.4)]
        assert sorted(r.id for r in capped if r.query_id == 20 * k) == sorted(want)
    assert pairs == {(20 * k, i) for k, i in zip(*np.nonzero(scores >= np.float32(0.4)), strict=True)}


@pytest.mark.parametrize("n,d", [(800, 32), (400, 64)])
def test_recall(spark, n, d):
    x = unit(n, d, seed=2)
    rows = table(spark, x)
    index = ann.fit(rows, "v", "id")
    found = index.search(index.assign(rows, "v"), rows.where("id % 20 = 0"), 10, "id", "v", "id", "v").collect()
    truth = {20 * k: set(np.argsort(-s, kind="stable")[:10].tolist()) for k, s in enumerate(x[::20] @ x.T)}
    hits = sum(r.id in truth[r.query_id] for r in found)
    assert hits / (10 * len(truth)) >= 0.9
    first = {r.query_id: r.id for r in found if r["rank"] == 1}
    assert all(first[q] == q for q in truth)


def test_ties_and_empty(spark):
    rows = table(spark, np.ones((5, 4), np.float32) / 2)
    got = neighbours.nearest(rows, rows.where("id = 3"), 2, "id", "v", "id", "v", 4).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 1]
    none = rows.where("v IS NULL")
    assert neighbours.nearest(rows, none, 2, "id", "v", "id", "v", 4).count() == 0 and ann.fit(none, "v", "id").probes == 1
