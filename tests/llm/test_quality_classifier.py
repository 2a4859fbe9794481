import zlib

import numpy as np
import pytest
from fixtures import ROWS, clashing, docs, empty
from pyspark.sql import functions as F

from semql.llm import additive_model, quality_classifier as qc

DATA = "/root/testdata/sf0.01"


def test_additive_model_learns_curves_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    logit = 4 * np.abs(x[:, 0]) - 2 + 3 * np.sign(x[:, 1] * x[:, 2])
    y = rng.random(4000) < 1 / (1 + np.exp(-logit))
    model = additive_model.fit(x[:3000], y[:3000])
    p = model.score(x[3000:])
    best = 1 / (1 + np.exp(-logit[3000:]))
    assert ((p > 0.5) == (best > 0.5)).mean() > 0.9 and (1, 2) in model.pairs
    by_hand = np.full(1000, model.intercept)
    for f, (cuts, values) in enumerate(zip(model.cuts, model.tables, strict=True)):
        by_hand += [values[sum(v >= c for c in cuts)] for v in x[3000:, f]]
    for (i, j), values in zip(model.pairs, model.pair_tables, strict=True):
        by_hand += [values[sum(a >= c for c in model.pair_cuts[i]), sum(b >= c for c in model.pair_cuts[j])] for a, b in zip(x[3000:, i], x[3000:, j], strict=True)]
    assert np.allclose(p, 1 / (1 + np.exp(-by_hand)))


@pytest.mark.parametrize("y", [[], [1] * 5, [0, 1] * 3])
def test_few_rows(y):
    x = np.arange(3 * len(y), dtype=float).reshape(-1, 3)
    p = additive_model.fit(x, np.asarray(y)).score(np.zeros((2, 3)))
    assert ((0 < p) & (p < 1)).all()


def test_held_out_accuracy(spark):
    found = qc.query(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    held = found[found["held_out"]].merge(labels, on="doc_id")
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert found["score"].between(0, 1).all() and len(found) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_query_scores_by_hand(spark):
    """Every score of the query is the sum of its text's table entries, and every row has its part and class."""
    small = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    part = {i: zlib.crc32(str(i).encode()) % 4 for i in rows}
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = qc.train(spark.read.parquet(f"{small}/documents.parquet"), labels.where(F.col("doc_id").isin([i for i in part if part[i] != 2])))
    got = qc.query(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        x = qc.features(rows[r.doc_id].encode())
        total = model.intercept + sum(values[sum(v >= c for c in cuts)] for v, cuts, values in zip(x, model.cuts, model.tables, strict=True))
        for (i, j), values in zip(model.pairs, model.pair_tables, strict=True):
            total += values[sum(x[i] >= c for c in model.pair_cuts[i]), sum(x[j] >= c for c in model.pair_cuts[j])]
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
        assert (r.held_out, r.predicted) == (part[r.doc_id] == 2, int(r.score >= 0.7))


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (9, 1), (None, 1), (3, None), (77, 0)], "doc_id long, quality int")
    model = qc.train(docs(spark), labels)
    out = qc.score(clashing(spark), model).collect()
    assert len(out) == len(ROWS) and {r.features for r in out} == {"own features"} and all(0 <= r.score <= 1 for r in out)
    assert qc.score(empty(spark), model).count() == 0
    assert {r.score for r in qc.score(docs(spark), qc.train(docs(spark), labels.limit(0))).collect()} == {0.5}
