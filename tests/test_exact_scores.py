import numpy as np
import pytest

from semql.functions.embedders import HashingEmbedder, scaled_column
from semql.operators import neighbours
from semql.operators.scan import Match, VectorTable
from semql.sources.workspace import register_functions, register_search

E = HashingEmbedder()
WORDS = "red green blue apple pear plum house tree river stone".split()
TEXTS = [" ".join(np.random.default_rng(i).choice(WORDS, 3 + i % 40)) for i in range(300)]


def score(a, b):
    x, y = E.counts([a, b])
    return float(x @ y) / float(np.linalg.norm(x)) / float(np.linalg.norm(y))


@pytest.fixture(scope="module")
def rows(spark):
    found = spark.createDataFrame([*enumerate(TEXTS), (1000, None), (1001, "!!")], "i long, t string").repartition(3)
    return found.withColumn("made", scaled_column(found.t, E)).selectExpr("i", "t", "made.vector AS v", "made.length AS n").cache()


def vector_table(rows, threshold):
    return VectorTable(rows, {"t": "v"}, E, rowid="i", threshold=threshold, lengths={"t": "n"})


def test_text_scores_have_no_rounding_of_vectors(rows):
    query = TEXTS[7]
    found = vector_table(rows, -2.0).scan(Match("t", query + "/exact"))
    assert {r.i: r.t_score for r in found.collect()} == {**{i: score(t, query) for i, t in enumerate(TEXTS)}, 1001: 0.0}
    assert vector_table(rows, 0.0).columns == ["t"]


def test_threshold_and_ties_are_exact(rows):
    """Scores at the threshold stay, and equal ones come in the order of ids, at the cap too."""
    query = TEXTS[7]
    want = sorted(range(len(TEXTS)), key=lambda i: (-score(TEXTS[i], query), i))
    for k in (5, 40, 77):
        least = score(TEXTS[want[k - 1]], query)
        assert [r.i for r in vector_table(rows, least).scan(Match("t", f"{query}/hnsw:{k}")).orderBy("i").collect()] == sorted(want[:k])


def test_scores_in_sql_are_exact(spark, rows):
    register_functions(spark, E)
    rows.createOrReplaceTempView("semql_exact_test_data")
    register_search(spark, "semql_exact_test", vector_table(rows, 0.5))
    found = spark.sql("SELECT rowid, t_score FROM semql_exact_test_t_exact(:q, -2)", args={"q": TEXTS[7]}).collect()
    assert {r.rowid: r.t_score for r in found} == {**{i: score(t, TEXTS[7]) for i, t in enumerate(TEXTS)}, 1001: 0.0}


def test_joined_scores_are_exact(rows):
    asked = rows.where("i % 10 = 0 AND i < 1000")
    found = neighbours.similarity_join(rows, asked, 0.6, "i", "v", "i", "v", E.dim, length_col="n", query_length="n")
    want = {(q, i): score(t, TEXTS[q]) for q in range(0, 300, 10) for i, t in enumerate(TEXTS)}
    assert {(r.query_id, r.id): r.score for r in found.collect()} == {k: s for k, s in want.items() if s >= 0.6}
