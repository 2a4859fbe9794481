import hashlib

import pytest
from fixtures import CLASHING, PROSE, ROWS, SCHEMA
from pyspark.sql import functions as F

import corpus_pipeline as cp
from semql.llm import sentencepiece_codec

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with everything, columns under clashing names among them, and a benchmark."""
    base = tmp_path_factory.mktemp("tables")
    prose = [(300 + i, f"{' '.join(f'term{(i * 11 + k * k) % 499}' for k in range(80))}.\nline of number {i} alone", "en", "a") for i in range(30)]
    copies = [(400 + i, PROSE[0] + " " + PROSE[1], "en", "b") for i in range(5)]
    leaked = [(500, PROSE[1] + " and here is the passage: " + PROSE[2] + " with more words after it", "en", "b")]
    rows = [*ROWS, *prose, *copies, *leaked]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHING:
        frame = frame.withColumn(c, F.lit(f"own {c}"))
    frame.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, PROSE[2]), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return f"file://{base}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, folder))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(r[c] == f"own {c}" for r in docs.collect() for c in CLASHING)
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
        seen.append({r.doc_id for r in docs.collect()})
        if len(seen) == 3:
            worded = {r.doc_id for r in docs.collect() if (r.text or "").strip()}
            # Of five copies one has kept its lines; of all texts that have none left, one document stays.
            assert len(worded & set(range(400, 405))) == 1 and len(seen[2] - worded) <= 1
    assert set(range(300, 330)) <= seen[-1]
    assert 8 not in seen[0]  # one word again and again
    assert 500 not in seen[3]
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece encoding"]


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = cp.cut(stage(spark, docs, DATA))
    texts = {r.doc_id: r.text for r in docs.collect()}
    with open(sentencepiece_codec.default_model(), "rb") as f:
        library = sentencepiece_codec.Codec(f.read()).library
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in cp.run(spark, DATA).collect()}
    assert got == {i: (len(ids), ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()) for i, ids in ((i, library.encode(t or "")) for i, t in texts.items())}
