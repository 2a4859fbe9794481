"""Quality classifier: an additive model over counts and shares of each text.

The features of a text need one pass over its bytes and one over its words. The model is fitted on a
sample of labelled rows, at most ``MAX_ROWS``, in the order of a hash of their ids; every text is scored whole.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.llm import additive_model
from semql.llm.common import batch_of, byte_texts, table, text_slices

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 20_000
THRESHOLD = 0.7


def _class(members: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(members))


_UPPER, _DIGIT, _SPACE = (_class(x.encode()) for x in (string.ascii_uppercase, string.digits, string.whitespace))
_MARKS, _CALLS, _SIGNS = _class(b".,;:'\"()-"), _class(b"!?"), _class(b"#*$%&|<>@^~_=+{}[]\\/`")
_HIGH = np.arange(256) >= 128

FEATURES = [
    "log_words", "word_length", "longest_word", "distinct_words", "top_word", "echoes", "upper", "digits", "marks", "calls", "signs",
    "non_ascii", "log_lines", "line_words", "same_lines", "marked_words", "bare_words",
]


def features(text: bytes) -> list[float]:
    """The features of one text; all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    black = int(size[~_SPACE].sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    counts = Counter(words)
    signs = b"!?#*$%&|<>"
    ends = Counter(w[-1] for w in words)
    return [
        np.log(n),
        black / n,
        min(60, max(map(len, counts))),
        len(counts) / n**0.8,  # about level in ordinary prose of any length
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        *(int(size[c].sum()) / black for c in (_UPPER, _DIGIT, _MARKS, _CALLS, _SIGNS, _HIGH)),
        np.log(len(lines)),
        min(200.0, n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(ends[c] for c in signs) / n,
        sum(k for w, k in counts.items() if not w.isalnum() and len(w) == 1) / n,
    ]


_FEATURES = pa.schema([("features", pa.list_(pa.float64()))])
_SCORE = pa.schema([("score", pa.float64())])


def _mapped(docs: DataFrame, text_col: str, added: pa.Schema, sql_type: str, of) -> DataFrame:
    kept = [c for c in docs.columns if c != text_col and c not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "__text"):
            new = batch_of(added, of([features(t) for t in byte_texts(batch.column("__text"))]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *new.columns], names=[*kept, *added.names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), f"{added.names[0]} {sql_type}"])
    return docs.select(*kept, docs[text_col].alias("__text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, **options) -> additive_model.Model:
    """Fit on the documents of at most ``max_rows`` rows of ``labels``, which are 0 or 1; nulls are left out.

    The sampled labels (ids and classes of ``max_rows`` rows) are the broadcast side of the join with the documents.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).orderBy(F.xxhash64(id_col), id_col, label_col).limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id").select("__y", "text")
    found = _mapped(rows, "text", _FEATURES, "array<double>", lambda x: x).toPandas().sort_values("__y", kind="stable")
    x = np.asarray(found["features"].tolist(), float).reshape(-1, len(FEATURES))
    return additive_model.fit(x, found["__y"].to_numpy(), **options)


def score(docs: DataFrame, model: additive_model.Model, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with ``score``, the probability of class 1.

    Null texts are empty ones, which score as the model's tables say for zeros. Rows repeat as they do
    in the input, equal texts with equal scores; an empty table gives an empty table; texts of any length are read
    whole. An input named ``score`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs, text_col, _SCORE, "double", lambda rows: sent.value.score(np.asarray(rows, float)))


def part_of(id_: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % parts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(part_of(F.col("doc_id"), 4) != 2)
    found = score(docs.withColumn("held_out", part_of(F.col("doc_id"), 4) == 2), train(docs, labels))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
