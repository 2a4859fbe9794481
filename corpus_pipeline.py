"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage is a function of the documents that its predecessor kept, and may be run on its own;
``run`` writes each stage's result to the shared checkpoint folder before the next one reads it, so a
lost executor costs no earlier stage, and removes it when the next one has been written.

Stages give an empty table for an empty one, take null, empty and very long texts, repeated rows and further columns
under any names, and return all columns of their documents but for the last, which returns what encoding makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.llm import decontaminate, line_dedup, near_copies, quality_rules, sentencepiece_codec
from semql.llm.common import cut, drop, set_aside, table
from semql.shipping import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules. Null and empty texts have fewer than 20 words and go; rows that
    repeat go or stay together; null languages and sources are groups of their own."""
    return quality_rules.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; ``n_chars`` counts what is left. Null texts come back empty; a
    text may lose all its lines; of rows that repeat an id each keeps its own text; a null id is before all others."""
    rows, restore = set_aside(docs, "doc_id", "text")
    out = restore(line_dedup.dedup_lines(rows))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of texts linked by at least 0.8 of their five-word shingles: by
    fingerprints first, then all other pairs. Texts without words are one group; rows that repeat id and text stay together."""
    ship(spark)
    return near_copies.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. Null and empty texts have none and stay, as all do with an empty benchmark."""
    ship(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids, decoded text and byte spans. Null and empty texts have no ids."""
    ship(spark)
    return sentencepiece_codec.encode(docs.select("doc_id", "text"), sentencepiece_codec.default_model(), result="ids")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode),
]

#: Near-dedup hashes with XXH64 and encoding follows a BPE model; SQL has neither, so tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
