"""Small tables with everything that operators must stand: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

from pyspark.sql import types as T

PROSE = [
    "The quick brown fox jumps over the lazy dog near the river bank while the sun sets slowly behind the green hills of the old town",
    "Many people walk along the narrow streets every morning and buy fresh bread from the small bakery next to the market square today",
    "A long line that several documents share, word for word.",
]
CLASHING = ["id", "th", "fp", "n_words", "n_lines", "n_dropped", "score", "shard", "slot", "ids", "contaminated", "kept", "features", "best", "held_out", "part", "line"]

ROWS = [
    (1, f"{PROSE[0]}\n{PROSE[2]}\nown line number one", "en", "a"),
    (2, f"{PROSE[1]}\n  {PROSE[2].upper()}\t\nown line number two", "en", "a"),
    (3, f"{PROSE[0]}\n{PROSE[2]}\nown line number one", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \t\n \x0b\x0c\r ", "en", "b"),
    (7, "é" * 10 + "\n" + "é" * 10 + "\n日本語 テスト 😀 ▁▁ <s> </s>", "fr", "b"),
    (8, "word " * 30_000, "en", "c"),
    (9, "Short.", "en", "c"),
    (9, "Short.", "en", "c"),
    (9, "Another text under the same id, with some more words in it.", "de", "c"),
    (None, f"{PROSE[2]}\nno id here", "en", "c"),
    (None, None, None, None),
    (10, "ÀÉÎ ñandú\x00 \x1c x \x85 y   12345 don't rock'n'roll!! ...", "es", "d"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows=ROWS):
    """The same rows with columns under names that operators give to their own."""
    schema = T.StructType([*SCHEMA, *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(*r, *[f"own {c}" for c in CLASHING]) for r in rows], schema)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
