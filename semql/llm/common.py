"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.shared import cut, drop, shared_path

__all__ = ["ascii_lower", "batch_of", "byte_texts", "cut", "drop", "filter_of", "kept_in_worker", "let", "only", "same", "set_aside", "shared_path", "table", "text_slices", "without"]

#: ASCII white space, the class [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII values take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    A column that a lambda mentions is evaluated again for each element; a bound variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``used`` under names that no operator uses, and what undoes that.

    An operator's own columns then can't hide input columns of the same names. What undoes it may name columns to add.
    """
    names = {c: c if c in used else f"__c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*names.values())
    return renamed, lambda out, *more: out.select(*names.values(), *more).toDF(*names, *more)


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null; Spark still plans it as an equi-join."""
    return a.eqNullSafe(b)


#: Bits of one of Spark's bitmaps.
_BITMAP = 8 * 4096


def filter_of(rows: DataFrame, column: str, most_bits: int = 1 << 28) -> Callable[[Column], Column]:
    """A test that is true of every hash in ``column`` of ``rows``, and of few others, in built-in expressions.

    It is a set of bits, 16 for each row and ``most_bits`` at most, as a list of bitmaps in a table of one row: what goes to
    the tasks has that bound, and where it is too small for the rows the test holds for more other hashes.
    """
    spark, div = rows.sparkSession, lambda a, b: F.call_function("div", a, F.lit(b))
    buckets = max(1, min(most_bits, 1 << (16 * rows.count()).bit_length()) // _BITMAP)
    place = lambda hashes: F.pmod(hashes, F.lit(buckets * _BITMAP))
    at = place(F.col(column))
    bits = rows.select(div(at, _BITMAP).alias("bucket"), (at % _BITMAP).alias("place")).distinct().repartition("bucket")
    bits = bits.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    every = spark.range(buckets).join(bits, F.col("id") == F.col("bucket"), "left")
    in_order = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.unhex(F.repeat(F.lit("00"), _BITMAP // 8))).alias("bits"))))
    held = cut(every.agg(in_order.alias("all")).select(F.transform("all", lambda x: x["bits"]).alias("bits")), "filter").scalar()

    def holds(hashes: Column) -> Column:
        def test(at: Column) -> Column:
            byte = F.substring(F.element_at(held, (div(at, _BITMAP) + 1).cast("int")), (div(at % _BITMAP, 8) + 1).cast("int"), 1)
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1

        return test(place(hashes))

    return holds


def _told(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """``rows(id, th)`` under names of their own, their condition on ``docs``, and a test that finds them all among ``docs`` and few others."""
    named = rows.select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    th = F.xxhash64(docs[text_col])
    return named, same(docs[id_col], F.col("__id")) & (th == F.col("__th")), filter_of(rows, "th")(th)


def only(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of ``docs`` whose ids and text hashes are in ``rows(id, th)``; hardly any other is shuffled."""
    named, equal, maybe = _told(docs, rows, id_col, text_col)
    return docs.where(maybe).join(named, equal, "left_semi")


def without(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of ``docs`` whose ids and text hashes aren't in ``rows(id, th)``; of the others hardly any is shuffled."""
    named, equal, maybe = _told(docs, rows, id_col, text_col)
    return docs.where(~maybe).union(docs.where(maybe).join(named, equal, "left_anti"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each slice take about ``max_bytes``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = filled = 0
        for row, size in enumerate(sizes.tolist()):
            if filled and filled + size > max_bytes:
                yield batch.slice(begin, row - begin)
                begin, filled = row, 0
            filled += size
        yield batch.slice(begin)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KEPT: list = []


def kept_in_worker(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept in a Python worker from one task to the next; only the latest key's is."""
    if not _KEPT or _KEPT[0] != key:
        _KEPT[:] = [key, make()]
    return _KEPT[1]
