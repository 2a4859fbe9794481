"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows and virtual nodes are hashed to places on a ring; a row belongs to the first node at or after its
place, and to that node's shard while it has room. Rows beyond that go on clockwise to the next shard with
room. With room for exactly all rows, shares differ by one row at most.

How many rows each arc of the ring sends where follows from the arcs' row counts alone: a table of
one row per virtual node, whose size the parameters fix. The driver settles that flow, and gets back
ranges: rows a to b of an arc, in ring order, go to shard s from slot t on. Rows then find their
range by their rank in the arc, which is their place among its rows in a partition of the sorted table and the
number of such rows in partitions before. Nothing else is gathered, and no shard, arc or id is ever one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semql.llm.common import cut, set_aside, table

NODES = 64
_SPAN = 1 << 32


def _place(*values: Column) -> Column:
    """A place on the ring, which has 2^32 of them."""
    return F.pmod(F.xxhash64(*values), F.lit(_SPAN))


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """Places of the virtual nodes, in order, with their shards; ``nodes`` for each shard."""
    rows = spark.range(shards * nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    found = rows.select(_place(F.lit("node"), "shard", "node").alias("place"), "shard").collect()
    return sorted((r.place, r.shard) for r in found)


def flow(ring_: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(arc, first rank, end rank, shard, first slot)`` that put each arc's rows into shards with room.

    First every arc fills its own shard, in ring order; then what is left of each goes on clockwise.
    Passing over full shards is remembered, so the work is nearly in proportion to the arcs.
    """
    used, ranges, left, size = [0] * len(room), [], [], len(ring_)  # room taken, result, rows to pass on, arcs

    def put(arc: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n > 0:
            ranges.append((arc, first, first + n, shard, used[shard]))
            used[shard] += n
        return max(n, 0)

    for arc in range(size):
        n = counts.get(arc, 0)
        taken = put(arc, 0, n, ring_[arc][1])
        if taken < n:
            left.append((arc, taken, n))
    after = list(range(1, size + 1))  # of each node, the next one that may have room

    def find(node: int) -> int:
        path = []
        while used[ring_[node][1]] >= room[ring_[node][1]]:
            path.append(node)
            node = after[node] % size
        for p in path:
            after[p] = node
        return node

    for arc, first, n in left:
        while first < n:
            node = find(arc)
            first += put(arc, first, n - first, ring_[node][1])
    return ranges


def ranked(rows: DataFrame) -> DataFrame:
    """Rows sorted by ``__arc``, with the number ``__part`` of their partition and ``__place``, their number among its rows of the arc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            arcs = batch.column("__arc").to_numpy()
            if not len(arcs):
                continue
            first = np.flatnonzero(np.diff(arcs, prepend=arcs[0] - 1))
            place = np.arange(len(arcs)) - np.repeat(first, np.diff([*first, len(arcs)]))
            place[: first[1] if len(first) > 1 else None] += seen if arcs[0] == last else 0
            last, seen = arcs[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(arcs), part, np.int32)), pa.array(place)], names=[*batch.schema.names, "__part", "__place"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("__part", T.IntegerType()), T.StructField("__place", T.LongType())]))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    With ``slack`` 0 shards have room for the rows and no more: the first ``n mod shards`` shards for one row
    more than the others. A larger one gives each room for ``1 + slack`` times its share, so fewer rows
    move when shards or rows are added. Ids place rows on the ring. Rows that repeat an id share a place and
    follow each other by a hash of all their columns; equal rows follow each other as they come, so one id may
    hold any share of the rows. Null ids are one more id. Texts may be of any length, but travel along: give the
    columns that are wanted. Columns named ``shard`` or ``slot`` are replaced; an empty table gives an empty table.
    The driver sees the row counts of virtual nodes, each by the partitions of the sorted table that it reaches into.
    """
    spark = docs.sparkSession
    circle = ring(spark, shards, nodes)
    places = np.asarray([p for p, _ in circle], np.int64)

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        """Number of the first node at or after the place; past the last one comes the first."""
        return pd.Series(np.searchsorted(places, at.to_numpy()) % len(places)).astype("int32")

    rows, restore = set_aside(docs.drop("shard", "slot"), id_col)
    whole = F.xxhash64(*[c if t.find("map<") < 0 else F.to_json(c) for c, t in rows.dtypes])
    placed = rows.withColumns({"__at": _place(F.lit("row"), F.col(id_col)), "__whole": whole, "__as_come": F.monotonically_increasing_id()})
    placed = placed.withColumn("__arc", arc_of("__at"))
    order = ["__arc", "__at", id_col, "__whole", "__as_come"]
    placed = cut(ranked(placed.repartitionByRange(*order).sortWithinPartitions(*order)).drop(*order[1:2], *order[3:]), "ring-order")
    # Sorted, so each partition adds at most one row beyond one for each arc.
    pieces = sorted(placed.groupBy("__arc", "__part").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    before = []
    for arc, part, n in pieces:
        before.append((arc, part, counts.get(arc, 0)))
        counts[arc] = counts.get(arc, 0) + n
    n = sum(counts.values())
    room = [math.ceil((1 + slack) * n / shards)] * shards if slack else [n // shards + (s < n % shards) for s in range(shards)]
    # At most two ranges an arc and one a shard: their number is fixed by the parameters. Those of one arc and partition that overlap, by place there.
    ranges: dict[int, list[tuple]] = {}
    for arc, *found in flow(circle, counts, room):
        ranges.setdefault(arc, []).append(found)
    held = []
    for (arc, part, at), (_, _, size) in zip(before, pieces, strict=True):
        for first, end, shard, slot in ranges.get(arc, ()):
            if first < at + size and end > at:
                held.append((arc, part, max(first - at, 0), end - at, shard, slot + at - first))
    table_ = spark.createDataFrame(held, "__arc int, __part int, __first long, __end long, __shard int, __slot long")
    inside = (placed["__arc"] == table_["__arc"]) & (placed["__part"] == table_["__part"]) & (placed["__place"] >= table_["__first"]) & (placed["__place"] < table_["__end"])
    joined = placed.join(F.broadcast(table_), inside).withColumn("__slot", F.col("__slot") + F.col("__place"))
    return restore(joined.drop(table_["__arc"], table_["__part"]), "__shard", "__slot").withColumnsRenamed({"__shard": "shard", "__slot": "slot"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_rows(docs, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
