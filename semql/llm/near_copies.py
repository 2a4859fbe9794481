"""Near-dedup by SimHash fingerprints, and all other pairs by the prefixes of their shingle sets.

Texts are linked if the sets of their shingles have a Jaccard similarity of ``similarity`` or more, and
texts that links connect are one group. Links come from three searches, each of which leaves out what the ones
before have joined; every pair is compared shingle by shingle before it is a link:

    1  fingerprints of the shingles within two bits, by Golay keys, as in ``simhash``
    2  sets that share a prefix shingle, each with the least set that has it
    3  all sets that share a prefix shingle and are still in different groups

Fingerprints alone can't give all links: texts of similarity 0.8 differ in ten of 64 bits on average, and no Golay key
of three segments that stands so many errors tells texts apart. Prefixes can: with the shingles of every set in one
and the same order, two sets this similar share a shingle among the first ``n - ceil(similarity * n) + 1`` of each.
The order puts common shingles last, by counts of hash classes; any order finds the same pairs, and this one keeps
passages that many texts hold out of the keys.

Pairs of searches 2 and 3 must pass a sketch first, the parities of the numbers of shingles in 256 hash classes: a
shingle that only one of two sets has flips one bit, so sets differ in no fewer shingles than their sketches in bits.
Before the shingles themselves are joined to all pairs, longer sketches are, of four bits a shingle and more.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semql.llm import simhash
from semql.llm.common import byte_texts, cut, drop, only, same, text_slices, without
from semql.llm.components import components
from semql.llm.simhash import majority, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
_CLASSES = 1 << 16
#: 64-bit words of a sketch.
_WIDE = 4
_SKETCH = [f"p{i}" for i in range(_WIDE)]


def _hashes(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    return [np.asarray(shingle_hashes(t, words_each), np.uint64) for t in byte_texts(texts)]


def _sets(hashes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingles of each text as ascending hashes, and a hash of those."""
    from xxhash import xxh64_intdigest as digest

    sets = [np.unique(h) for h in hashes]
    return [s.view(np.int64) for s in sets], np.asarray([digest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def hashed(docs: DataFrame, id_col: str, text_col: str, words_each: int) -> DataFrame:
    """``id``, ``th`` (a hash of the text), ``sid``, a hash of the shingles, ``fp``, their fingerprint, and their sketch, of each
    row of ``docs``; and, in rows without these, how many shingles ``n`` of each ``class`` of hashes a task has met."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    names = ["id", "th", "sid", "fp", *_SKETCH, "class", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(_CLASSES, np.int64), pa.null()
        for batch in text_slices(batches):
            hashes = _hashes(batch.column("text"), words_each)
            sets, sids = _sets(hashes)
            total += np.bincount(np.concatenate(sets) & (_CLASSES - 1), minlength=_CLASSES)
            kind, none, made = batch.column("id").type, pa.nulls(len(sids), pa.int64()), sketches(sets)
            own = [batch.column("id"), batch.column("th"), pa.array(sids), pa.array([majority(h) for h in hashes], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(made[:, i].copy()) for i in range(_WIDE)), none, none], names=names)
        if met := np.flatnonzero(total).tolist():
            none = pa.nulls(len(met), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(met), kind), *[none] * (3 + _WIDE), pa.array(met, pa.int64()), pa.array(total[met])], names=names)

    return rows.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *(f"{n} long" for n in names[1:])]))


def class_counts(found: DataFrame) -> np.ndarray:
    counts = np.zeros(_CLASSES, np.int64)
    for r in found.where(F.col("class").isNotNull()).groupBy("class").agg(F.sum("n").alias("n")).collect():  # no more than _CLASSES rows
        counts[r["class"]] = r["n"]
    return counts


def parities(found: np.ndarray, bits: int) -> np.ndarray:
    """The parities of a set's numbers of shingles by class of hashes, ``bits`` of them in 64-bit integers."""
    return np.packbits((np.bincount((found >> 32) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """``_WIDE`` integers for each set."""
    return np.stack([parities(s, 64 * _WIDE) for s in sets])


def shingle_sets(texts: DataFrame, words_each: int) -> DataFrame:
    """``sid``, ``shingles`` and their longer sketch ``wide``, of four to eight bits a shingle, of each row of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda lists: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists)))
        for batch in text_slices(batches):
            sets, sids = _sets(_hashes(batch.column("text"), words_each))
            wide = [parities(s, 1 << max(6, (4 * len(s) - 1).bit_length())) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sids), of(sets), of(wide), pa.array([len(s) for s in sets], pa.int64())], names=["sid", "shingles", "wide", "n"])

    return texts.mapInArrow(run, "sid long, shingles array<long>, wide array<long>, n long")


def prefixes(texts: DataFrame, words_each: int, counts: np.ndarray, share: Fraction) -> DataFrame:
    """``key``, ``sid``, size and place for the first shingles of each set, the rarest ones by ``counts``."""
    kept = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets, sids = _sets(_hashes(batch.column("text"), words_each))
            sizes, hashes = np.asarray([len(s) for s in sets], np.int64), np.concatenate(sets)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((hashes, kept.value[hashes & (_CLASSES - 1)], row))
            place = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[row]
            first = place < (sizes + (-share.numerator * sizes // share.denominator) + 1)[row]
            row, found = row[first], hashes[order][first]
            columns = [pa.array(found), pa.array(sids[row]), pa.array(sizes[row].astype(np.int32)), pa.array(place[first].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "sid", "n", "place"])

    return texts.mapInArrow(run, "key long, sid long, n int, place int")


def _held_twice(keyed: DataFrame) -> DataFrame:
    """``keyed`` without most keys of a single set: sorted in ranges, which may part a key, rows stay that have an equal key beside them or end a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, sid = batch.column("key").to_numpy(), batch.column("sid").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            key, at = key[new], np.flatnonzero(new)
            twin = np.ones(len(key), bool)
            twin[1:-1] = (key[1:-1] == key[:-2]) | (key[1:-1] == key[2:])
            yield batch.take(pa.array(at[twin]))

    return keyed.repartitionByRange("key", "sid").sortWithinPartitions("key", "sid").mapInArrow(run, keyed.schema).distinct()


def _similar(common: Column, a: Column, b: Column, share: Fraction) -> Column:
    """Whether ``common`` of sizes ``a`` and ``b`` make a Jaccard similarity of ``share``, in whole numbers."""
    return (share.numerator + share.denominator) * common >= share.numerator * (a + b)


def _possible(share: Fraction) -> Column:
    """Whether two rows with one key may be of similar sets: the places of the key leave room enough, as they do for
    the first shingle that such a pair shares, and the sketches differ in no more bits than the sets may in shingles."""
    n, n2 = F.col("n").cast("long"), F.col("n2").cast("long")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}2"))) for p in _SKETCH))
    near = (share.numerator + share.denominator) * apart <= (share.denominator - share.numerator) * (n + n2)
    return _similar(F.least(n - F.col("place"), n2 - F.col("place2")), n, n2, share) & near


def _folded(wide: Column, size: Column) -> Column:
    """A sketch of twice as many integers as ``size`` folded to that many: classes of a hash's lower bits are sums of those of more bits."""
    # Bits are packed from the highest down, so integer i of the shorter one stands for classes that lie in i and in size + i of the longer.
    return F.when(F.size(wide) <= size, wide).otherwise(F.zip_with(F.slice(wide, 1, size), F.slice(wide, size + 1, size), lambda a, b: a.bitwiseXOR(b)))


def _apart(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ; sizes more than twice apart make it nothing, and the sets are compared."""
    size = F.least(F.size(x), F.size(y))
    bits = F.zip_with(_folded(x, size), _folded(y, size), lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * size, F.aggregate(bits, F.lit(0).cast("long"), lambda total, n: total + n)).otherwise(F.lit(0).cast("long"))


def _links(pairs: DataFrame, docs: DataFrame, least: DataFrame, id_col: str, text_col: str, words_each: int, share: Fraction) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough; sets are made anew for these alone."""
    pairs = cut(pairs.distinct(), "pairs")
    sids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    named = cut(least.join(sids, "sid", "left_semi").select("least.id", "least.th"), "named")
    texts = only(docs, named, id_col, text_col).select(F.col(text_col).alias("text"))
    sets = cut(shingle_sets(texts, words_each).dropDuplicates(["sid"]), "sets")

    def joined(pairs: DataFrame, column: str) -> DataFrame:
        one = lambda name, value, size: sets.select(F.col("sid").alias(name), F.col(column).alias(value), F.col("n").alias(size))
        return pairs.join(one("a", "x", "nx"), "a").join(one("b", "y", "ny"), "b")

    bound = (share.denominator - share.numerator) * (F.col("nx") + F.col("ny"))
    near = cut(joined(pairs, "wide").where((share.numerator + share.denominator) * _apart(F.col("x"), F.col("y")) <= bound).select("a", "b"), "near")
    common = F.size(F.array_intersect("x", "y"))
    found = cut(joined(near, "shingles").where(_similar(common, F.col("nx"), F.col("ny"), share)).select("a", "b"), "similar")
    drop(pairs, named, sets, near)
    return found


def _by_fingerprint(fps: DataFrame) -> DataFrame:
    """Pairs of the sets of ``fps(sid, fp)``: each set with the least one of its fingerprint, and those of fingerprints within two bits."""
    first = cut(fps.groupBy("fp").agg(F.min("sid").alias("first")), "fingerprints")
    equal = fps.join(first, "fp").where(F.col("sid") != F.col("first")).select(F.col("first").alias("a"), F.col("sid").alias("b"))
    near = simhash.links(first).toDF("fp", "other").join(first, "fp").select(F.col("first").alias("a"), F.col("other").alias("fp")).join(first, "fp")
    return equal.union(near.select("a", F.col("first").alias("b")))


def groups(docs: DataFrame, found: DataFrame, least: DataFrame, id_col: str, text_col: str, words_each: int, similarity: float) -> DataFrame:
    """``sid`` and ``root``, the least sid of its group, of all sets that are linked to another; ``found`` has the hashes
    of all texts, ``least`` names a row of each set."""
    share, texts = Fraction(str(similarity)), docs.select(F.col(text_col).alias("text"))
    every = cut(prefixes(texts, words_each, class_counts(found), share), "prefixes")
    twice = cut(_held_twice(every), "keys")
    shared = twice.groupBy("key").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).where(F.col("first") != F.col("last"))
    keyed = cut(twice.join(shared.select("key"), "key").join(least.select("sid", *_SKETCH), "sid"), "shared-keys")
    drop(every, twice)
    columns = ["sid", "n", "place", *_SKETCH]
    other = lambda rows: rows.toDF(*(c if c == "key" else f"{c}2" for c in rows.columns))
    pair = [F.col("sid2").alias("a"), F.col("sid").alias("b")]
    check = lambda pairs: _links(pairs, docs, least, id_col, text_col, words_each, share)

    # Only sets with a shared prefix shingle can be similar to another.
    fps = cut(least.join(keyed.select("sid").distinct(), "sid", "left_semi").select("sid", "fp"), "fingerprints")
    first = keyed.groupBy("key").agg(F.min(F.struct(*columns)).alias("f")).select("key", *[F.col(f"f.{c}") for c in columns])
    with_first = keyed.join(other(first), "key").where((F.col("sid") != F.col("sid2")) & _possible(share)).select(*pair)
    links = check(_by_fingerprint(fps).union(with_first))
    roots = components(links).select(F.col("node").alias("sid"), "root")
    rooted = cut(keyed.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")).select("key", *columns, "root"), "rooted-keys")
    drop(keyed, fps)
    more = check(rooted.join(other(rooted), "key").where((F.col("sid2") < F.col("sid")) & (F.col("root") != F.col("root2")) & _possible(share)).select(*pair))
    drop(rooted)
    return components(links.union(more)).select(F.col("node").alias("sid"), "root")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group: the one of the smallest id (a null id first).

    Texts without words (null, empty, white space) are one group; texts with fewer words than a shingle are one
    shingle. Rows that share id and text are one document and stay together; of different texts under the smallest id
    one stays. A similarity equal to the limit links. Long texts count with all their shingles; a set of them and a pair
    of sets are the largest things that a task holds. An empty table gives an empty table. Texts are read several
    times rather than their shingles written.
    """
    found = cut(hashed(docs, id_col, text_col, words_each), "hashed")
    rows = found.where(F.col("sid").isNotNull())
    facts = [F.min("fp").alias("fp"), *(F.min(p).alias(p) for p in _SKETCH)]
    least = cut(rows.groupBy("sid").agg(F.min(F.struct("id", "th")).alias("least"), *facts), "least")
    linked = groups(docs, found, least, id_col, text_col, words_each, similarity)
    rooted = cut(least.join(linked, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    # All rows but those of each group's first document go: a group of equal texts may hold any share of the rows.
    gone = rows.join(rooted.select("sid", "root"), "sid").join(first, "root").where(~(same(F.col("id"), F.col("first.id")) & (F.col("th") == F.col("first.th"))))
    gone = cut(gone.select("id", "th").distinct(), "gone")
    drop(found, least, rooted, linked)
    return without(docs, gone, id_col, text_col)
