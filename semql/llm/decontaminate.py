"""Benchmark decontamination with suffix arrays over shards of the documents.

A task cuts its documents into shards of bounded size. Words become numbers in the benchmark's own
vocabulary, zero for any other word. A shard's suffix array holds, in word order, its suffixes whose
first words are all in that vocabulary, as far as a window reaches: no other suffix can begin with a
window. Suffixes that share a whole window stand next to each other, in the order of the text: what follows a
window tells which of them match longest, not whether they are found. Every benchmark suffix is found by
binary search, all at once; the suffixes between its two bounds are its verbatim occurrences. They are
extended word by word to the longest matches, with their places on both sides.

The benchmark goes to the workers in blocks of bounded size, each of which is searched for in every
shard. A worker keeps a few of them and reads the others anew for each shard, and the driver makes one at a
time, so neither holds a large benchmark; what a worker's disk must hold is its serialised blocks. The
text of the documents is read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.llm.common import batch_of, byte_texts, set_aside, table, text_slices

WINDOW = 10
#: A word byte is a digit, a letter or part of a non-ASCII character; A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.asarray([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Odd, so that it has an inverse among the 64-bit integers.
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


@dataclass
class Words:
    """Words of several texts: 64-bit hashes, byte places in the joined and folded texts, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more entry than texts
    data: bytes
    text_at: np.ndarray

    def __getitem__(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def words_of(texts: list[bytes]) -> Words:
    """Split all texts at once; equal words have equal hashes, and the words themselves stay at hand."""
    data = b"\n".join([*texts, b""]).translate(_FOLD)
    codes = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[codes], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    # Sums of byte * base^place, block by block: a word's sum over base^(its start) doesn't depend on its place.
    hashes = np.zeros(len(starts), np.uint64)
    for at in range(0, len(codes), _STEP):
        block = codes[at : at + _STEP].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(block * _UP[: len(block)], out=total[1:])
        a, b = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(block))
        begin, end = np.maximum(starts[a:b] - at, 0), np.minimum(ends[a:b] - at, len(block))
        part = (total[end] - total[begin]) * _DOWN[begin]
        # What of a word lies in a later block counts on from the bytes before.
        before = np.maximum(at - starts[a:b], 0)
        hashes[a:b] += part * (_UP[np.minimum(before, _STEP - 1)] if (before < _STEP).all() else np.asarray([pow(_BASE, int(x), 1 << 64) for x in before], np.uint64))
    hashes ^= hashes >> np.uint64(29)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(hashes, starts, ends, np.searchsorted(starts, text_at), data, text_at)


class Block:
    """A part of the benchmark: its items' words as numbers, and its distinct windows in word order."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        words = words_of(texts)
        self.item_ids, self.window = ids, window
        self.vocabulary, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.spelled = [words[i] for i in first]
        self.numbers = (number + 1).astype(np.int64)
        self.bits = (len(self.vocabulary) + 1).bit_length()  # with room for one more than the last number
        self.each = 63 // self.bits
        items, places, sizes = [], [], []
        for item, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            size = min(window, b - a)
            for p in range(a, b - size + 1) if size else ():
                items.append(item), places.append(p), sizes.append(size)
        self.item, self.place, self.size = (np.asarray(x, np.int64) for x in (items, places, sizes))
        self.item_start = words.first
        self.least = int(self.size.min()) if len(self.size) else 0
        keys = packed(self.numbers, self.place, self.size, self)
        # Windows that items share are searched for once.
        _, self.one, self.which = np.unique(np.column_stack([keys, self.size]), axis=0, return_index=True, return_inverse=True)
        self.which = self.which.reshape(-1)
        self.keys, self.sizes = keys[self.one], self.size[self.one]
        order = np.argsort(self.which, kind="stable")
        self.occurs, self.occurs_at = order, np.searchsorted(self.which[order], np.arange(len(self.one) + 1))


def packed(numbers: np.ndarray, places: np.ndarray, sizes: np.ndarray | int, block: Block) -> np.ndarray:
    """The first ``window`` numbers from each place as a few integers, in the order of the words; zeros after ``sizes``."""
    columns = -(-block.window // block.each)
    out = np.zeros((len(places), columns), np.int64)
    for k in range(block.window):
        at = places + k
        value = np.where((k < sizes) & (at < len(numbers)), numbers[np.minimum(at, len(numbers) - 1)], 0) if len(numbers) else 0
        c, r = divmod(k, block.each)
        out[:, c] |= value << (block.bits * (block.each - 1 - r))
    return out


def _bound(suffixes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For every key the number of sorted suffixes before it: one binary search for all, column by column compared."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes))
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) >> 1, 0)
        less, equal = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for c in range(keys.shape[1]):
            value = suffixes[mid, c]
            less |= equal & (value < keys[:, c])
            equal &= value == keys[:, c]
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def _runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ranges, and the members of all ranges one after the other."""
    size = end - begin
    which = np.repeat(np.arange(len(begin)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def occurrences(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard's words in numbers, then distinct windows and the words where they occur."""
    at = np.searchsorted(block.vocabulary, words.hashes)
    known = block.vocabulary[np.minimum(at, len(block.vocabulary) - 1)] == words.hashes
    numbers = np.where(known, at + 1, 0)
    # Words that follow, all known and in the same text.
    stop = np.sort(np.concatenate([np.flatnonzero(~known), words.first[1:]]), kind="stable")
    place = np.flatnonzero(known)
    reach = stop[np.searchsorted(stop, place, "right")] - place if len(place) else place
    place, reach = place[reach >= block.least], reach[reach >= block.least]
    keys = packed(numbers, place, np.minimum(reach, block.window), block)
    order = np.lexsort(keys.T[::-1])
    array, suffixes = place[order], keys[order]  # the suffix array and what it is ordered by
    # The suffixes that begin with a window lie before the window with its last number raised by one.
    c, r = np.divmod(block.sizes - 1, block.each)
    after = block.keys.copy()
    after[np.arange(len(c)), c] += np.int64(1) << (block.bits * (block.each - 1 - r))
    which, member = _runs(_bound(suffixes, block.keys), _bound(suffixes, after))
    return numbers, which, array[member]


def _checked(words: Words, block: Block, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether occurrences are verbatim: hashes may meet by chance, so the words themselves are compared."""
    good = np.ones(len(which), bool)
    for i, (w, q) in enumerate(zip(which.tolist(), at.tolist(), strict=True)):
        p = int(block.place[block.one[w]])
        numbers = block.numbers[p : p + int(block.sizes[w])].tolist()
        good[i] = all(words[q + k] == block.spelled[n - 1] for k, n in enumerate(numbers))
    return good


@dataclass
class Found:
    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[set]
    n_matches: np.ndarray
    longest: np.ndarray
    matches: list[list[tuple]]


def search(texts: list[bytes], blocks: Iterable[Block], with_matches: bool = False, with_longest: bool = False) -> Found:
    """What a shard has of the benchmark, by text. ``with_longest`` counts matches and keeps the length of the longest only."""
    words = words_of(texts)
    n, count = len(texts), np.diff(words.first)
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    items: list[set] = [set() for _ in range(n)]
    matches: list[list[tuple]] = [[] for _ in range(n)]
    n_matches, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for block in blocks:
        if not len(block.keys):
            continue
        numbers, which, at = occurrences(words, block)
        good = _checked(words, block, which, at)
        which, at = which[good], at[good]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.sizes[which], -1)
        text = np.searchsorted(words.first, at, "right") - 1
        for w, t in np.unique(np.column_stack([which, text]), axis=0).tolist():
            items[t].update(block.item_ids[i] for i in set(block.item[block.occurs[block.occurs_at[w] : block.occurs_at[w + 1]]].tolist()))
        for t, *match in _matches(words, block, numbers, which, at, text) if with_matches or with_longest else ():
            n_matches[t] += 1
            longest[t] = max(longest[t], match[3])
            if with_matches:
                matches[t].append(tuple(match))
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return Found(count, hit[words.first[1:]] - hit[words.first[:-1]], items, n_matches, longest, matches)


def _matches(words: Words, block: Block, numbers: np.ndarray, which: np.ndarray, at: np.ndarray, text: np.ndarray, step: int = 4096) -> Iterator[tuple]:
    """Longest matches: occurrences that don't go on to the left, extended to the right."""
    for i in range(0, len(which), step):
        w = which[i : i + step]
        k, o = _runs(block.occurs_at[w], block.occurs_at[w + 1])
        o, q, t = block.occurs[o], at[i : i + step][k], text[i : i + step][k]
        p, item = block.place[o], block.item[o]
        left = (q > words.first[t]) & (p > block.item_start[item])
        left &= numbers[np.maximum(q - 1, 0)] == block.numbers[np.maximum(p - 1, 0)]
        q, p, t, item, size = q[~left], p[~left], t[~left], item[~left], block.size[o[~left]]
        while True:
            more = (q + size < words.first[t + 1]) & (p + size < block.item_start[item + 1])
            more &= numbers[np.minimum(q + size, len(numbers) - 1)] == block.numbers[np.minimum(p + size, len(block.numbers) - 1)]
            if not more.any():
                break
            size = size + more
        for a, b, x, y, z in zip(t.tolist(), item.tolist(), q.tolist(), p.tolist(), size.tolist(), strict=True):
            at_byte = int(words.text_at[a])
            yield a, block.item_ids[b], y - int(block.item_start[b]), x - int(words.first[a]), z, int(words.starts[x]) - at_byte, int(words.ends[x + z - 1]) - at_byte


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Broadcast blocks of about ``block_bytes`` of text each; the driver holds one at a time."""
    sc, blocks, ids, texts, size = benchmark.sparkSession.sparkContext, [], [], [], 0

    def close() -> None:
        if ids:
            blocks.append(sc.broadcast(Block(list(ids), list(texts), window)))

    for row in benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        data = row.t.encode()
        if ids and size + len(data) > block_bytes:
            close()
            ids, texts, size = [], [], 0
        ids.append(row.i), texts.append(data)
        size += len(data)
    close()
    return blocks


#: Blocks that a worker keeps from shard to shard.
KEPT_BLOCKS = 8


def _held(blocks: list, kept: int) -> Iterator[Block]:
    """Block by block; of all but the first ``kept`` a worker holds one at a time."""
    for i, b in enumerate(blocks):
        yield b.value
        if i >= kept:
            b.__dict__.pop("_value", None)  # a worker's copy; the next use reads it from disk again


_OUT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())])
_LONGEST = pa.schema([("n_matches", pa.int64()), ("longest_match", pa.int64())])
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_matches: bool = False, with_longest: bool = False, keep_text: bool = False, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20, shard_bytes: int = 8 << 20, kept_blocks: int = KEPT_BLOCKS,
) -> DataFrame:
    """``docs`` with what their texts share with the benchmark, without ``text_col`` unless ``keep_text``.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence of ``window`` consecutive words of an item;
    an item of fewer words is one window), ``n_items``, ``items_sha256`` (over the ids of the items found,
    sorted as strings and joined by commas), ``contaminated``, with ``with_longest`` ``n_matches`` and
    ``longest_match`` (its words), and with ``with_matches`` ``matches``: the longest verbatim matches, each with item, first words on both sides, length and byte span in the text. A match is one
    that goes on to neither side; where a text has an item's words several times, each is one.

    Rows repeat as they do in the input; an empty table gives an empty table; a text larger than a shard is a shard of
    its own. Null and empty texts have no words and no hits; items without words have no windows; null item ids
    read "null"; items that repeat an id count once. An empty benchmark marks nothing. Inputs named as
    an added column are replaced.
    """
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    out = pa.schema([*_OUT, *(_LONGEST if with_longest else ()), *([pa.field("matches", pa.list_(_MATCH))] if with_matches else ())])
    kept = [c for c in docs.columns if c not in (*out.names, "contaminated") and (keep_text or c != text_col)]
    name = text_col if keep_text else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, name, shard_bytes):
            found = search(byte_texts(batch.column(name)), _held(blocks, kept_blocks), with_matches, with_longest)
            names = [sorted({"null" if i is None else str(i) for i in s}) for s in found.items]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            columns = [found.n_words, found.n_hit, [len(x) for x in names], digests]
            if with_longest:
                columns += [found.n_matches, found.longest]
            if with_matches:
                keys = [f.name for f in _MATCH]
                columns.append([[dict(zip(keys, (str(m[0]), *m[1:]), strict=True)) for m in row] for row in found.matches])
            new = batch_of(out, *columns)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *new.columns], names=[*kept, *out.names])

    rows = docs.select(*kept) if keep_text else docs.select(*kept, docs[text_col].alias("__text"))
    types = {"items_sha256": "string", "matches": "array<struct<item:string,item_word:long,doc_word:long,n_words:long,begin:long,end:long>>"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{n} {types.get(n, 'long')}" for n in out.names)])
    return rows.mapInArrow(run, schema).withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold any window of the benchmark; all columns stay as they are."""
    rows, restore = set_aside(docs, text_col)
    found = contamination(rows, benchmark, keep_text=True, text_col=text_col, **options)
    return restore(found.where(~F.col("contaminated")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_longest=True)


_SPLIT = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH item AS (SELECT row_number() OVER () AS item, item_id, {_SPLIT} AS w FROM benchmark),
item_place AS (SELECT item, item_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS win
               FROM (SELECT item, item_id, w, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p
                     FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
doc_window AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS win
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
                     FROM doc, (SELECT DISTINCT m FROM item_place) WHERE len(w) >= m)),
found AS (SELECT doc_id, m, d.p, item, item_id, d.p - i.p AS ahead FROM doc_window d JOIN item_place i USING (m, win)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS word FROM (SELECT DISTINCT doc_id, m, p FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id),
run AS (SELECT doc_id, m, item, ahead, p - row_number() OVER (PARTITION BY doc_id, item, ahead ORDER BY p) AS run FROM found),
longest AS (SELECT doc_id, count(*) AS n_matches, max(n + m - 1) AS longest_match FROM (SELECT doc_id, m, count(*) AS n FROM run GROUP BY doc_id, m, item, ahead, run) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_matches, 0) AS n_matches, coalesce(longest_match, 0) AS longest_match
FROM doc d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN longest l ON l.doc_id = d.doc_id
"""
