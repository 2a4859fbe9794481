"""Token-id output: concatenated ids with Elias-Fano document boundaries, in ascending id order.

File format. A store is a Parquet table with one row per chunk, in as many files as there were
partitions. A chunk holds up to ``chunk_tokens`` ids of consecutive documents (one longer document
stands alone):

    part, seq   place of the chunk in the store: order by both
    n_docs, n_tokens, base (ids in the part before the chunk), width (bytes of an id)
    first_id, last_id  smallest and largest id, by whose Parquet statistics lookups skip chunks
    boundaries  Elias-Fano sequence of n_docs + 1 local offsets, the first 0
    doc_ids     flag byte (1: the first ``nulls`` documents have a null id), 8 bytes smallest id,
                8 bytes ``nulls``, then the Elias-Fano sequence of the other ids less the smallest
    ids         little-endian unsigned 16-bit ids, or 32-bit where the vocabulary needs them

Global starts aren't stored: they are the ids in all parts before, plus the chunk's base, plus the
local boundary. Parquet gives the format atomic commits, retries of lost tasks and
reads of the small columns alone.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.llm import elias_fano
from semql.llm.common import batch_of, kept_in_worker, shared_path, table, text_slices
from semql.llm.tokens import WordIds, id_type


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What is left of such a text after A-Z and the like are lower-cased stays as it is under NFC.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]").search
#: Two signs side by side are one part for the tokenizer, so a text that has such isn't cut at signs.
#: Neither is one with control characters, at some of which str.split() cuts but the tokenizer does not.
_MARKS = bytes(33 if 33 <= b <= 126 and not chr(b).isalnum() else 1 if b in (*range(9), *range(14, 32), 127) else 32 for b in range(256))
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
_GROUP = 256


class Tokenizer:
    """Ids of whole texts as the tokenizers library gives them, without special tokens.

    A tokenizer that normalises white space to single spaces and drops it never joins what stands
    on its two sides, so texts are cut at white space and every word is encoded once. Texts in plain
    Latin letters are lower-cased first, and cut at points and commas too, where no signs stand together.
    """

    def __init__(self, spec: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library, parsed = Library.from_str(spec), json.loads(spec)
        flat = repr((parsed.get("normalizer"), parsed.get("pre_tokenizer")))
        self.by_words = "\\\\s+" in flat and "[^\\\\s\\\\p{L}\\\\p{N}]+" in flat and "'behavior': 'Removed', 'invert': True" in flat
        self.special = [t["content"] for t in parsed["added_tokens"]]
        suffix = parsed["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max([-1, *self.library.get_vocab().values()]) + 1, bool)
        self.ends[[i for t, i in parsed["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
        self.kind = id_type(len(self.ends))
        self.known = WordIds(self._words, self.kind, keep=1_000_000)
        self.odd = WordIds(self._library, self.kind, keep=100_000)

    def _library(self, words: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False))

    def _joined(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that end in a piece with the word-end mark: many go as one text, which is cut there."""
        groups = [parts[i : i + _GROUP] for i in range(0, len(parts), _GROUP)]
        found: list[bytes] = []
        for group, ids in zip(groups, self._library([" ".join(g) for g in groups]), strict=True):
            ids = np.asarray(ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                data, bounds = ids.tobytes(), (self.kind.itemsize * cuts).tolist()
                found += [data[a:b] for a, b in zip([0, *bounds], bounds)]
            else:
                found += [np.asarray(x, self.kind).tobytes() for x in self._library(group)]
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words in plain letters and signs."""
        cut = {w: _PARTS(w) for w in words if not _LETTERS(w)}
        parts = list(dict.fromkeys([*(w for w in words if w not in cut), *(p for c in cut.values() for p in c)]))
        ids = dict(zip(parts, self._joined(parts), strict=True))
        return [b"".join(map(ids.__getitem__, cut[w])) if w in cut else ids[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.asarray(ids, np.int64) for ids in self._library(texts)]
        marks = [t.encode().translate(_MARKS) for t in texts]
        plain = [b"\1" not in m and (t.isascii() or not _OTHER(t)) and not any(s in t for s in self.special) for t, m in zip(texts, marks, strict=True)]
        known = iter(self.known.of([_cut(t.lower(), b"!!" in m) for t, m, p in zip(texts, marks, plain, strict=True) if p]))
        odd = iter(self.odd.of([_SPACES(t) for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(known if p else odd) for p in plain]


def _cut(text: str, together: bool) -> list[str]:
    return text.split() if together else text.replace(",", " , ").replace(".", " . ").split()


_SPACES = re.compile("[^ \t\n\r]+").findall

_CHUNK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64()), ("width", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("boundaries", pa.binary()), ("doc_ids", pa.binary()), ("ids", pa.binary())])
_IDS = struct.Struct("<BqQ")


def pack_ids(ids: list[int | None]) -> bytes:
    """Ascending document ids, nulls first."""
    nulls = sum(i is None for i in ids)
    known = np.asarray(ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    return _IDS.pack(nulls > 0, least, nulls) + elias_fano.encode(known.astype(np.uint64) - np.int64(least).astype(np.uint64))


def open_ids(data: bytes) -> tuple[int, int, elias_fano.Reader]:
    """The smallest id, the number of nulls before it, and the ids less the smallest."""
    _, least, nulls = _IDS.unpack_from(data)
    return least, nulls, elias_fano.Reader(data[_IDS.size :])


def unpack_ids(data: bytes) -> list[int | None]:
    least, nulls, known = open_ids(data)
    return [None] * nulls + (known.all() + np.int64(least).astype(np.uint64)).astype(np.int64).tolist()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, chunk_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise ``docs`` and write them to ``path`` in ascending ``id_col`` order.

    Null texts are empty texts: they have the end id alone (or nothing); texts of any length are encoded
    whole. Null ids come first; rows that repeat an id all stay, next to each other, in the order of a
    hash of their texts, and may lie in several partitions, so one id may hold any share of the rows. Rows
    that are equal in both are told apart by their place in ``docs``. An empty table gives a store without
    chunks. Other columns aren't read. The tokenizer's file is read on the driver and sent to the workers (a
    file of a few MB).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.monotonically_increasing_id().alias("place"), F.col(text_col).alias("text"))
    key = uuid.uuid4().hex
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_in_worker(key, lambda: Tokenizer(spec.value))
        kind = id_type(max(len(tokenizer.ends), (end_id or 0) + 1))
        end = np.asarray([] if end_id is None else [end_id], kind)
        part, seq, base, held, ids, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def chunk() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(x) for x in held)])
            return batch_of(_CHUNK, [part], [seq], [len(held)], [n], [base], [kind.itemsize], [next((i for i in ids if i is not None), None)], [ids[-1]], [elias_fano.encode(ends)], [pack_ids(ids)], [b"".join(x.tobytes() for x in held)])

        for batch in text_slices(batches, max_bytes=4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, tokens in zip(batch.column("id").to_pylist(), tokenizer.encode(texts), strict=True):
                tokens = np.concatenate([tokens.astype(kind), end])
                if held and n + len(tokens) > chunk_tokens:
                    yield chunk()
                    seq, base, held, ids, n = seq + 1, base + n, [], [], 0
                held.append(tokens)
                ids.append(doc)
                n += len(tokens)
        if held:
            yield chunk()

    chunks = rows.repartitionByRange(parts, "id", "th", "place").sortWithinPartitions("id", "th", "place").mapInArrow(
        run, "part int, seq int, n_docs long, n_tokens long, base long, width int, first_id long, last_id long, boundaries binary, doc_ids binary, ids binary"
    )
    chunks.write.parquet(path)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a store: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``,
    ``ids_crc32`` (of the ids as little-endian 32-bit integers) and, if asked for, ``ids``.

    A document's length may change from one chunk to the next, but a chunk is whole in one row, so a
    task holds one chunk at a time. What the driver sees is a total for each written partition. Rows that repeat
    an id are one row each; of a store without chunks the result is empty.
    """
    chunks = spark.read.parquet(path)
    totals = sorted((r.part, r.n) for r in chunks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip((p for p, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))
    chunks = chunks.select("part", "n_docs", "base", "width", "boundaries", "doc_ids", "ids")
    schema = _DOCS.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ends = elias_fano.Reader(row["boundaries"]).values(0, row["n_docs"] + 1).astype(np.int64)
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                places = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                columns = [unpack_ids(row["doc_ids"]), before[row["part"]] + row["base"] + ends[:-1], np.diff(ends), [zlib.crc32(ids[a:b]) for a, b in places]]
                yield batch_of(schema, *columns, *[[ids[a:b].astype(np.int32) for a, b in places]] * with_ids)

    return chunks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fetch(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """``doc_id`` and ``ids`` of the documents with the given ids: a few, as they are listed in the filter.

    Chunks without any are skipped by their statistics; in the others positions are found by select, without decoding
    a chunk's sequences. Ids that aren't there give no row, ids that several documents have give one for each.
    """
    wanted = sorted(set(ids))
    near = F.lit(False)
    for i in wanted:
        near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    chunks = spark.read.parquet(path).where(near).select("width", "boundaries", "doc_ids", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                least, nulls, known = open_ids(row["doc_ids"])
                ends = elias_fano.Reader(row["boundaries"])
                tokens, found = np.frombuffer(row["ids"], f"<u{row['width']}"), []
                for i in (i for i in wanted if least <= i <= least + known.top):
                    at = known.first_at_least(i - least)
                    while at < known.n and known.select(at) == i - least:
                        found.append((i, tokens[ends.select(nulls + at) : ends.select(nulls + at + 1)].astype(np.int32)))
                        at += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return chunks.mapInArrow(run, "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read(spark, path)
