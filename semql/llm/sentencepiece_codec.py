"""SentencePiece encoding with the original byte span of every piece, and decoding.

The model's normaliser is applied with its source alignment: at each place the longest prefix that
the compiled character map knows is replaced, and every normalised byte remembers where its source
began. Pieces cover the normalised text without gaps, so their lengths project each of them to a
span of original bytes. Where the model's map is empty and no space is removed (the identity rule),
the alignment is made for a whole text at once, and words are encoded once and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from semql.llm.common import batch_of, kept_in_worker, table, text_slices
from semql.llm.tokens import WordIds, id_type

MARK = "▁"  # stands for a space in pieces
_MARK = MARK.encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """The compiled character map of a model: a double-array trie over byte strings, then its values.

    Layout: the trie's size in bytes (unsigned 32 bits, little endian), its 32-bit units, and the
    replacements, each ended by a zero byte; a leaf holds the offset of its replacement.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data[at:]``."""
        units, best = self.units, None

        def below(unit: int) -> int:  # bit 9 says that the offset is stored without its low byte
            return (unit >> 10) << 8 if unit & 0x200 else unit >> 10

        node = below(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= below(unit)
            if unit & 0x100:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.values[best[1] : self.values.index(b"\0", best[1])]


class Normalizer:
    """Normalisation with alignment, by the rules in a model's ``normalizer_spec``."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.dummy, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.identity = self.map is None and self.escape and not self.trim

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and the source offset of each of them, with the end as one more."""
        if not data:
            return b"", np.zeros(1, np.int64)
        return self._whole(data) if self.identity else self._by_prefix(data)

    def _whole(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out = data.replace(b" ", _MARK)
        source = np.frombuffer(data, np.uint8)
        align = np.repeat(np.arange(len(source)), np.where(source == 0x20, len(_MARK), 1))
        front = len(_MARK) * self.dummy
        return _MARK * self.dummy + out, np.concatenate([np.zeros(front, np.int64), align, [len(source)]])

    def _by_prefix(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = _MARK if self.escape else b" "
        out, align, at = bytearray(), [], 0

        def step(at: int) -> tuple[int, bytes]:
            if self.map and (found := self.map.longest(data, at)):
                return found
            first = data[at]
            size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            return size, data[at : at + size]

        if self.trim:
            while at < len(data) and (found := step(at))[1] == b" ":
                at += found[0]
            if at == len(data):
                return b"", np.full(1, at)
        if self.dummy:
            out += space
            align += [at] * len(space)
        after_space = self.trim
        while at < len(data):
            size, piece = step(at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                escaped = piece.replace(b" ", space)
                out += escaped
                align += [at] * len(escaped)
                after_space = self.trim and piece.endswith(b" ")
            at += size
        if self.trim:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[len(out) - len(space) :], align[len(out) :]
        return bytes(out), np.asarray([*align, at], np.int64)


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file. The model must fall back to bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        parsed = proto.ModelProto()
        parsed.ParseFromString(model)
        if not parsed.trainer_spec.byte_fallback:
            raise ValueError("the model must have byte fallback: unknown pieces have no length of their own")
        self.normalizer = Normalizer(parsed.normalizer_spec)
        byte, normal = proto.ModelProto.SentencePiece.BYTE, proto.ModelProto.SentencePiece.NORMAL
        self.lengths = np.asarray([1 if p.type == byte else len(p.piece.encode()) for p in parsed.pieces], np.int64)
        self.mark = self.library.piece_to_id(MARK)
        inner = [p.piece for p in parsed.pieces if p.type == normal]
        # Texts fall apart at spaces and line ends if no piece goes over such a place; the library then sees words.
        self.apart = (
            self.normalizer.identity
            and self.normalizer.dummy
            and all(p.type in (byte, normal) or p.type in (2, 3) for p in parsed.pieces)
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in inner)
        )
        self.words = WordIds(self._words, id_type(len(parsed.pieces)))
        self.decimal = [str(i) for i in range(len(parsed.pieces))]

    def _words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of words that begin with a space or mark, which the library adds itself, or with a line end."""
        found = self.library.encode([w if w[0] == "\n" else w[1:] for w in words], num_threads=1)
        for word, ids in zip(words, found, strict=True):
            yield ids[1:] if word[0] == "\n" else ids if len(word) > 1 else [self.mark]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.apart:
            return self.words.of([_WORDS(" " + t) if t else [] for t in texts])
        return [np.asarray(ids, np.int64) for ids in self.library.encode(texts, num_threads=1)]

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each piece in the original text."""
        normalised, align = self.normalizer(text)
        ends = np.cumsum(self.lengths[ids])
        if (int(ends[-1]) if len(ends) else 0) != len(normalised):
            raise ValueError("the pieces don't cover the normalised text")
        return align[ends - self.lengths[ids]], align[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_WORDS = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n[^ {MARK}\n]*").findall

_PIECES = pa.schema([("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])
_TYPES = {"int64": "long", "string": "string", "list<item: int32>": "array<int>"}


def encode(docs: DataFrame, model_path: str, text_col: str = "text", result: str = "pieces") -> DataFrame:
    """``docs`` without ``text_col``, with the pieces of each text.

    ``result="pieces"`` adds ``ids``, ``begins`` and ``ends`` (original byte offsets of every piece);
    ``result="digest"`` adds instead ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded ids) and ``spans_crc32`` (of all begins, then all ends, as
    little-endian 32-bit integers), made where the pieces are, so that they needn't travel;
    ``result="ids"`` adds the digest and the ids.

    The model is read on the driver and sent to the workers (a file of a few MB). A null text is an
    empty one, with no pieces; texts of any length are encoded whole. Inputs named as an added column
    are replaced; rows repeat as they do in the input, equal texts with equal pieces; an empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex
    added = {"pieces": _PIECES, "digest": _DIGEST, "ids": _DIGEST.append(_PIECES.field("ids"))}[result]
    kept = [c for c in docs.columns if c != text_col and c not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(key, lambda: Codec(model.value))
        for batch in text_slices(batches, "__text", 4 << 20):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            rows = []
            for text, ids in zip(texts, codec.encode(texts), strict=True):
                begins, ends = codec.spans(text.encode(), ids)
                if result == "pieces":
                    rows.append((ids.astype(np.int32), begins.astype(np.int32), ends.astype(np.int32)))
                else:
                    numbers = ids.tolist()
                    spans = zlib.crc32(ends.astype("<i4"), zlib.crc32(begins.astype("<i4")))
                    digest = (len(ids), _sha(",".join(map(codec.decimal.__getitem__, numbers))), _sha(codec.library.decode(numbers)), spans)
                    rows.append((*digest, ids.astype(np.int32)) if result == "ids" else digest)
            new = batch_of(added, *zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *new.columns], names=[*kept, *added.names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{f.name} {_TYPES[str(f.type)]}" for f in added)])
    return docs.select(*kept, docs[text_col].alias("__text")).mapInArrow(run, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model(), result="digest")
