"""Text to vectors: the interface, a hashing stand-in that needs no model, and an optional ONNX back-end."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[np.ndarray | None]:
        """Vectors of length one; None for a text that has none."""


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.where(norms > 1.1920929e-07, rows / np.maximum(norms, 1e-30), rows).astype(np.float32)


#: Twice the bucket of tokens met so far, about ``_KEEP`` at most, plus one for a negative sign, by dimension.
_CODES: dict[int, dict[bytes, int]] = {}
_KEEP = 100_000


def _code(token: bytes, dim: int) -> int:
    digest = hashlib.md5(token).hexdigest()
    return int(digest[:8], 16) % dim * 2 + int(digest[8], 16) % 2


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed counts of ASCII words in ``dim`` buckets, at length one. Lexical, not semantic: a stand-in for a model."""

    dim: int = 256
    model_id: str = "hashing-256"

    def embed(self, texts: list[str]) -> list[np.ndarray | None]:
        return [None if c is None else _unit(c) for c in self.counts(texts)]

    def counts(self, texts: list[str]) -> list[np.ndarray | None]:
        """Whole numbers, which vectors are before they are brought to length one; None for a text that has none."""
        codes, found = _CODES.setdefault(self.dim, {}), []
        for text in texts:
            if text is None or not text.strip():
                found.append(None)
                continue
            tokens = _TOKENS(text.encode().lower())  # of bytes: A-Z only
            row = list(map(codes.get, tokens))
            if None in row:
                if len(codes) > _KEEP:  # those met first are the common ones
                    for t in [*itertools.islice(codes, _KEEP // 2, None)]:
                        del codes[t]
                codes.update([(t, _code(t, self.dim)) for t in set(tokens) if t not in codes])
                row = list(map(codes.__getitem__, tokens))
            counts = np.bincount(np.asarray(row, np.int64), minlength=2 * self.dim).reshape(-1, 2)
            found.append((counts[:, 0] - counts[:, 1]).astype(float))
        return found


_TOKENS = re.compile(b"[a-z0-9]+").findall


@dataclass(frozen=True)
class NullEmbedder:
    """No model: rows are stored without vectors and no text matches."""

    model_id: str = ""
    dim: int = 0

    def embed(self, texts: list[str]) -> list[None]:
        return [None] * len(texts)


#: Known models with dimension and longest input in tokens.
REGISTRY = {
    "all-MiniLM-L6-v2": (384, 256),
    "all-MiniLM-L6-v2-fp16": (384, 256),
    "all-MiniLM-L12-v2": (384, 256),
    "all-mpnet-base-v2": (768, 384),
    "multi-qa-MiniLM-L6-cos-v1": (384, 512),
    "paraphrase-multilingual-MiniLM-L12-v2": (384, 128),
    "gte-small": (384, 512),
}


@dataclass
class OnnxEmbedder:
    """A sentence model from local files: tokenise, run, average over tokens, at length one.

    ``model_path`` and ``tokenizer_path`` must be readable by every worker; the session is opened there on first use.
    """

    model_id: str
    model_path: str
    tokenizer_path: str
    dim: int = 0
    max_tokens: int = 0
    _open: tuple | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        known = REGISTRY.get(self.model_id, (self.dim, self.max_tokens or 512))
        self.dim, self.max_tokens = self.dim or known[0], self.max_tokens or known[1]
        if not self.dim:
            raise ValueError(f"semql: unknown model '{self.model_id}': give its dimension")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    def _session(self) -> tuple:
        if self._open is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.no_padding()
            tokenizer.enable_truncation(self.max_tokens)
            self._open = (onnxruntime.InferenceSession(self.model_path), tokenizer)
        return self._open

    def embed(self, texts: list[str], most: int = 64) -> list[np.ndarray | None]:
        """Texts of equal length in tokens go through the model together, at most ``most`` at once, so none is padded."""
        session, tokenizer = self._session()
        names, found = {i.name for i in session.get_inputs()}, [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and t.strip()]
        codes = dict(zip(known, tokenizer.encode_batch([texts[i].strip() for i in known]), strict=True))
        known.sort(key=lambda i: len(codes[i].ids))
        for _, group in itertools.groupby(known, key=lambda i: len(codes[i].ids)):
            group = list(group)
            for at in range(0, len(group), most):
                part = group[at : at + most]
                feeds = {"input_ids": [codes[i].ids for i in part], "attention_mask": [codes[i].attention_mask for i in part], "token_type_ids": [codes[i].type_ids for i in part]}
                out = session.run(None, {k: np.asarray(v, np.int64) for k, v in feeds.items() if k in names})[0]
                if out.shape[:1] != (len(part),) and len(part) > 1:
                    raise ValueError(f"semql: unexpected model output of shape {out.shape} for {len(part)} texts")
                for i, row in zip(part, out if len(part) > 1 else [out], strict=True):
                    found[i] = _unit(pooled(row[None] if len(part) > 1 else row, self.dim))
        return found


def resolve_embedder(spec: Embedder | str | dict | None) -> Embedder:
    """An embedder from itself, a name, or files: ``{"model": path, "tokenizer": path, "id": name, "dim": n}``.

    A known name alone doesn't do, as nothing is fetched: its files must be given.
    """
    if spec is None:
        return NullEmbedder()
    if isinstance(spec, dict):
        return OnnxEmbedder(spec.get("id", spec["model"]), spec["model"], spec["tokenizer"], spec.get("dim", 0), spec.get("max_tokens", 0))
    if isinstance(spec, str):
        found = re.fullmatch(r"hashing-(\d+)", spec)
        if not found:
            raise ValueError(f"semql: model '{spec}' needs its files" if spec in REGISTRY else f"semql: unknown model '{spec}'")
        return HashingEmbedder(int(found[1]), spec)
    return spec


def pooled(out: np.ndarray, dim: int) -> np.ndarray:
    """One vector from a model's output: the mean over tokens of [1, tokens, dim]; [1, dim] and [dim] as they are."""
    if out.ndim == 3 and out.shape[0] == 1 and out.shape[2] == dim:
        return out[0].mean(axis=0)
    if out.size == dim:
        return out.reshape(dim)
    raise ValueError(f"semql: unexpected model output of shape {out.shape} for dimension {dim}")


#: Texts that a worker holds as Python objects at a time.
SLICE = 256


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), SLICE):
        yield texts.slice(at, SLICE).to_pylist()


def _lists(vectors: list[np.ndarray | None]) -> pa.Array:
    """Vectors as one array of lists."""
    known = np.asarray([v is not None for v in vectors], bool)
    flat = np.concatenate([v for v in vectors if v is not None]).astype(np.float32) if known.any() else np.zeros(0, np.float32)
    ends = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in vectors])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~known, False)), pa.array(flat))


def embed_udf(embedder: Embedder):
    """Vectors of texts as a function of a column; null for null, empty and blank texts. A few texts at a time."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_lists(embedder.embed(part)) for part in _slices(texts)]
            yield pa.concat_arrays(parts) if parts else _lists([])

    return vectors


def scaled_udf(embedder: Embedder):
    """Vectors as of ``embed_udf``, each with the length that its counts had: ``vector``, ``length``.

    A vector times its length, rounded, gives the counts back, so that scores can be exact. No length from embedders without counts.
    """

    def scaled(part: list[str | None]) -> pa.Array:
        if not hasattr(embedder, "counts"):
            vectors = embedder.embed(part)
            return pa.StructArray.from_arrays([_lists(vectors), pa.nulls(len(part), pa.float64())], ["vector", "length"])
        counts = embedder.counts(part)
        lengths = [None if c is None else float(np.linalg.norm(c)) for c in counts]
        return pa.StructArray.from_arrays([_lists([None if c is None else _unit(c) for c in counts]), pa.array(lengths, pa.float64())], ["vector", "length"])

    @F.arrow_udf("struct<vector: array<float>, length: double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [scaled(part) for part in _slices(texts)]
            yield pa.concat_arrays(parts) if parts else scaled([])

    return vectors


def embed_column(text: Column, embedder: Embedder) -> Column:
    return embed_udf(embedder)(text.cast("string"))


def scaled_column(text: Column, embedder: Embedder) -> Column:
    return scaled_udf(embedder)(text.cast("string"))


def embed_one(text: str | None, embedder: Embedder, metrics=None) -> list[float] | None:
    """A query's vector, made on the driver."""
    began = time.perf_counter()
    vector = embedder.embed([text])[0] if text is not None and text.strip() else None
    if metrics is not None and vector is not None:
        metrics.embedded(text, (time.perf_counter() - began) * 1000)
    return None if vector is None else [float(x) for x in vector]
