"""Token ids of repeated words, looked up instead of encoded again."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np


def id_type(vocabulary: int) -> np.dtype:
    """Little-endian unsigned integers that hold the ids of a vocabulary: of 16 bits, or of 32 for a large one."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


class WordIds:
    """Ids of words as little-endian integers of ``kind``.

    ``encode`` takes a list of distinct words and gives the ids of each, as a sequence or as such bytes. Up to ``keep`` words stay for
    later batches; the rest are encoded again when they come back, so memory is bounded and no result
    depends on what is kept.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[Sequence[int] | bytes]], kind: np.dtype, keep: int = 400_000):
        self.encode, self.kind, self.keep, self.known = encode, kind, keep, {}

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text, given as a list of its words."""
        rows = [list(map(self.known.get, words)) for words in texts]
        # One lookup a word; texts with a word that isn't known (or has no ids) are gone through once more.
        partly = [i for i, row in enumerate(rows) if not all(row)]
        new = dict.fromkeys(w for i in partly for w, ids in zip(texts[i], rows[i], strict=True) if ids is None)
        if new:
            new = dict(zip(new, (ids if isinstance(ids, bytes) else np.asarray(ids, self.kind).tobytes() for ids in self.encode(list(new))), strict=True))
            for i in partly:
                rows[i] = [new[w] if ids is None else ids for w, ids in zip(texts[i], rows[i], strict=True)]
            if len(self.known) < self.keep:
                self.known.update(new)
        return [np.frombuffer(b"".join(row), self.kind) for row in rows]
