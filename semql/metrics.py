"""Counters of a session: embeddings, searches, writes."""

from __future__ import annotations

import json
import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Observation

LOG_SIZE, LOG_TEXT = 8_000, 80


@dataclass
class Metrics:
    embed_ms: float = 0.0
    embed_calls: int = 0
    search_ms: float = 0.0
    search_ops: int = 0
    persist_ms: float = 0.0
    index_rebuild_ms: float = 0.0
    index_rebuilds: int = 0
    candidates: int = 0
    rows_matched: int = 0
    log: deque = field(default_factory=lambda: deque(maxlen=LOG_SIZE), repr=False)
    _open: list[tuple[Observation, float]] = field(default_factory=list, repr=False)

    def embedded(self, text: str, ms: float) -> None:
        self.embed_calls += 1
        self.embed_ms += ms
        self.log.append({"text": text[:LOG_TEXT], "ms": round(ms, 3)})

    def searched(self, observation: Observation | None = None) -> None:
        """A search was planned. What its ``observation`` counts is added once it has run, however often it runs later."""
        self.search_ops += 1
        if observation is not None:
            self._open = [*self._open, (observation, time.perf_counter())][-LOG_SIZE:]

    def settle(self, ran: bool = False) -> None:
        """Take in the searches that have run. Others stay open; with ``ran`` all have, and what is under way is waited for.

        Spark hands counts on some time after a job has ended.
        """
        left = []
        for observation, began in self._open:
            if observation._jo is None or not (ran or observation._jo.future().isCompleted()):
                left.append((observation, began))
                continue
            found = observation.get
            self.candidates += found["candidates"]
            self.rows_matched += found["rows_matched"]
        self._open = left

    def ran(self, ms: float) -> None:
        """Time that running searches took."""
        self.search_ms += ms

    def snapshot(self) -> dict:
        self.settle()
        return {k: round(v, 3) if isinstance(v, float) else v for k, v in self.__dict__.items() if k not in ("log", "_open")}

    def as_json(self) -> str:
        return json.dumps(self.snapshot())

    def log_json(self) -> str:
        return json.dumps(list(self.log))

    def reset_log(self) -> None:
        self.log.clear()

    def since(self, before: dict) -> dict:
        """What was added since a snapshot."""
        return {k: round(v - before.get(k, 0), 3) for k, v in self.snapshot().items()}
