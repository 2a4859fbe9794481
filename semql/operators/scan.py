"""The semantic scan: relational predicates, MATCH on vector columns, scores as columns.

What limits a search decides its plan. One MATCH alone takes the best ``cap`` rows and then those above the
threshold; any predicate given as ``where``, a second MATCH or ``/exact`` scores every row that passes, without a
cap. Predicates put on the result afterwards see only what the cap has left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semql.functions import vectors
from semql.functions.embedders import Embedder, NullEmbedder, embed_one
from semql.metrics import Metrics
from semql.operators.matchdsl import APPROXIMATE, MatchError, MatchQuery, parse_match

THRESHOLD, CAP = 0.5, 256
ROWID = "_rowid"


@dataclass(frozen=True)
class Match:
    """``column MATCH query``: a text in the MATCH language, or a vector with mode and candidates; None matches nothing."""

    column: str
    query: str | Sequence[float] | None
    mode: str = APPROXIMATE
    candidates: int | None = None


@dataclass(frozen=True)
class Branch:
    """One side of an OR: what must match and what must hold."""

    matches: tuple[Match, ...] = ()
    where: Column | None = None


@dataclass
class VectorTable:
    """A DataFrame with vector columns: ``embeddings`` names the vector of each."""

    df: DataFrame
    embeddings: dict[str, str]
    embedder: Embedder = field(default_factory=NullEmbedder)
    rowid: str = ROWID
    threshold: float = THRESHOLD
    cap: int = CAP
    metrics: Metrics = field(default_factory=Metrics)
    #: Whether results count their rows for ``metrics`` when they run.
    counted: bool = False
    #: The column with the lengths of a vector's counts, for columns that have one: scores of texts are exact then.
    lengths: dict[str, str] = field(default_factory=dict)

    def at(self, **changes) -> VectorTable:
        return replace(self, **changes)

    @property
    def columns(self) -> list[str]:
        """What ``*`` means: neither row id, vectors nor scores."""
        hidden = {self.rowid, *(e for c, e in self.embeddings.items() if e != c), *self.lengths.values()}
        return [c for c in self.df.columns if c not in hidden or c in self.embeddings]

    def score_name(self, column: str) -> str:
        return f"{column}_score"

    def _vector(self, match: Match) -> tuple[list[float] | None, MatchQuery]:
        if match.column not in self.embeddings:
            raise MatchError(f"unable to use MATCH on '{match.column}': it isn't a vector column")
        if match.query is None:
            return None, MatchQuery("")
        if isinstance(match.query, str):
            parsed = parse_match(match.query)
            return embed_one(parsed.query, self.embedder, self.metrics), parsed
        return [float(x) for x in match.query], MatchQuery("", match.mode, match.candidates)

    def scan(self, *matches: Match, where: Column | None = None, join: tuple[DataFrame, Column | str | list[str]] | None = None, observation: Observation | None = None) -> DataFrame:
        """All columns and a score for each vector column, null where there is no MATCH on it.

        ``join`` names other rows and what joins them: like ``where`` it holds before the search, so no cap hides rows
        that the join would keep. An ``observation`` gets ``candidates`` (rows scored, or left by the cap) and
        ``rows_matched`` once the result has run.
        """
        rows = self.df if where is None else self.df.where(where)
        rows = rows if join is None else rows.join(*join)
        scored: dict[str, Column] = {}
        parsed = MatchQuery("")
        for match in matches:
            vector, parsed = self._vector(match)
            if vector is None:
                return self._scores(rows, {}).where(F.lit(False))
            scored[match.column] = self._score(match, parsed, vector)
        rows = self._scores(rows, scored)
        names = [self.score_name(c) for c in scored]
        if len(matches) == 1 and where is None and join is None and parsed.mode == APPROXIMATE:
            # TakeOrderedAndProject: each task keeps its best rows; rows without a vector come last and fail the threshold.
            rows = rows.orderBy(F.desc_nulls_last(names[0]), self.rowid).limit(parsed.candidates or self.cap)
        if names:
            observation = observation or (Observation() if self.counted else None)
            self.metrics.searched(observation if self.counted else None)
        if names and observation is not None:
            passed = reduce(lambda a, b: a & b, (F.col(f"`{n}`") >= self.threshold for n in names))
            rows = rows.observe(observation, F.count(f"`{names[0]}`").alias("candidates"), F.count(F.when(passed, 1)).alias("rows_matched"))
        for name in names:
            rows = rows.where(F.col(f"`{name}`") >= self.threshold)
        return rows

    def _score(self, match: Match, parsed: MatchQuery, vector: list[float]) -> Column:
        own, query = F.col(f"`{self.embeddings[match.column]}`"), vectors.literal(vector)
        if match.column not in self.lengths or not isinstance(match.query, str) or not hasattr(self.embedder, "counts"):
            return vectors.dot(own, query)
        length = float(np.linalg.norm(self.embedder.counts([parsed.query])[0]))
        return vectors.exact_dot(own, F.col(f"`{self.lengths[match.column]}`"), query, F.lit(length))

    def _scores(self, rows: DataFrame, scored: dict[str, Column]) -> DataFrame:
        return rows.withColumns({self.score_name(c): scored.get(c, F.lit(None).cast("double")) for c in self.embeddings})

    def ordered(self, rows: DataFrame) -> DataFrame:
        """The default order of matches: the sum of the scores, best first, then the row id."""
        total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{self.score_name(c)}`"), F.lit(0.0)) for c in self.embeddings))
        return rows.orderBy(F.desc(total), self.rowid)

    def any_of(self, *branches: Branch) -> DataFrame:
        """OR: each branch is a scan of its own, with its own cap; a row of several comes from the first."""
        parts = [self.scan(*b.matches, where=b.where).withColumn("__branch", F.lit(i)) for i, b in enumerate(branches)]
        every = reduce(DataFrame.unionByName, parts)
        first = Window.partitionBy(self.rowid).orderBy("__branch")
        return every.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).drop("__n", "__branch")

    def star(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{c}`") for c in self.columns])

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """A page of the table in row order, with the row id."""
        shown = self.df.orderBy(self.rowid).offset(offset).limit(limit)
        return shown.select(F.col(self.rowid).alias("rowid"), *[F.col(f"`{c}`") for c in self.columns])
