"""The text after MATCH: ``query``, ``query/exact``, ``query/hnsw`` or ``query/hnsw:N``; quotes keep a query literal."""

from __future__ import annotations

import re
from dataclasses import dataclass

APPROXIMATE, EXACT = "hnsw", "exact"


class MatchError(ValueError):
    def __init__(self, what: str):
        super().__init__(f"semql: {what}")


@dataclass(frozen=True)
class MatchQuery:
    query: str
    mode: str = APPROXIMATE
    candidates: int | None = None


#: Rows beyond this can't be asked for; larger counts mean as many.
MOST = (1 << 31) - 1

_MODE = re.compile(rf"({APPROXIMATE}|{EXACT})(:(.*))?", re.DOTALL).fullmatch
_COUNT = re.compile(r"\+?[0-9]+").fullmatch


def _directive(text: str) -> tuple[str, int | None] | None:
    """Mode and candidates; None if the text doesn't begin with a mode's name."""
    found = _MODE(text)
    if not found:
        return None
    mode, given, count = found.groups()
    if given is None:
        return mode, None
    if mode == EXACT:
        raise MatchError("/exact takes no candidate count")
    if not _COUNT(count) or not 0 < int(count) < 1 << 63:
        raise MatchError(f"the candidate count must be a positive integer, not '{count}'")
    return mode, min(int(count), MOST)


def parse_match(text: str) -> MatchQuery:
    """What stands between quotes is the query as it is; without quotes a mode after the last slash is split off. Blanks
    around the text, after a closing quote and before the mode of a bare query don't count."""
    text = text.strip()
    if text.startswith('"'):
        query, closed, rest = text[1:].partition('"')
        if not closed:
            raise MatchError("the quoted query has no end")
        rest = rest.strip()
        if not rest:
            return MatchQuery(query)
        found = _directive(rest[1:]) if rest.startswith("/") else None
        if not found:
            raise MatchError(f"unexpected '{rest}' after the quoted query")
        return MatchQuery(query, *found)
    query, slash, last = text.rpartition("/")
    found = _directive(last) if slash else None
    return MatchQuery(query.strip(), *found) if found else MatchQuery(text)
