"""SQLite-style comparison and scalar functions as Column expressions.

They exist where Spark's own differ: ASCII-only case folding, exact comparison of BIGINT with DOUBLE, integer
division, prefix casts, NULL-propagating greatest and least, and ``total``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(c: Column) -> Column:
    """NOCASE: A-Z fold, other letters don't."""
    return F.translate(c, _UPPER, _LOWER)


def rtrimmed(c: Column) -> Column:
    """RTRIM: spaces at the end don't count."""
    return F.rtrim(c)


def collated(c: Column, collation: str = "BINARY") -> Column:
    try:
        return {"BINARY": lambda x: x, "NOCASE": nocase, "RTRIM": rtrimmed}[collation.upper()](c)
    except KeyError:
        raise ValueError(f"semql: no such collation: {collation}") from None


def compare(integer: Column, real: float) -> Column:
    """-1, 0 or 1: a BIGINT against a real number, without rounding either; null for a null or NaN."""
    if real != real:
        return F.lit(None).cast("int")
    if real in (float("inf"), float("-inf")) or abs(real) >= 2.0**63:
        return F.when(integer.isNotNull(), F.lit(-1 if real > 0 else 1) if real != -(2.0**63) else F.when(integer == -(2**63), 0).otherwise(1))
    whole = int(real // 1)
    return F.when(integer < whole, -1).when(integer > whole, 1).when(integer == whole, F.lit(0 if real == whole else -1))


def like(c: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE with A-Z folded on both sides."""
    folded = pattern.translate({ord(u): lo for u, lo in zip(_UPPER, _LOWER, strict=True)})
    return F.like(nocase(c), F.lit(folded), F.lit(escape)) if escape else F.like(nocase(c), F.lit(folded))


def like_prefix(pattern: str) -> str | None:
    """The prefix of a pattern that ends in its only wildcard ``%``, else None."""
    found = re.fullmatch(r"([^%_]+)%", pattern)
    return found[1] if found else None


def glob(c: Column, pattern: str) -> Column:
    """GLOB: ``*``, ``?`` and ``[...]``, case counts."""
    out, at = "", 0
    while at < len(pattern):
        ch = pattern[at]
        end = pattern.find("]", at + 2) if ch == "[" else -1
        if ch == "[" and end > 0:
            inner = pattern[at + 1 : end]
            negated = inner.startswith("^")
            body = inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, at = f"{out}[{'^' if negated else ''}{body}]", end + 1
            continue
        out, at = out + {"*": ".*", "?": "."}.get(ch, re.escape(ch)), at + 1
    return c.rlike(f"(?s)^{out}\\z")


def total(c: Column) -> Column:
    """SUM as DOUBLE, 0.0 for no rows."""
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def group_concat(c: Column, separator: str = ",") -> Column:
    return F.listagg(c.cast("string"), F.lit(separator))


def divide(a: Column, b: Column) -> Column:
    """Division of integers, toward zero; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def scalar_max(*columns: Column) -> Column:
    """The greatest; null if any is."""
    return F.when(_all_known(columns), F.greatest(*columns))


def scalar_min(*columns: Column) -> Column:
    return F.when(_all_known(columns), F.least(*columns))


def _all_known(columns: tuple[Column, ...]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return known


def cast_integer(c: Column) -> Column:
    """CAST of text to INTEGER: its longest numeric prefix, 0 if it has none."""
    digits = F.regexp_extract(F.ltrim(c), r"^[+-]?\d+", 0)
    return F.when(c.isNotNull(), F.coalesce(F.when(digits != "", digits).try_cast("bigint"), F.lit(0).cast("bigint")))


def typeof(c: Column, sql_type: str) -> Column:
    """The storage class of a value of a column of that type."""
    name = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "real", "float": "real", "string": "text"}.get(sql_type, "blob")
    return F.when(c.isNull(), "null").otherwise(name)


#: Fields of ``strftime`` that Spark's patterns have.
_FIELDS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm"}


def julianday(ts: Column) -> Column:
    return F.unix_micros(ts) / 86_400_000_000 + 2_440_587.5


def unixepoch(ts: Column) -> Column:
    return F.unix_seconds(ts)


def strftime(pattern: str, ts: Column) -> Column:
    """A timestamp as text; ``%s``, ``%J`` and ``%w`` (0 is Sunday) too. Other fields raise."""
    parts, at = [], 0
    for found in re.finditer("%(.?)", pattern):
        parts.append(F.lit(pattern[at : found.start()]))
        at, name = found.end(), found[1]
        if name in _FIELDS:
            parts.append(F.date_format(ts, _FIELDS[name]))
        elif name == "%":
            parts.append(F.lit("%"))
        elif name in ("s", "J", "w"):
            parts.append({"s": unixepoch(ts), "J": julianday(ts), "w": F.dayofweek(ts) - 1}[name].cast("string"))
        else:
            raise ValueError(f"semql: no such field in a date pattern: %{name}")
    return F.when(ts.isNotNull(), F.concat(*parts, F.lit(pattern[at:])))


def modified(ts: Column, *modifiers: str) -> Column:
    """A timestamp after modifiers such as ``+3 days``, ``-1 month``, ``start of year`` or ``weekday 1``, one after the other.

    A day that a month doesn't have runs over into the next month.
    """
    for m in modifiers:
        if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (day|hour|minute|second)s?", m):
            seconds = float(found[1]) * {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}[found[2]]
            ts = F.timestamp_micros(F.unix_micros(ts) + F.lit(round(seconds * 1_000_000)))
        elif found := re.fullmatch(r"([+-]?\d+) (month|year)s?", m):
            first = F.date_trunc("month", ts)
            days = F.day(ts) - 1
            moved = F.add_months(first, int(found[1]) * (12 if found[2] == "year" else 1)).cast("timestamp")
            ts = F.timestamp_micros(F.unix_micros(moved) + days.cast("long") * 86_400_000_000 + F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts)))
        elif found := re.fullmatch(r"start of (day|month|year)", m):
            ts = F.date_trunc(found[1], ts)
        elif found := re.fullmatch(r"weekday ([0-6])", m):
            ahead = F.pmod(F.lit(int(found[1]) + 1) - F.dayofweek(ts), F.lit(7))
            ts = F.timestamp_micros(F.unix_micros(ts) + ahead.cast("long") * 86_400_000_000)
        else:
            raise ValueError(f"semql: no such date modifier: {m}")
    return ts


def json_entries(c: Column) -> Column:
    """The members of a JSON object as an array of ``key`` and ``value`` texts, to explode; null for anything else."""
    return F.map_entries(F.from_json(F.when(F.ltrim(c).startswith("{"), c), "map<string,string>"))


def json_elements(c: Column) -> Column:
    """The elements of a JSON array as an array of texts; null for anything else."""
    return F.from_json(F.when(F.ltrim(c).startswith("["), c), "array<string>")


def json_valid(c: Column) -> Column:
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull())


def json_type(c: Column, path: str = "$") -> Column:
    """The type of the value at a path: object, array, text, true, false, integer, real or null; null if nothing is there."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))
    number = F.regexp_extract(F.get_json_object(c, path), r"^-?\d+$", 0) != ""
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "text").when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", F.get_json_object(c, path)).when(kind.isNotNull(), F.when(number, "integer").otherwise("real"))
    )
