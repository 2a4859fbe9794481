"""Quality rules with thresholds that adapt to language and source, in DataFrame operations only.

Every text gets a few shares, such as signs per word. The shares of texts that pass the base rules are
sketched per language and source in logarithmic buckets of 2 % width. Such sketches merge by adding
counts, so partial ones combine in any order to the same result, a language's sketch is the sum of its
sources', and a rerun after a lost executor finds the same thresholds.

A group's threshold is a fence in its own sketch: the upper quartile and six times the spread, which is the
distance between the quartiles or, where that is less, what one sign or word more changes in a text of the
group's median length. Fences of small groups lean on their language's, and those of small languages on
that of all: geometric means, weighted with the number of texts against ``WEIGHT``. No other number limits a share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semql.llm.common import SPACE, cut, drop, let, same, table, without

WINDOW, FENCE, WEIGHT, SCALE, GAMMA = 8, 6, 25, 10_000, 1.02
#: What is sketched: numerator and denominator.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "echoes": ("n_echoes", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "upper": ("n_upper", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}
_LENGTHS = tuple(dict.fromkeys(below for _, below in RULES.values()))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_echoes")


def _repeated(hashes: Column) -> Column:
    """Words inside windows that the text has twice or more."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def places(sorted_: Column) -> Column:
        """First words of windows that stand next to an equal one in the sorted list."""
        last = F.size(sorted_) - 1
        at = lambda i: F.get(sorted_, i)["h"]
        twin = F.filter(
            F.sequence(F.lit(0), last), lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False))
        )
        return F.array_sort(F.transform(twin, lambda i: F.get(sorted_, i)["i"]))

    def covered(starts: Column) -> Column:
        """Each window adds what lies before the next one, at most its own length."""
        gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def count(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(pairs, lambda s: let(places(s), covered))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), some).otherwise(0)

    return F.when(F.size(hashes) > WINDOW, let(windows(hashes), count)).otherwise(0)


def _echoes(hashes: Column) -> Column:
    """Words equal to the word before."""
    return F.size(F.filter(hashes, lambda h, i: F.coalesce(F.get(hashes, i - 1) == h, F.lit(False))))


def measures(text: Column) -> Column:
    """A struct of the counts of one text; null counts as empty."""

    def by_words(words: Column) -> Column:
        chars, hashes = F.char_length(F.array_join(words, "")), F.transform(words, lambda w: F.xxhash64(w))
        return let(hashes, lambda h: F.struct(F.size(h).alias("n"), chars.alias("chars"), _repeated(h).alias("repeats"), _echoes(h).alias("echoes")))

    def by_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dups"))

    def of(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(SPACE))
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t-\r]+", -1))
        lines = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
        return let(
            let(words, by_words),
            lambda w: let(
                let(lines, by_lines),
                lambda n: F.struct(
                    w["n"].cast("long").alias("n_words"),
                    w["chars"].cast("long").alias("word_chars"),
                    F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    n["dups"].cast("long").alias("n_dup_lines"),
                    w["repeats"].cast("long").alias("n_repeat_words"),
                    n["n"].cast("long").alias("n_lines"),
                    F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
                    w["echoes"].cast("long").alias("n_echoes"),
                ),
            ),
        )

    return let(F.coalesce(text, F.lit("")), of)


def share(rule: str) -> Column:
    """A rule's share in ten-thousandths."""
    top, below = RULES[rule]
    return F.floor(F.try_divide(F.col(top) * SCALE, F.col(below)))


def bucket(x: Column) -> Column:
    """0 for zero, else the bucket whose values differ by 2 % at most; the small term keeps powers of the base in their own."""
    return F.when(x == 0, 0).otherwise(1 + F.floor(F.ln(x.cast("double")) / math.log(GAMMA) + 1e-9)).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by ``lang``, ``source``, ``name`` and ``bucket``, for the shares and the lengths they are shares of: mergeable sketches by the first three."""
    measured = {r: share(r) for r in RULES} | {n: F.col(n) for n in _LENGTHS}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), bucket(x).alias("bucket")) for n, x in measured.items()])
    flat = rows.where(F.col("n_words") > 0).select("lang", "source", F.explode(pairs).alias("p"))
    return flat.groupBy("lang", "source", F.col("p.name").alias("name"), F.col("p.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The fence of each rule by ``keys``, from sketches merged over everything else, with the group's size."""
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "name")
    up_to = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select(*keys, "name", "bucket", up_to.alias("up_to"), F.sum("n").over(group).alias("total"))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    quartile = lambda name, q: F.min(F.when((F.col("name") == name) & (F.col("up_to") * 4 >= F.col("total") * q), value))
    fence = lambda r: quartile(r, 3) + FENCE * F.greatest(quartile(r, 3) - quartile(r, 1), SCALE / quartile(RULES[r][1], 2))
    found = ranked.groupBy(*keys).agg(F.max("total").alias("size"), F.array(*[F.struct(F.lit(r).alias("rule"), fence(r).alias("fence")) for r in RULES]).alias("fences"))
    return found.select(*keys, "size", F.explode("fences").alias("f")).select(*keys, "size", "f.rule", "f.fence")


def _leaning(size: Column, fence: Column, parent: Column, weight: float) -> Column:
    return F.exp((size * F.ln(fence) + weight * F.ln(parent)) / (size + weight))


def thresholds(sketch: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """One row per language and source: the largest allowed share of each rule, as a column ``max_<rule>``."""
    own = _fences(sketch, ["lang", "source"])
    lang = _fences(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), F.col("size").alias("l_size"), F.col("fence").alias("l_fence"))
    all_ = _fences(sketch, []).select(F.col("rule").alias("a_rule"), F.col("fence").alias("a_fence"))
    joined = own.join(lang, same(F.col("lang"), F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(all_, F.col("rule") == F.col("a_rule"))
    fence = _leaning(F.col("size"), F.col("fence"), _leaning(F.col("l_size"), F.col("l_fence"), F.col("a_fence"), weight), weight)
    return joined.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, fence)).alias(f"max_{r}") for r in RULES])


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the counts of each text and ``base_failed``: fewer than 20 words, or over 30 % of them inside repeated windows."""
    rows = docs.withColumn("__m", measures(F.col(text_col)))
    rows = rows.select(*docs.columns, *[F.col(f"__m.{c}") for c in _COUNTS])
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def judged(rows: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """Counted rows with ``lang`` and ``source``, and with ``kept``.

    The limits are a table of their own, one row per language and source, whose size Spark knows: it goes to
    every task if it is small enough to broadcast, else both sides are shuffled.
    """
    limits = cut(thresholds(sketches(rows.where(~F.col("base_failed"))), weight).withColumnsRenamed({"lang": "t_lang", "source": "t_source"}), "quality-limits")
    joined = rows.join(limits, same(F.col("lang"), F.col("t_lang")) & same(F.col("source"), F.col("t_source")), "left")
    passed = F.lit(True)
    for rule in RULES:
        passed = passed & (F.coalesce(share(rule), F.lit(0)) <= F.coalesce(F.col(f"max_{rule}"), F.lit(0.0)))
    return joined.select(*rows.columns, F.when(F.col("base_failed"), False).otherwise(passed).alias("kept"))


def verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", weight: float = WEIGHT) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``lang``, ``source``, the counts, ``base_failed`` and ``kept``.

    ``kept``: not ``base_failed``, and no share above the group's threshold; a share equal to it stays. Null
    texts have no words and fail; null languages and sources are groups like any other. Texts are counted whole,
    however long. Rows repeat as they do in the input, equal ones with equal verdicts; an empty table gives an
    empty table. Texts are read once; what is written and joined are ids and counts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return judged(cut(counted(rows, "text").drop("text"), "quality-counts"), weight)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", weight: float = WEIGHT) -> DataFrame:
    """``docs`` without the rows that the rules reject, as ``verdicts`` has them.

    Texts that stay are not shuffled, but for the few whose hashes meet a rejected one's in a small filter.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = cut(counted(rows, "text").drop("text"), "quality-counts")
    gone = cut(judged(measured, weight).where(~F.col("kept")).select("id", "th").distinct(), "rejected")
    drop(measured)
    return without(docs, gone, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_fences(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    equal = " AND ".join([f"b.{k} IS NOT DISTINCT FROM a.{k}" for k in keys.split(", ") if k] + ["b.name = u.below"])
    value = f"CASE WHEN bucket = 0 THEN 0.0 ELSE pow(CAST({GAMMA} AS DOUBLE), bucket - 0.5) END"
    quartiles = ", ".join(f"min({value}) FILTER (WHERE up_to * 4 >= total * {q}) AS q{q}" for q in (1, 2, 3))
    return f"""
{name}_q AS (SELECT {by}name, max(total) AS size, {quartiles}
             FROM (SELECT {by}name, bucket, sum(n) OVER (PARTITION BY {by}name ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS up_to,
                          sum(n) OVER (PARTITION BY {by}name) AS total
                   FROM (SELECT {by}name, bucket, sum(n) AS n FROM qr_sketch GROUP BY {by}name, bucket)) GROUP BY {by}name),
{name} AS (SELECT {"".join(f"a.{k}, " for k in keys.split(", ") if k)}a.name AS rule, a.size, a.q3 + {FENCE} * greatest(a.q3 - a.q1, CAST({SCALE} AS DOUBLE) / b.q2) AS fence
           FROM {name}_q a JOIN (VALUES {_BELOW}) u(rule, below) ON u.rule = a.name JOIN {name}_q b ON {equal})"""


def _sql_leaning(size: str, fence: str, parent: str) -> str:
    return f"exp(({size} * ln({fence}) + {WEIGHT} * ln({parent})) / ({size} + {WEIGHT}))"


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BELOW = ", ".join(f"('{r}', '{b}')" for r, (_, b) in RULES.items())
_SHARES = " UNION ALL ".join(
    [f"SELECT n, lang, source, '{r}' AS name, CAST(floor({a} * CAST({SCALE} AS DOUBLE) / nullif({b}, 0)) AS BIGINT) AS x FROM qr_counts" for r, (a, b) in RULES.items()]
    + [f"SELECT n, lang, source, '{b}', CAST({b} AS BIGINT) FROM qr_counts" for b in _LENGTHS]
)
_FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"

#: From ``documents_in(doc_id, text, lang, source)`` to ``qr_out``.
SQL_STEPS = f"""
qr_words AS (SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS text, {_W} AS w FROM documents_in),
qr_windows AS (SELECT n, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS win FROM (SELECT n, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM qr_words WHERE len(w) >= {WINDOW})),
qr_repeats AS (SELECT n, count(DISTINCT word) AS n_repeat_words FROM (SELECT n, unnest(range(p, p + {WINDOW})) AS word
               FROM (SELECT n, p, count(*) OVER (PARTITION BY n, win) AS times FROM qr_windows) WHERE times > 1) GROUP BY n),
qr_lines AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM qr_words)
             WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY n),
qr_counts AS (SELECT q.n, doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_upper,
                     len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes
              FROM qr_words q LEFT JOIN qr_repeats r ON r.n = q.n LEFT JOIN qr_lines l ON l.n = q.n),
qr_shares AS ({_SHARES}),
qr_sketch AS (SELECT lang, source, name, CASE WHEN x = 0 THEN 0 ELSE 1 + CAST(floor(ln(CAST(x AS DOUBLE)) / CAST({math.log(GAMMA)!r} AS DOUBLE) + 1e-9) AS BIGINT) END AS bucket, count(*) AS n
              FROM qr_shares s JOIN (SELECT n AS k FROM qr_counts WHERE NOT {_FAILED}) c ON c.k = s.n GROUP BY ALL),
{_sql_fences("qr_own", "lang, source")}, {_sql_fences("qr_lang", "lang")}, {_sql_fences("qr_all", "")},
qr_limits AS (SELECT o.lang, o.source, o.rule, {_sql_leaning("o.size", "o.fence", _sql_leaning("l.size", "l.fence", "a.fence"))} AS most
              FROM qr_own o JOIN qr_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.rule = o.rule JOIN qr_all a ON a.rule = o.rule),
qr_over AS (SELECT DISTINCT s.n FROM qr_shares s JOIN qr_limits m ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source AND m.rule = s.name WHERE s.x > m.most),
qr_out AS (SELECT c.*, {_FAILED} AS base_failed, NOT {_FAILED} AND o.n IS NULL AS kept FROM qr_counts c LEFT JOIN qr_over o ON o.n = c.n)
"""

SQL = f"""
WITH documents_in AS (SELECT * FROM documents), {SQL_STEPS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM qr_out
"""
