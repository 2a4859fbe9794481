"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its lower-case words, with marks for a word's begin and end. Counts
come from all labelled rows: tasks count their words, turn them into n-gram counts, and Spark adds these
up. Orders below the highest use continuation counts, in how many different left contexts an n-gram
stands, as do n-grams that don't begin a word. Discounts come from the counts of counts. The models lie in
arrays sorted by the 64-bit hash of the n-gram, with an entry for each language that has it: discounted
probabilities of n-grams, and what contexts leave for shorter ones.

N-grams that make up less than ``LEAST_SHARE`` of their order's occurrences in a language are pruned, and
their mass goes to the shorter ones, so probabilities still sum to one. This alone bounds a model, at
``1 / LEAST_SHARE`` n-grams a language and order, however large the corpus.

A text goes to the language of the lowest cross-entropy per character. How sure that is, is a logistic curve of
the distance to the second, fitted on all labelled rows kept out of the counts; texts further from their
language than nearly all of those rows, or nearer to a tie than even odds, are rejected.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semql.llm.common import batch_of, cut, kept_in_worker, table, text_slices

ORDER = 4
#: N-grams of a smaller share of their language and order are pruned.
LEAST_SHARE = 1e-6
BEGIN, END = 1, 2
#: Words whose codes are laid out at once.
_BLOCK = 50_000
_BASE = 0xD6E8FEB86659FD93
_WORDS = re.compile(r"[^\W\d_]+").findall


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words with their marks, and where each word begins; letters only."""
    codes = np.frombuffer("\x02\x01".join(["", *words, ""]).encode("utf-32-le"), "<u4")[1:-1].astype(np.int64)
    return codes, np.flatnonzero(codes == BEGIN)


@dataclass
class Grams:
    """N-grams of one order: the codes where they end, their hashes, and those without the last or the first code."""

    ends: np.ndarray
    hashes: np.ndarray
    contexts: np.ndarray
    suffixes: np.ndarray
    begins: np.ndarray  # whether they start with the begin mark


def grams(codes: np.ndarray, starts: np.ndarray, order: int) -> Iterator[Grams]:
    """N-grams of rising order that end at any code but a begin mark and stay within their word."""
    place = np.arange(len(codes))
    offset = place - np.repeat(starts, np.diff([*starts, len(codes)]))
    hashes, power = np.zeros(len(codes), np.uint64), np.uint64(1)
    value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(1, order + 1):
            longer = hashes.copy()
            longer[k - 1 :] += value[: len(codes) - k + 1] * power
            ends = place[(offset >= max(1, k - 1))]
            yield Grams(ends, longer[ends], hashes[ends - 1], hashes[ends], offset[ends] == k - 1)
            hashes, power = longer, power * np.uint64(_BASE)


_COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("h", pa.int64()), ("ctx", pa.int64()), ("suf", pa.int64()), ("bos", pa.bool_()), ("n", pa.int64())])


def _gram_counts(lang: str, words: Counter, order: int) -> Iterator[pa.RecordBatch]:
    items = [(r, n) for w, n in words.items() for r in letter_runs(w)]
    for i in range(0, len(items), _BLOCK):
        yield from _block_counts(lang, items[i : i + _BLOCK], order)


def _block_counts(lang: str, items: list[tuple[str, int]], order: int) -> Iterator[pa.RecordBatch]:
    codes, starts = spelled([w for w, _ in items])
    weight = np.repeat([n for _, n in items], np.diff([*starts, len(codes)]))
    for k, g in enumerate(grams(codes, starts, order), 1):
        by = np.argsort(g.hashes)
        first = by[np.flatnonzero(np.diff(g.hashes[by], prepend=~g.hashes[by[:1]]))]
        cuts = np.flatnonzero(np.diff(g.hashes[by], prepend=~g.hashes[by[:1]]))
        n = np.add.reduceat(weight[g.ends][by], cuts)
        yield batch_of(_COUNTS, [lang] * len(n), np.full(len(n), k, np.int32), g.hashes[first].view(np.int64), g.contexts[first].view(np.int64), g.suffixes[first].view(np.int64), g.begins[first], n)


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """N-gram counts of ``rows(text, lang)``: ``lang``, order ``k``, hashes ``h``, ``ctx``, ``suf``, ``bos``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in text_slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(_WORDS(text.lower()))
            if sum(map(len, counts.values())) > 500_000:
                for lang, words in counts.items():
                    yield from _gram_counts(lang, words, order)
                counts = {}
        for lang, words in counts.items():
            yield from _gram_counts(lang, words, order)

    found = rows.select("text", "lang").mapInArrow(run, "lang string, k int, h long, ctx long, suf long, bos boolean, n long")
    return found.groupBy("lang", "k", "h", "ctx", "suf", "bos").agg(F.sum("n").alias("n"))


@dataclass
class Values:
    """Ascending hashes, and the languages that have each with their values: those of hash ``i`` are entries ``at[i]`` to ``at[i + 1]``."""

    hashes: np.ndarray
    at: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, langs: np.ndarray, values: np.ndarray) -> Values:
        order = np.lexsort((langs, hashes))
        found, first = np.unique(hashes[order], return_index=True)
        return cls(found, np.append(first, len(order)), langs[order].astype(np.int32), values[order].astype(np.float32))

    def rows(self, wanted: np.ndarray, n_langs: int, default: float) -> np.ndarray:
        """A row for each wanted hash, ``default`` where a language doesn't have it."""
        out = np.full((len(wanted), n_langs), default, np.float32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            row = np.flatnonzero(self.hashes[at] == wanted)
            begin, size = self.at[at[row]], self.at[at[row] + 1] - self.at[at[row]]
            entry = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            out[np.repeat(row, size), self.langs[entry]] = self.values[entry]
        return out


@dataclass
class Model:
    langs: list[str]
    order: int
    symbols: int
    alpha: list[Values]  # by order: probabilities of n-grams
    gamma: list[Values]  # the same for contexts: what is left for shorter ones
    curve: tuple[float, float] = (0.0, 1.0)
    limits: np.ndarray | None = None  # by language: the largest cross-entropy not rejected


def _by_order(found: DataFrame, langs: list[str], order: int) -> list[Values]:
    rows, number = found.toPandas(), {x: i for i, x in enumerate(langs)}
    parts = [rows[rows["k"] == k] for k in range(1, order + 1)]
    return [Values.of(p["h"].to_numpy(np.int64).view(np.uint64), p["lang"].map(number).to_numpy(np.int64), p["value"].to_numpy(float)) for p in parts]


def train(rows: DataFrame, order: int = ORDER, least_share: float = LEAST_SHARE) -> Model:
    """Models of ``rows(text, lang)``, without nulls, from counts over all of them.

    N-grams of less than ``least_share`` of their language and order are pruned: only the others reach the
    driver, at most ``1 / least_share`` for each. N-grams of equal counts stay or go together. An empty
    table gives a model without languages.
    """
    counts = cut(gram_counts(rows, order), "gram-counts")
    # How many n-grams one longer end in this one.
    left = counts.where(F.col("k") > 1).groupBy("lang", (F.col("k") - 1).alias("k"), F.col("suf").alias("h")).agg(F.count("*").alias("lefts"))
    adjusted = counts.join(left, ["lang", "k", "h"], "left")
    whole = F.col("bos") | (F.col("k") == order)
    adjusted = adjusted.select("lang", "k", "h", "ctx", "n", F.when(whole, F.col("n")).otherwise(F.coalesce("lefts", F.lit(1))).alias("a"))
    adjusted = cut(adjusted, "gram-adjusted")
    # A row for each language and order.
    sums = adjusted.groupBy("lang", "k").agg(F.count(F.when(F.col("a") == 1, 1)).alias("n1"), F.count(F.when(F.col("a") == 2, 1)).alias("n2"), F.sum("n").alias("n")).collect()
    rates = [(r.lang, r.k, min(0.9, max(0.1, (r.n1 + 0.5) / (r.n1 + 2 * r.n2 + 1.0))), r.n * least_share) for r in sums]
    langs = sorted({r.lang for r in sums})
    rates = rows.sparkSession.createDataFrame(rates or [("", 0, 0.5, 0.0)], "lang string, k int, d double, least double")
    rated = adjusted.join(F.broadcast(rates), ["lang", "k"]).withColumn("stays", F.col("n") >= F.col("least"))
    contexts = rated.groupBy("lang", "k", "ctx").agg(
        F.sum("a").alias("total"), F.sum(F.when(F.col("stays"), F.col("a"))).alias("held"), F.count(F.when(F.col("stays"), 1)).alias("types"), F.first("d").alias("d")
    )
    contexts = contexts.where(F.col("types") > 0)
    alpha = rated.where("stays").drop("d").join(contexts.select("lang", "k", "ctx", "total", "d"), ["lang", "k", "ctx"])
    alpha = alpha.select("lang", "k", "h", ((F.col("a") - F.col("d")) / F.col("total")).alias("value"))
    # All that the n-grams of a context don't take: discounts, and what was pruned.
    gamma = contexts.select("lang", "k", F.col("ctx").alias("h"), ((F.col("total") - F.col("held") + F.col("d") * F.col("types")) / F.col("total")).alias("value"))
    symbols = counts.where(F.col("k") == 1).select("h").distinct().count() + 1
    return Model(langs, order, symbols, _by_order(alpha, langs, order), _by_order(gamma, langs, order))


def probabilities(model: Model, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each code after those before it in its word, under each language; one for begin marks."""
    p = np.full((len(codes), len(model.langs)), 1 / model.symbols, np.float32)
    for g, alpha, gamma in zip(grams(codes, starts, model.order), model.alpha, model.gamma, strict=True):
        p[g.ends] = alpha.rows(g.hashes, len(model.langs), 0.0) + gamma.rows(g.contexts, len(model.langs), 1.0) * p[g.ends]
    p[starts] = 1
    return p


def word_bits(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each word under each language, and its number of codes (letters and the end mark)."""
    codes, starts = spelled(words)
    return -np.add.reduceat(np.log2(probabilities(model, codes, starts)), starts, axis=0), np.diff([*starts, len(codes)]) - 1


class Scorer:
    """Bits of texts; words that come again are looked up, as many as fit ``keep`` numbers."""

    def __init__(self, model: Model, keep: int = 1_600_000):
        self.model, self.keep, self.known = model, keep // max(1, len(model.langs)), {}
        # Rows 0 and 1 are zeros: no word has row 0, words without a letter have row 1.
        self.bits, self.codes = np.zeros((2, len(model.langs)), np.float32), np.zeros(2, np.int64)

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits and codes of words, each the sum of its runs of letters."""
        runs = [letter_runs(w) for w in words]
        parts = list(dict.fromkeys(r for x in runs for r in x))
        if not parts:
            return np.zeros((len(words), len(self.model.langs)), np.float32), np.zeros(len(words), np.int64)
        blocks = [word_bits(self.model, parts[i : i + _BLOCK]) for i in range(0, len(parts), _BLOCK)]
        bits, codes = (np.concatenate(x) for x in zip(*blocks, strict=True))
        at = dict(zip(parts, range(len(parts)), strict=True))
        if all(len(x) == 1 for x in runs):
            own = [at[x[0]] for x in runs]
            return bits[own].astype(np.float32), codes[own]
        return np.stack([bits[[at[r] for r in x]].sum(axis=0) for x in runs]).astype(np.float32), np.asarray([sum(codes[at[r]] for r in x) for x in runs], np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits under each language and number of codes, by text."""
        words = [_WORDS(t.lower()) for t in texts]
        rows = [list(map(self.known.get, w)) for w in words]
        partly = [i for i, row in enumerate(rows) if not all(row)]
        new = dict.fromkeys(w for i in partly for w, row in zip(words[i], rows[i], strict=True) if row is None)
        all_bits, all_codes = self.bits, self.codes
        if new:
            bits, codes = self._rows(list(new))
            new = dict(zip(new, range(len(all_bits), len(all_bits) + len(new)), strict=True))
            all_bits, all_codes = np.concatenate([all_bits, bits]), np.concatenate([all_codes, codes])
            for i in partly:
                rows[i] = [new[w] if row is None else row for w, row in zip(words[i], rows[i], strict=True)]
            if len(self.known) < self.keep:
                self.known.update(new)
                self.bits, self.codes = all_bits, all_codes
        total, count = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        for i, row in enumerate(rows):
            total[i], count[i] = all_bits[row].sum(axis=0, dtype=np.float64), all_codes[row].sum() if row else 0
        return total, count


def letter_runs(word: str) -> list[str]:
    """The word, or what its signs that are numbers and no letters leave of it."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


_RESULT = pa.schema([("best", pa.string()), ("entropy", pa.float64()), ("gap", pa.float64()), ("codes", pa.int64()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with the language of each text.

    Adds ``best`` (``und`` if the text is null or has no letter), ``entropy`` (bits per code under it),
    ``gap`` (bits to the second language, over the whole text), ``codes``, ``score`` (estimated probability that
    ``best`` is right, 0 for ``und``) and ``rejected``. Texts are read whole. Rows repeat as they do in the
    input; inputs named as an added column are replaced; an empty table gives an empty table. Of languages at the
    same entropy the first by name is taken. With one language learned, gaps are zero; with none every text is ``und``.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kept = [c for c in docs.columns if c != text_col and c not in _RESULT.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = kept_in_worker(key, lambda: Scorer(model)) if model.langs else None
        for batch in text_slices(batches, "__text"):
            rows = []
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            totals, counts = scorer.of(texts) if scorer else (np.zeros((len(texts), 0)), np.zeros(len(texts)))
            for bits, n in zip(totals, counts.tolist(), strict=True):
                if not n:
                    rows.append(("und", None, None, 0, 0.0, True))
                    continue
                order = np.argsort(bits, kind="stable")
                best = int(order[0])
                gap = float(bits[order[1]] - bits[best]) if len(order) > 1 else 0.0
                entropy = float(bits[best]) / n
                score = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log1p(gap))))
                far = model.limits is not None and entropy > model.limits[best]
                rows.append((model.langs[best], entropy, gap, n, float(score), bool(far or score < 0.5)))
            new = batch_of(_RESULT, *zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *new.columns], names=[*kept, *_RESULT.names])

    types = ["string", "double", "double", "long", "double", "boolean"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"{n} {t}" for n, t in zip(_RESULT.names, types, strict=True))])
    return docs.select(*kept, docs[text_col].alias("__text")).mapInArrow(run, schema)


#: Buckets for a step of one in the logarithm of a gap, and for a bit of entropy.
_GAPS, _BITS = 16, 64


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Fit curve and limits on ``rows(text, lang)``, which the models haven't seen.

    All rows count: gaps and entropies are counted in buckets, whose numbers of rows are all that the driver
    sees, so the fit is the same however the rows are dealt out. Without rows the curve and the lack
    of limits stay as they are.
    """
    found = identify(rows, model).where(F.col("best") != "und")
    right = F.col("lang") == F.col("best")
    entries = F.array(
        F.struct(F.lit("").alias("of"), right.alias("right"), F.floor(F.log1p("gap") * _GAPS).alias("bucket")),
        F.struct(F.col("best").alias("of"), right.alias("right"), F.floor(F.col("entropy") * _BITS).alias("bucket")),
    )
    counts = found.select(F.explode(entries).alias("e")).groupBy("e.of", "e.right", "e.bucket").agg(F.count("*").alias("n")).collect()
    gaps = sorted((r.bucket, r.right, r.n) for r in counts if r.of == "")
    # One right and one wrong row at a tie, so that the fit exists and small gaps mean even odds.
    x = np.asarray([*((b + 0.5) / _GAPS for b, _, _ in gaps), 0.0, 0.0])
    y, n = np.asarray([*(r for _, r, _ in gaps), True, False], float), np.asarray([*(c for _, _, c in gaps), 1, 1], float)
    w = np.asarray([0.0, 1.0])
    design = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(hessian, design.T @ (n * (y - p)) - 1e-3 * (w - [0.0, 1.0]))
    limits = np.full(len(model.langs), np.inf)
    for i, lang in enumerate(model.langs):
        own = sorted((r.bucket, r.n) for r in counts if r.of == lang and r.right)
        if own:
            value, size = (np.asarray([b for b, _ in own]) + 0.5) / _BITS, np.asarray([c for _, c in own])
            mean = (value * size).sum() / size.sum()
            spread = float(((value - mean) ** 2 * size).sum() / size.sum()) ** 0.5
            limits[i] = value[np.searchsorted(np.cumsum(size), 0.99 * size.sum())] + 3 * spread + 0.5
    model.curve, model.limits = (float(w[0]), max(0.0, float(w[1]))), limits
    return model


def part_of(id_: Column, parts: int) -> Column:
    """A number below ``parts`` from an id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % parts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", part_of(F.col("doc_id"), 4) == 2)
    learn = docs.where(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    apart = F.crc32(F.concat(F.lit("calibration"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % 20 == 0
    model = calibrate(train(learn.where(~apart).select("text", "lang")), learn.where(apart).select("text", "lang"))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", F.col("best").alias("lang_pred"), "score", "rejected")
