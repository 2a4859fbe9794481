import re
from collections import Counter

import duckdb
import pytest
from fixtures import ROWS, clashing, docs, empty
from pyspark.sql import functions as F

from semql.llm import quality_rules as qr


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


JUNK = [
    (100, "sym### bol*** junk$$$ " * 30, "en", "a"),
    (101, "one two three four five six seven eight nine ten " * 4 + "end", "en", "a"),
    (102, "\n".join(["same line again"] * 3 + ["other words stand here " + " ".join(map(str, range(40)))]), "en", "a"),
    (103, "LOUD TEXT IN CAPITALS " + " ".join(f"W{i}ORD" for i in range(40)), "en", "a"),
    (104, " ".join(w for i in range(30) for w in [f"w{i}"] * 3), "en", "a"),
]
CLEAN = [(200 + i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60)) + ".", "en", "a") for i in range(150)]


def test_counts_and_base(spark):
    rows = ROWS + JUNK
    got = qr.verdicts(docs(spark, rows)).collect()
    want = [(i, *counts(t)) for i, t, *_ in rows]
    want = [(*w, w[1] < 20 or 100 * w[5] > 30 * w[1]) for w in want]
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r.kept for r in got if r.base_failed)


def test_clean_texts_stay_and_junk_goes(spark):
    kept = {r.doc_id for r in qr.keep_good(docs(spark, CLEAN + JUNK)).collect()}
    assert {i for i, *_ in CLEAN} <= kept and not kept & {100, 101, 103, 104}


def test_thresholds_follow_the_group(spark):
    """A source of code, where signs are the rule, keeps its texts; the same share is junk elsewhere."""
    signs = lambda i, k: " ".join(f"w{j}{'#' if j % 3 < k else ''}" for j in range(60)) + f" x{i}"
    code = [(1000 + i, signs(i, 2 if i % 4 else 1), "en", "code") for i in range(200)]
    kept = {r.doc_id for r in qr.keep_good(docs(spark, CLEAN + code + [(5000, signs(0, 2), "en", "a")])).collect()}
    assert {i for i, *_ in code} <= kept and 5000 not in kept


def test_sketches_merge(spark):
    rows = qr.verdicts(docs(spark, CLEAN + JUNK)).select("lang", "source", *qr._COUNTS)
    whole = {tuple(r) for r in qr.sketches(rows).collect()}
    halves = [qr.sketches(rows.where(c)) for c in ("n_words % 2 = 0", "n_words % 2 = 1")]
    merged = halves[0].union(halves[1]).groupBy("lang", "source", "name", "bucket").sum("n")
    assert {tuple(r) for r in merged.collect()} == whole


def test_fences_by_hand(spark):
    """A lone group's fence: the upper quartile and six spreads, of values in buckets of 2 %."""
    rows = [(i, " ".join(["word"] * 3 + [f"w{k}x{i}" for k in range(60 + i)]) + " #" * (i % 4), "en", "a") for i in range(80)]
    found = qr.thresholds(qr.sketches(qr.verdicts(docs(spark, rows)))).first()
    measured = sorted((i % 4) * 10_000 // (63 + i + i % 4) for i in range(80))
    lengths = sorted(63 + i + i % 4 for i in range(80))
    low, high = measured[19], measured[59]
    assert found.max_symbols == pytest.approx(high + 6 * max(high - low, 10_000 / lengths[39]), rel=0.05)


def test_sketches_decide_on_the_tables(spark):
    """Each group's limits are its own, and where they reject a text its sketch alone has decided that."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = qr.verdicts(table).cache()
    limits = [r.asDict() for r in qr.thresholds(qr.sketches(rows.where("not base_failed"))).collect()]
    for rule in qr.RULES:
        assert len({round(x[f"max_{rule}"], 6) for x in limits}) > 20
    judged = rows.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), rows["id"] == F.col("doc_id")).where("not base_failed")
    by = {r.quality: (r.n, r.kept) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert by[1][1] >= 0.99 * by[1][0] and by[0][1] <= 0.02 * by[0][0]


def test_main_path_has_no_python(spark):
    for rows in (qr.verdicts(docs(spark, CLEAN)), qr.keep_good(docs(spark, CLEAN))):
        assert not re.search("Python|Arrow|Pandas", rows._jdf.queryExecution().executedPlan().toString())


def test_clashing_and_empty(spark):
    out = qr.keep_good(clashing(spark, ROWS + CLEAN))
    assert out.columns == clashing(spark).columns and {r.kept for r in out.collect()} == {"own kept"}
    assert qr.verdicts(empty(spark)).count() == 0 and qr.keep_good(empty(spark)).count() == 0


@pytest.mark.parametrize("rows", [ROWS + JUNK + CLEAN])
def test_sql_agrees(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted((tuple(r) for r in con.execute(qr.SQL).fetchall()), key=repr)
    got = qr.verdicts(docs(spark, rows)).withColumnRenamed("id", "doc_id").select(names).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
