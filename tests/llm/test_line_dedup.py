import hashlib
from collections import defaultdict

import duckdb
import pytest
from fixtures import ROWS, clashing, docs, empty
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from semql.llm import line_dedup


def brute(rows, min_docs=2):
    strip = " \t\n\x0b\x0c\r"
    fold = {c: c + 32 for c in range(65, 91)}
    lowest = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    for i, lines in split:
        for line in lines:
            if len(k := line.strip(strip).translate(fold)) >= 10:
                held[k].add(i)
    out = []
    for i, lines in split:
        gone = [len(g := held.get(line.strip(strip).translate(fold), set())) >= min_docs and i != min(g, key=lowest) for line in lines]
        out.append((i, "\n".join(x for x, d in zip(lines, gone, strict=True) if not d), len(lines), sum(gone)))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(df, **kw).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_edges(spark, min_docs):
    assert run(docs(spark), min_docs=min_docs) == brute([r[:2] for r in ROWS], min_docs)


def test_extra_columns_stay(spark):
    out = line_dedup.dedup_lines(clashing(spark))
    assert {"id", "line", "score"} <= set(out.columns) and out.count() == len(ROWS)
    assert {r.line for r in out.collect()} == {"own line"}


def test_empty(spark):
    assert run(empty(spark)) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.text(st.sampled_from("aA b\n\t\réÉ"), max_size=60)), max_size=14, unique_by=lambda r: r[0]))
def test_random_texts(spark, rows):
    assert run(docs(spark, [(*r, "en", "s") for r in rows])) == brute(rows)


def test_sql_agrees_with_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [r[:2] for r in {r[0]: r for r in ROWS if r[0] is not None}.values()]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted(con.execute(line_dedup.SQL).fetchall(), key=repr)
    assert got == sorted(((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in brute(rows)), key=repr)
