import hashlib
import random
import re

import duckdb
import pytest
from fixtures import ROWS, clashing, docs, empty

from semql.llm import decontaminate as dc


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(text, items, window=10):
    w, hit, got = words(text), set(), set()
    for i, t in items:
        x = words(t)
        m = min(window, len(x))
        wins = {tuple(x[p : p + m]) for p in range(len(x) - m + 1)} if m else set()
        for q in range(len(w) - m + 1) if m else ():
            if tuple(w[q : q + m]) in wins:
                got.add(i)
                hit.update(range(q, q + m))
    return len(w), len(hit), got


def longest(text, item):
    w, x, best = words(text), words(item), 0
    for q in range(len(w)):
        for p in range(len(x)):
            n = 0
            while q + n < len(w) and p + n < len(x) and w[q + n] == x[p + n]:
                n += 1
            best = max(best, n)
    return best


def test_shards_and_blocks_against_brute_force():
    rng = random.Random(3)
    for _ in range(120):
        vocabulary = rng.choice([["a"], ["a", "b"], ["a", "b", "cé", "日本", "d9"]])
        text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, n)))  # noqa: B023, E731
        texts, items = [*(text(60) for _ in range(5)), "", "A, b!\nB"], [*((k, text(25)) for k in range(5)), (9, ""), (10, "zz q")]
        blocks = [dc.Block([i for i, _ in part], [t.encode() for _, t in part], 10) for part in (items[:3], items[3:])]
        found = dc.search([t.encode() for t in texts], blocks, with_matches=True)
        for k, t in enumerate(texts):
            assert (found.n_words[k], found.n_hit[k], found.items[k]) == brute(t, items)
            best = {}
            for item, p, q, n, a, b in found.matches[k]:
                assert words(dict(items)[item])[p : p + n] == words(t)[q : q + n] == words(t.encode()[a:b].decode())
                best[item] = max(best.get(item, 0), n)
            assert best == {i: longest(t, dict(items)[i]) for i in found.items[k]}
            assert (found.n_matches[k], found.longest[k]) == (len(found.matches[k]), max(best.values(), default=0))


def test_hashes_don_t_depend_on_place():
    w = dc.words_of([b"x" * 70_000 + b" y", b"x" * 70_000, b"q " * 40_000 + b"abc" * 30_000, b"abc" * 30_000])
    assert w.hashes[0] == w.hashes[2] and w.hashes[-1] == w.hashes[-2] != w.hashes[-3]


ITEMS = [(1, ROWS[0][1].split("\n")[0]), (2, "short"), (3, None), (4, "word " * 12), (5, "nothing of this is anywhere in the table of documents at all"), (None, "ñandú"), (5, "no id here")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes,kept", [(1, 1), (1, 8), (1 << 20, 8)])
def test_edges(spark, block_bytes, kept):
    """Also with more blocks than a worker keeps."""
    got = dc.contamination(docs(spark), bench(spark), block_bytes=block_bytes, shard_bytes=500, kept_blocks=kept).collect()
    want = []
    for i, t, *_ in ROWS:
        n, hit, items = brute(t, ITEMS)
        names = sorted({"null" if x is None else str(x) for x in items})
        want.append((i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == sorted(want, key=repr)


def test_removal_keeps_clashing_columns(spark):
    rows = clashing(spark)
    out = dc.remove_contaminated(rows, bench(spark))
    assert out.columns == rows.columns
    assert {(r.n_words, r.contaminated) for r in out.collect()} == {("own n_words", "own contaminated")}
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((i for i, t, *_ in ROWS if not brute(t, ITEMS)[1]), key=repr)


def test_empty(spark):
    assert dc.contamination(empty(spark), bench(spark)).count() == 0
    out = dc.contamination(docs(spark), bench(spark, [])).collect()
    assert len(out) == len(ROWS) and not any(r.contaminated for r in out)


def test_sql_agrees_with_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    rows, items = [(k, t) for k, (_, t, *_) in enumerate(ROWS)], [(k, t) for k, (_, t) in enumerate(ITEMS)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    found = con.execute(dc.SQL).fetchall()
    assert {r[0]: r[1:4] for r in found} == {k: (n, hit, len(i)) for k, (n, hit, i) in ((k, brute(t, items)) for k, t in rows)}
    ours = dc.search([(t or "").encode() for _, t in rows], [dc.Block([i for i, _ in items], [(t or "").encode() for _, t in items], 10)], with_longest=True)
    assert {r[0]: r[6:8] for r in found} == {k: (ours.n_matches[k], ours.longest[k]) for k, _ in rows}
