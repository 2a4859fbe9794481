import numpy as np
import pytest
from fixtures import clashing, docs, empty
from test_simhash import fingerprint

import corpus_pipeline
from semql.llm import near_copies

pytest.importorskip("xxhash")


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def texts():
    """Texts with copies whose words are changed here and there, one large group of them, and a passage that many hold."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 3000)}"
    passage, made = [word() for _ in range(30)], []
    for k in range(40):
        base = [word() for _ in range(int(rng.integers(20, 150)))]
        base = base[:40] + passage if k % 3 == 0 else base
        made.append(base)
        for _ in range(40 if k == 7 else 3):
            copy = list(base)
            for at in rng.choice(len(base), max(1, len(base) // int(rng.integers(30, 120))), replace=False):
                copy[at] = word()
            made.append(copy)
    return [" ".join(w) for w in made]


def test_pairs_against_brute_force(spark):
    """Kept documents are the least of each component of Jaccard similarity 0.8 or more."""
    made = texts()
    root = list(range(len(made)))
    close = [(i, j, jaccard(made[i], made[j])) for j in range(len(made)) for i in range(j)]
    close = [(i, j, s) for i, j, s in close if s >= 0.8]
    for _ in made:
        for i, j, _s in close:
            root[i] = root[j] = min(root[i], root[j])
    far = [(i, j) for i, j, s in close if s < 0.95 and (fingerprint(made[i]) ^ fingerprint(made[j])).bit_count() > 2]
    assert len(far) > 30
    rows = docs(spark, [(i, t, "en", "a") for i, t in enumerate(made)])
    want = sorted(set(root))
    assert sorted(r.doc_id for r in near_copies.dedup(rows).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, rows, "").collect()) == want


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 400)
    sets = [np.unique(np.concatenate([base[: int(rng.integers(0, 400))], rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, 90)))])) for _ in range(60)]
    found = near_copies.sketches([*sets, np.zeros(0, np.int64)])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = sum((int(x) ^ int(y)).bit_count() if (x ^ y) >= 0 else ((int(x) ^ int(y)) & (2**64 - 1)).bit_count() for x, y in zip(found[i], found[j], strict=True))
            assert bits <= len(np.setxor1d(a, b)) and (bits > 0 or i == j or len(np.setxor1d(a, b)) < 40)


def test_limit_is_exact(spark):
    """Of 20 shingles in all 16 are shared: 0.8. One less is not enough."""
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words[:22]), "en", "a"), (2, " ".join(words[2:24]), "en", "a"), (3, " ".join(f"v{i}" for i in range(22)), "en", "a"), (4, " ".join(f"v{i}" for i in range(2, 25)), "en", "a")]
    assert (jaccard(rows[0][1], rows[1][1]), jaccard(rows[2][1], rows[3][1])) == (0.8, 16 / 21)
    assert sorted(r.doc_id for r in near_copies.dedup(docs(spark, rows)).collect()) == [1, 3, 4]


def test_edges(spark):
    out = near_copies.dedup(clashing(spark))
    assert out.columns == clashing(spark).columns
    # 3 is a copy of 1; 5, 6 and both null texts have no words, and the null id comes first; of rows that repeat both stay.
    assert sorted((r.doc_id or 0, r.text is None) for r in out.collect()) == [(0, False), (0, True), (1, False), (2, False), (7, False), (8, False), (9, False), (9, False), (9, False), (10, False)]
    assert near_copies.dedup(empty(spark)).count() == 0
