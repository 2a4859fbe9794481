import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import ROWS, clashing, docs, empty

from semql.llm import language_id as li

WORDS = {"en": "the and that with this from which have their would there about".split(), "de": "der und nicht eine werden durch schon über können für zwischen".split(), "fr": "les une dans pour avec être cette mais nous était où très".split()}


def sample(n=60, start=0):
    out = []
    for lang, words in WORDS.items():
        for i in range(n):
            out.append((start + len(out), " ".join(words[(i * 5 + k * k) % len(words)] for k in range(12)), lang, "s"))
    return out


def kneser_ney(texts, order):
    """A plain model of one language: probabilities by the textbook, over dictionaries."""
    raw = Counter()
    for t in texts:
        for w in t.lower().split():
            s = "^" + w + "$"
            for j in range(1, len(s)):
                for k in range(1, min(order, j + 1) + 1):
                    raw[s[j - k + 1 : j + 1]] += 1
    lefts = defaultdict(set)
    for g in raw:
        lefts[g[1:]].add(g[0])
    adjusted = {g: n if len(g) == order or g[0] == "^" else max(1, len(lefts[g])) for g, n in raw.items()}
    discount = {}
    for k in range(1, order + 1):
        n1, n2 = (sum(1 for g, a in adjusted.items() if len(g) == k and a == x) for x in (1, 2))
        discount[k] = min(0.9, max(0.1, (n1 + 0.5) / (n1 + 2 * n2 + 1.0)))
    total, types = Counter(), Counter()
    for g, a in adjusted.items():
        total[len(g), g[:-1]] += a
        types[len(g), g[:-1]] += 1

    def p(g, base):
        if not g:
            return base
        lower, key = p(g[1:], base), (len(g), g[:-1])
        if not total[key]:
            return lower
        a = adjusted.get(g)
        return ((a - discount[len(g)]) / total[key] if a else 0.0) + discount[len(g)] * types[key] / total[key] * lower

    return p, {g for g in raw if len(g) == 1}


def test_model_is_kneser_ney(spark):
    rows = sample(20)
    model = li.train(docs(spark, rows).select("text", "lang"))
    plain = {lang: kneser_ney([t for _, t, x, _ in rows if x == lang], li.ORDER) for lang in model.langs}
    symbols = len(set().union(*(s for _, s in plain.values()))) + 1
    assert model.symbols == symbols
    for word in ["the", "über", "zzz", "a", "thatdie"]:
        bits, codes = li.word_bits(model, [word])
        assert codes[0] == len(word) + 1
        for i, lang in enumerate(model.langs):
            s = "^" + word + "$"
            want = -sum(math.log2(plain[lang][0](s[max(0, j - li.ORDER + 1) : j + 1], 1 / symbols)) for j in range(1, len(s)))
            assert bits[0, i] == pytest.approx(want, rel=1e-3)


@pytest.mark.parametrize("least_share", [0.0, 1e-3, 0.02, 0.5])
def test_probabilities_sum_to_one(spark, least_share):
    """Whatever is pruned: over all symbols and one that was never seen, after any context."""
    rows = sample(20)
    model = li.train(docs(spark, rows).select("text", "lang"), least_share=least_share)
    letters = sorted({c for words in WORDS.values() for w in words for c in w})
    assert model.symbols == len(letters) + 2
    kept, every = (sum(len(v.values) for v in m.alpha) for m in (model, li.train(docs(spark, rows).select("text", "lang"), least_share=0.0)))
    assert kept == every if not least_share else kept < every if least_share > 0.01 else kept <= every
    for context in ["", "t", "th", "ü", "qq", "nich"]:
        codes, starts = li.spelled([*(context + c for c in [*letters, "Ω"]), context])
        p, ends = li.probabilities(model, codes, starts), np.append(starts[1:], len(codes)) - 1
        # The last letter of each word but the last, which is the context alone with its end mark.
        assert np.allclose(p[ends[:-1] - 1].sum(axis=0) + p[ends[-1]], 1, atol=1e-4)


def test_calibration_takes_all_rows_in_any_order(spark):
    train, apart = docs(spark, sample()).select("text", "lang"), docs(spark, sample(40, 1000)).select("text", "lang")
    a, b = (li.calibrate(li.train(train.repartition(n), least_share=1e-3), apart.repartition(n)) for n in (1, 7))
    assert a.curve == b.curve and (a.limits == b.limits).all() and np.isfinite(a.limits).all()
    assert all((x.values == y.values).all() and (x.hashes == y.hashes).all() for x, y in zip(a.alpha + a.gamma, b.alpha + b.gamma, strict=True))


def test_held_out_accuracy_and_rejection(spark):
    model = li.calibrate(li.train(docs(spark, sample()).select("text", "lang")), docs(spark, sample(40, 1000)).select("text", "lang"))
    test = sample(10, 5000) + [(9000, "zxqj vkwp qqxz " * 20, None, None), (9001, "12 34 !!", None, None), (9002, None, "en", None), (9003, "²the² 5³", None, None)]
    got = {r.doc_id: r for r in li.identify(docs(spark, test), model).collect()}
    assert all(got[i].best == lang for i, _, lang, _ in test[:30])
    assert got[9000].rejected and got[9001].best == got[9002].best == "und" and got[9001].score == 0
    assert got[9003].best == "en"
    assert np.mean([got[i].rejected for i, *_ in test[:30]]) < 0.2 and all(0 <= r.score <= 1 for r in got.values())


def test_kept_words_don_t_change_results(spark):
    model = li.train(docs(spark, sample(10)).select("text", "lang"))
    texts = [t for _, t, *_ in sample(5, 70)] + ["new words here", "the the"]
    large, small = li.Scorer(model), li.Scorer(model, keep=3)
    for part in (texts[:4], texts[4:], texts):
        a, b = large.of(part), small.of(part)
        assert np.allclose(a[0], b[0]) and (a[1] == b[1]).all()


def test_edges(spark):
    model = li.train(docs(spark, sample(10)).select("text", "lang"))
    out = li.identify(clashing(spark), model)
    rows = out.collect()
    assert len(rows) == len(ROWS) and {r.shard for r in rows} == {"own shard"}
    assert li.identify(empty(spark), model).count() == 0
    none = li.train(empty(spark).select("text", "lang"))
    assert {r.best for r in li.identify(docs(spark), none).collect()} == {"und"}
