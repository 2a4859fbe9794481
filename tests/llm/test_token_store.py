import random
import zlib

import numpy as np
import pytest
from fixtures import ROWS, clashing, docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from semql.llm import elias_fano, token_store

tokenizers = pytest.importorskip("tokenizers")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**62)), max_size=700))
def test_elias_fano(values):
    values = np.sort(np.asarray(values, np.uint64))
    reader = elias_fano.Reader(elias_fano.encode(values))
    assert (reader.all() == values).all()
    for i in {0, len(values) // 2, len(values) - 1} if len(values) else ():
        assert reader.select(i) == values[i]
        assert reader.first_at_least(int(values[i])) == np.searchsorted(values, values[i])
    with pytest.raises(IndexError):
        reader.select(len(values))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=2500), st.data())
def test_elias_fano_ranges(values, data):
    values = np.sort(np.asarray(values, np.uint64))
    reader = elias_fano.Reader(elias_fano.encode(values))
    begin = data.draw(st.integers(0, len(values)))
    end = data.draw(st.integers(begin, len(values)))
    assert (reader.values(begin, end) == values[begin:end]).all()


def test_elias_fano_is_small_and_ordered():
    lengths = np.random.default_rng(1).integers(1, 2000, 20_000)
    assert 8 * len(elias_fano.encode(np.cumsum(lengths))) / len(lengths) < 2 + np.log2(2000) + 1
    with pytest.raises(ValueError):
        elias_fano.encode(np.asarray([2, 1]))


@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), max_size=30))
def test_document_ids(ids):
    ids = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_store.unpack_ids(token_store.pack_ids(ids)) == ids


@pytest.fixture(scope="module")
def tokenizer():
    with open(token_store.default_tokenizer(), encoding="utf-8") as f:
        return token_store.Tokenizer(f.read())


def test_ids_are_the_library_s(tokenizer):
    assert tokenizer.by_words
    rng = random.Random(2)
    alphabet = [*" \n\tabSTé́ñ日😀\x00\x1c\x1f\x85 .,'!sd0İßſKÅ×÷ªº²µΣ", "<|endoftext|>", "'re", "'LL", "<|startoftext|>"]
    for t in ["", "  ", "İ I", "ΑΣ.", "a\x1cb", "don't...!"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]:
        assert tokenizer.encode([t])[0].tolist() == tokenizer.library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_round_trip(spark, tmp_path, tokenizer, chunk):
    path = f"file://{tmp_path}/store"
    token_store.write(clashing(spark), path, token_store.default_tokenizer(), chunk_tokens=chunk)
    got = token_store.read(spark, path, with_ids=True).orderBy("start").collect()
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids[-1]) == (start, len(r.ids), 1)
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    want = sorted(((i, [*tokenizer.library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in ROWS), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == want


@pytest.mark.parametrize("chunk", [1, 60, 1 << 20])
def test_fetch(spark, tmp_path, chunk):
    path = f"file://{tmp_path}/store"
    token_store.write(docs(spark), path, token_store.default_tokenizer(), chunk_tokens=chunk)
    every = [(r.doc_id, r.ids) for r in token_store.read(spark, path, with_ids=True).collect()]
    asked = [1, 5, 9, 10, 77, -3]
    got = [tuple(r) for r in token_store.fetch(spark, path, asked).collect()]
    assert sorted(got) == sorted(r for r in every if r[0] in asked) and len(got) == 6
    assert token_store.fetch(spark, path, []).count() == 0


@pytest.mark.parametrize("suffix", [True, False])
def test_large_vocabulary(spark, tmp_path, suffix):
    """Ids of over 16 bits, with the tokenizer cut into words and without."""
    import json

    with open(token_store.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    words = [f"Q{i}" for i in range(70_000)]
    if suffix:
        spec["model"]["vocab"] |= {w: len(spec["model"]["vocab"]) + i for i, w in enumerate(words)}
        spec["added_tokens"] = []
        spec["post_processor"] = None
        low, top = spec["model"]["vocab"]["a</w>"], spec["model"]["vocab"]["Q69999"]
        moved = {"a</w>": top, "Q69999": low}
        spec["model"]["vocab"] |= moved
    else:
        spec = json.loads(tokenizers.Tokenizer(tokenizers.models.WordLevel({"[U]": 0} | {w: i + 1 for i, w in enumerate(words)}, "[U]")).to_str())
        spec["pre_tokenizer"] = {"type": "WhitespaceSplit"}
    path = f"{tmp_path}/wide.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, texts = tokenizers.Tokenizer.from_str(json.dumps(spec)), ["a b a", "Q69998 Q3 Q69998", None, "x a, Q66000 Q1"]
    token_store.write(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), f"file://{tmp_path}/store", path)
    got = {r.doc_id: r for r in token_store.read(spark, f"file://{tmp_path}/store", with_ids=True).collect()}
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert [got[i].ids for i in range(4)] == want and max(map(max, want)) > 1 << 16
    assert all(got[i].ids_crc32 == zlib.crc32(np.asarray(w, "<u4").tobytes()) for i, w in enumerate(want))


def test_one_id_may_hold_most_rows(spark, tmp_path, tokenizer):
    """Rows of one id are written by several tasks, and starts follow on."""
    rows = [(7, f"text {i % 50}", "en", "a") for i in range(300)] + [(i, "other", "en", "a") for i in range(20)]
    token_store.write(docs(spark, rows), f"file://{tmp_path}/store", token_store.default_tokenizer())
    chunks = spark.read.parquet(f"file://{tmp_path}/store")
    assert chunks.where("first_id <= 7 and last_id >= 7").select("part").distinct().count() > 1
    got = token_store.read(spark, f"file://{tmp_path}/store", with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, *_ in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted((i, [*tokenizer.library.encode(t, add_special_tokens=False).ids, 1]) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.ids) for r in got) == want


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write(empty(spark), path, token_store.default_tokenizer())
    assert token_store.read(spark, path).count() == 0
    assert docs(spark).count() == len(ROWS)
