import hashlib
import random

import pytest
from fixtures import ROWS, clashing, docs, empty

from semql.llm import sentencepiece_codec as sc

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def codec():
    with open(sc.default_model(), "rb") as f:
        return sc.Codec(f.read())


def texts():
    rng = random.Random(1)
    alphabet = " ▁\n\tab<s>0éñ日😀\x00.<0x0A>"
    return ["", " ", "  ", "\n", " \n ", "▁", "a▁b", "<s>", "<unk> <0x0A>", "日本語 テスト", "q" * 3000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


def test_ids_are_the_library_s(codec):
    assert codec.apart
    for t in texts():
        assert codec.encode([t])[0].tolist() == codec.library.encode(t), repr(t)


def test_spans_tile_the_text(codec):
    for t in texts():
        ids = codec.encode([t])[0]
        begins, ends = codec.spans(t.encode(), ids)
        assert (begins[1:] == ends[:-1]).all() and (begins <= ends).all()
        if len(ids):
            assert (begins[0], ends[-1]) == (0, len(t.encode()))
        for i, a, b in zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True):
            piece = codec.library.id_to_piece(i)
            if not codec.library.is_byte(i):
                assert t.encode()[a:b].decode().replace(" ", sc.MARK) == piece or (a == 0 and piece.startswith(sc.MARK))


@pytest.mark.parametrize("dummy,trim,escape", [(False, False, False), (True, False, True), (False, True, True), (True, True, True)])
def test_character_map(dummy, trim, escape):
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=dummy, remove_extra_whitespaces=trim, escape_whitespaces=escape)
    model = proto.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = sc.Normalizer(model.normalizer_spec)
    for t in ["Ａｂｃ　ｄ", " ﬁ  x ", "①②㌔ é é  ", "a\tb\n", "", " ", "½ ™ 가 ガ", *texts()[:200]]:
        data, align = own(t.encode())
        assert data.decode() == library.normalize(t), repr(t)
        assert len(align) == len(data) + 1 and (align[1:] >= align[:-1]).all()


def test_large_vocabulary(spark, codec, tmp_path):
    """Pieces with ids above 65,536, which texts use."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(sc.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    for i in range(40_000):
        model.pieces.add(piece=f"{sc.MARK}q{i}", score=-1.0 - i if i % 2 else -40_000.0 - i, type=1)
    path = tmp_path / "wide.model"
    path.write_bytes(model.SerializeToString())
    library = spm.SentencePieceProcessor(model_file=str(path))
    texts = ["the q39999 q39998", "q1 q12345 and the rest", None]
    rows = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    want = [library.encode(t or "") for t in texts]
    assert [r.ids for r in sc.encode(rows, str(path)).orderBy("doc_id").collect()] == want
    digest = sc.encode(rows, str(path), result="digest").orderBy("doc_id").collect()
    assert [r.ids_sha256 for r in digest] == [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
    assert max(max(w, default=0) for w in want) > 1 << 16


def test_rows(spark, codec):
    out = sc.encode(docs(spark), sc.default_model(), result="digest").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in ROWS:
        ids = codec.library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(codec.library.decode(ids))))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out), key=repr) == sorted(want, key=repr)


def test_pieces_clashes_and_empty(spark):
    found = sc.encode(clashing(spark), sc.default_model())
    assert dict(found.dtypes)["ids"] == "array<int>" and {r.score for r in found.collect()} == {"own score"}
    assert sc.encode(empty(spark), sc.default_model()).count() == 0
