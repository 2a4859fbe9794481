import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from semql.functions import embedders, sqlite, vectors

WORDS = [None, "", "abc", "ABC", "Abc ", "É", "é", "a%b", "a_b", "x]y", "[x", "ab\nc", "12abc", " -7", "+3.9", "abc  "]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "i long, s string")


def both(words, column, expression):
    """Values by our expression, and by sqlite."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (i INTEGER, s TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(WORDS)))
    ours = [r[0] for r in words.orderBy("i").select(column).collect()]
    theirs = [r[0] for r in con.execute(f"SELECT {expression} FROM t ORDER BY i")]
    return [int(x) if isinstance(x, bool) else x for x in ours], theirs


@pytest.mark.parametrize("pattern", ["abc", "ABC", "a%", "%b%", "a_b", "É", "%\n%", "[x", ""])
def test_like(words, pattern):
    ours, theirs = both(words, sqlite.like(F.col("s"), pattern), f"s LIKE '{pattern}'")
    assert ours == theirs


@pytest.mark.parametrize("pattern", ["abc", "a*", "?bc", "[aA]*", "[^a]*", "*", "[[]x", "*]*", "ab?c", "[a-c]*"])
def test_glob(words, pattern):
    ours, theirs = both(words, sqlite.glob(F.col("s"), pattern), f"s GLOB '{pattern}'")
    assert ours == theirs


@pytest.mark.parametrize("collation", ["BINARY", "NOCASE", "RTRIM"])
@pytest.mark.parametrize("value", ["abc", "ABC", "É", "abc  "])
def test_collations(words, collation, value):
    ours, theirs = both(words, sqlite.collated(F.col("s"), collation) == sqlite.collated(F.lit(value), collation), f"s = '{value}' COLLATE {collation}")
    assert ours == theirs


def test_casts_and_more(words):
    assert both(words, sqlite.cast_integer(F.col("s")), "CAST(s AS INTEGER)")[0] == both(words, F.col("s"), "CAST(s AS INTEGER)")[1]
    for ours, theirs in (both(words, sqlite.scalar_max(F.col("s"), F.lit("b")), "max(s, 'b')"), both(words, sqlite.scalar_min(F.col("s"), F.lit("b")), "min(s, 'b')"), both(words, sqlite.typeof(F.col("s"), "string"), "typeof(s)"), both(words, sqlite.divide(F.col("i") - 5, F.col("i") % 3), "(i - 5) / (i % 3)")):
        assert ours == theirs
    with pytest.raises(ValueError):
        sqlite.collated(F.col("s"), "KLINGON")
    assert sqlite.like_prefix("act%") == "act" and sqlite.like_prefix("a%t%") is None and sqlite.like_prefix("%") is None


@pytest.mark.parametrize("real", [9007199254740992.0, 0.5, -0.5, 3.0, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), 2.0**63, -(2.0**63)])
def test_integers_against_reals(spark, real):
    numbers = [None, 0, -1, 3, 9007199254740993, 9007199254740992, 2**63 - 1, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i long, n long").orderBy("i").select(sqlite.compare(F.col("n"), real)).collect()]
    assert got == [None if n is None or real != real else (n > real) - (n < real) for n in numbers]


def test_total(spark):
    rows = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert rows.agg(sqlite.total(F.col("x"))).first()[0] == 3.0 and rows.limit(0).agg(sqlite.total(F.col("x"))).first()[0] == 0.0
    assert sorted(rows.agg(sqlite.group_concat(F.col("x"))).first()[0].split(",")) == ["1", "2"]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0, 2.0, 3.0], [2.0, 1.0])], "a array<float>, b array<float>")
    got = rows.select(vectors.dot(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b")), vectors.normalize(F.col("a"))).collect()
    assert [r[0] for r in got] == [3.0, 0.0, None, 4.0] and got[0][1] == pytest.approx(0.6) and got[1][1] == 0.0 and got[2][1] is None
    assert got[0][2] == pytest.approx([0.6, 0.8]) and got[1][2] == [0.0, 0.0]


def test_hashing_embedder(spark):
    e = embedders.HashingEmbedder()
    a, b, none, blank = e.embed(["Red apple", "red APPLE!", None, " "])
    assert none is None and blank is None and np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6
    rows = spark.createDataFrame([("red apple",), (None,), ("",)], "t string").select(embedders.embed_column(F.col("t"), e).alias("v")).collect()
    assert np.allclose(rows[0].v, a) and rows[1].v is None and rows[2].v is None


def test_pooling_and_registry():
    x = np.arange(12, dtype=np.float32).reshape(1, 3, 4)
    assert embedders.pooled(x, 4).tolist() == [4, 5, 6, 7] and embedders.pooled(x[0, :1], 4).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        embedders.pooled(x, 5)
    assert embedders.OnnxEmbedder("gte-small", "m", "t").dim == 384
    with pytest.raises(ValueError):
        embedders.OnnxEmbedder("unknown", "m", "t")


def field(number, value):
    """A field of a protocol buffer: a number, or bytes."""

    def varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model(table):
    """An ONNX model that looks token ids up in a table: [texts, tokens] to [texts, tokens, dim]."""
    tensor = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "out") + field(4, "Gather")
    shape = lambda *dims: b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
    value = lambda name, kind, dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, dims)))
    graph = field(1, node) + field(2, "g") + field(5, tensor) + field(11, value("input_ids", 7, shape("n", "t"))) + field(12, value("out", 1, shape("n", "t", table.shape[1])))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_onnx_embedder(spark, tmp_path):
    """Texts of different lengths, in one batch, are the normalised means of their tokens' rows."""
    pytest.importorskip("onnxruntime")
    tokenizers = pytest.importorskip("tokenizers")
    words = ["[U]", "red", "apple", "blue", "sky"]
    tokenizer = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(words)}, "[U]"))
    tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    table = np.random.default_rng(1).normal(size=(5, 3))
    (tmp_path / "model.onnx").write_bytes(tiny_model(table))
    e = embedders.OnnxEmbedder("tiny", str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), dim=3, max_tokens=4)
    texts = ["red apple", "  blue sky ", None, "sky", "", "red red blue apple sky sky", "apple", "nothing known"]
    for most in (64, 1):
        for text, got in zip(texts, e.embed(texts, most), strict=True):
            if not (text or "").strip():
                assert got is None
                continue
            mean = table[[words.index(w) if w in words else 0 for w in text.split()][:4]].mean(axis=0)
            assert np.allclose(got, mean / np.linalg.norm(mean), atol=1e-5)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", embedders.embed_column(F.col("t"), e).alias("v"))
    assert [r.v is None for r in rows.orderBy("i").collect()] == [not (t or "").strip() for t in texts]


STAMPS = ["2024-02-29 13:14:15", "1999-12-31 23:59:59", "1970-01-01 00:00:00", "2023-01-31 06:00:00", None]
MODIFIERS = [(), ("+1 day",), ("-36 hours",), ("+90 seconds",), ("start of month", "+1 month", "-1 day"), ("+1 month",), ("-1 year",), ("start of year",), ("start of day",), ("weekday 0",), ("weekday 3", "+10 minutes")]


def test_dates_as_sqlite_has_them(spark):
    con = sqlite3.connect(":memory:")
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(STAMPS)], "i int, s string").withColumn("t", F.col("s").cast("timestamp")).orderBy("i")
    pattern = "%Y/%m/%d %H-%M-%S %j %w %s 100%%"
    for mods in MODIFIERS:
        t = sqlite.modified(F.col("t"), *mods)
        got = [tuple(r) for r in rows.select(sqlite.strftime(pattern, t), sqlite.strftime("%F %T", t), sqlite.unixepoch(t), F.round(sqlite.julianday(t), 6)).collect()]
        args = "?1" + "".join(f", '{m}'" for m in mods)
        want = [con.execute(f"SELECT strftime('{pattern}', {args}), datetime({args}), CAST(strftime('%s', {args}) AS INTEGER), round(julianday({args}), 6)", [s]).fetchone() for s in STAMPS]
        assert got == want, mods
    for bad in (lambda: sqlite.strftime("%Q", F.col("t")), lambda: sqlite.modified(F.col("t"), "next week")):
        with pytest.raises(ValueError):
            bad()


def test_json(spark):
    texts = ['{"a": 1, "b": "x", "c": [1, 2], "d": null, "e": {"f": 1.5}, "g": true}', '[1, "two", null]', "{}", "nothing", None]
    paths = ("$", "$.a", "$.b", "$.c", "$.d", "$.e", "$.e.f", "$.g", "$.none")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    con, t = sqlite3.connect(":memory:"), F.col("t")
    got = rows.select(sqlite.json_valid(t), *[sqlite.json_type(t, p) for p in paths]).collect()
    for text, r in zip(texts, got, strict=True):
        valid = con.execute("SELECT json_valid(?)", [text]).fetchone()[0]
        kinds = con.execute("SELECT " + ", ".join(f"json_type(?1, '{p}')" for p in paths), [text]).fetchone() if valid else [None] * 9
        assert r[0] == (None if text is None else bool(valid)) and list(r[1:]) == list(kinds), text
    members = rows.select("i", F.explode(sqlite.json_entries(t)).alias("m")).select("i", "m.key", "m.value").collect()
    assert [(r.key, r.value) for r in members] == [("a", "1"), ("b", "x"), ("c", "[1,2]"), ("d", None), ("e", '{"f":1.5}'), ("g", "true")]
    assert rows.select(sqlite.json_elements(t).alias("e")).collect()[1].e == ["1", "two", None]
