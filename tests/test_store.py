import json

import pytest
from pyspark.sql import functions as F

from semql.functions.embedders import HashingEmbedder
from semql.operators.scan import Match
from semql.sources.store import ColumnDef, Database, StoreError
from semql.sources.workspace import MARKER, Workspace, register_functions
from semql.streaming.ingest import ingest


def open_db(spark, path, **kw):
    return Database(spark, f"file://{path}", HashingEmbedder(**kw))


@pytest.fixture
def db(spark, tmp_path):
    db = open_db(spark, tmp_path)
    db.create_table("t", "name TEXT", "notes TEXT VECTOR", "n INTEGER")
    db.insert("t", [{"name": "a", "notes": "red apple"}, {"name": "b", "notes": "blue sky", "n": 2}])
    return db


def names(df):
    return sorted(r.name for r in df.collect())


@pytest.mark.parametrize(
    "text,want", [("n", ("n", "", False)), ("notes TEXT VECTOR", ("notes", "TEXT", True)), ('"my col" vector', ("my col", "", True)), ("[x y] TEXT NOT NULL", ("x y", "TEXT NOT NULL", False)), ("`q` INTEGER PRIMARY KEY", ("q", "INTEGER PRIMARY KEY", False))]
)
def test_column_definitions(text, want):
    c = ColumnDef.of(text)
    assert (c.name, c.decl_type, c.vector) == want


def test_insert_update_delete(db):
    assert db.insert("t", [{"name": "c", "notes": "green grass"}]) == 1
    db.update("t", {"notes": "yellow banana"}, F.col("name") == "a")
    assert names(db.table("t").scan(Match("notes", "yellow banana"))) == ["a"] and names(db.table("t").scan(Match("notes", "red apple"))) == []
    db.delete("t", F.col("n") == 2)
    assert sorted((r._rowid, r.name) for r in db.rows("t").collect()) == [(1, "a"), (3, "c")]
    db.insert("t", [{"_rowid": 3, "name": "z"}, {"_rowid": 10, "name": "y"}])
    db.insert("t", [{"name": "x"}])
    assert sorted((r._rowid, r.name) for r in db.rows("t").collect()) == [(1, "a"), (3, "z"), (10, "y"), (11, "x")]


def test_row_ids_are_unique(spark, db):
    """The last row that brings an id stays; a row that moves onto another's id replaces it."""
    assert db.insert("t", [{"_rowid": 5, "name": "x"}, {"_rowid": 5, "name": "y"}, {"_rowid": 6, "name": "z"}, {"name": "free"}]) == 4
    assert sorted((r._rowid, r.name) for r in db.rows("t").collect()) == [(1, "a"), (2, "b"), (5, "y"), (6, "z"), (7, "free")]
    many = spark.range(0, 400, numPartitions=8).select((F.col("id") % 3 + 20).alias("_rowid"), F.col("id").cast("string").alias("name"))
    assert db.insert("t", many) == 400
    assert sorted((r._rowid, r.name) for r in db.rows("t").where("_rowid >= 20").collect()) == [(20, "399"), (21, "397"), (22, "398")]
    db.update("t", {"_rowid": 1}, F.col("name") == "y")
    assert sorted((r._rowid, r.name) for r in db.rows("t").where("_rowid < 20").collect()) == [(1, "y"), (2, "b"), (6, "z"), (7, "free")]
    db.update("t", {"_rowid": F.col("_rowid") + 1}, F.col("_rowid") < 3)  # 1 to 2 and 2 to 3
    assert sorted((r._rowid, r.name) for r in db.rows("t").where("_rowid < 20").collect()) == [(2, "y"), (3, "b"), (6, "z"), (7, "free")]
    db.update("t", {"_rowid": 100, "notes": "moved words"}, F.col("_rowid").isin(2, 3))
    assert names(db.table("t").scan(Match("notes", "moved words"))) == ["b"] and db.rows("t").where("_rowid < 4").count() == 0
    db.insert("t", [{"name": "next"}])
    assert db.rows("t").where("name = 'next'").first()._rowid == 101


def test_compact_and_vacuum(spark, tmp_path, db):
    for i in range(3):
        db.insert("t", [{"name": f"c{i}"}])
    folders = lambda: [d for d in db._list(f"{db.root}/t") if not d.startswith("_")]
    assert len(folders()) == len(db._manifest("t").segments) == 4  # nothing is left of staging
    db.compact("t")
    assert len(db._manifest("t").segments) == 1 and names(db.rows("t")) == ["a", "b", "c0", "c1", "c2"]
    assert db.vacuum("t", versions=2) == 0 and db.vacuum("t") == 4 and len(folders()) == 1
    assert names(open_db(spark, tmp_path).rows("t")) == ["a", "b", "c0", "c1", "c2"]


def test_many_partitions_number_on(spark, db):
    db.insert("t", spark.range(0, 500, numPartitions=7).select(F.col("id").cast("string").alias("name")))
    ids = sorted(r._rowid for r in db.rows("t").collect())
    assert ids == list(range(1, 503))


def test_binary_is_null_and_unknown_columns_fail(spark, db):
    db.insert("t", spark.createDataFrame([(bytearray(b"x"), "q")], "notes binary, name string"))
    assert db.rows("t").where("name = 'q'").first().notes is None
    for call in (lambda: db.insert("t", [{"nope": 1}]), lambda: db.update("t", {"nope": 1}), lambda: db.rows("nope"), lambda: db.create_table("u"), lambda: db.create_table("t", "a")):
        with pytest.raises(StoreError):
            call()


def test_reopen_and_drop(spark, tmp_path, db):
    again = open_db(spark, tmp_path)
    assert names(again.table("t").scan(Match("notes", "red apple"))) == ["a"] and again.describe("t")[1] == ("notes", "TEXT", True)
    again.drop_table("t")
    assert again.tables() == [] and db.tables() == []
    db.create_table("t", "name TEXT")
    assert db.rows("t").count() == 0


def test_another_model_is_refused_until_reindexed(spark, tmp_path, db):
    other = open_db(spark, tmp_path, dim=64, model_id="hashing-64")
    with pytest.raises(StoreError, match="reindex required"):
        other.table("t")
    other.reindex("t")
    assert names(other.table("t").scan(Match("notes", "red apple"))) == ["a"]


def test_transactions(db):
    db.begin()
    db.delete("t", F.col("name") == "a")
    assert names(db.rows("t")) == ["b"]
    db.rollback()
    assert names(db.rows("t")) == ["a", "b"]
    db.begin()
    db.insert("t", [{"name": "c"}])
    db.savepoint("s")
    db.delete("t")
    assert names(db.rows("t")) == []
    db.rollback_to("s")
    db.insert("t", [{"name": "d"}])
    db.release("s")
    db.commit()
    assert names(db.rows("t")) == ["a", "b", "c", "d"]
    with pytest.raises(StoreError):
        db.commit()


def test_readers_keep_their_version(db):
    before = db.rows("t")
    db.delete("t")
    assert names(before) == ["a", "b"] and names(db.rows("t")) == []


def test_two_writers(spark, tmp_path, db):
    other = open_db(spark, tmp_path)
    number = len(db._versions("t")) + 1
    other._write(f"file://{tmp_path}/t/_manifests/{number:012d}.json", "{}")
    with pytest.raises(StoreError, match="another writer"):
        db._write(f"file://{tmp_path}/t/_manifests/{number:012d}.json", "{}")


def test_workspace(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws", HashingEmbedder())
    w.open_database("x")
    seen = []
    script = "\n".join([json.dumps({"create": "q", "columns": ["a TEXT", "b TEXT VECTOR"]}), MARKER, *(json.dumps({"insert": "q", "rows": [{"a": str(i), "b": f"hello number{i}"}]}) for i in range(3))])
    assert w.run_script(script, lambda done, all_: seen.append((done, all_))) == 3 and seen[-1] == (3, 3)
    got = w.search("q", "b", "hello number1", exact=True)
    assert got.columns == ["rowid", "a", "b", "_similarity"] and got.rows()[0] == (2, "1", "hello number1", 1.0) and got.metrics["search_ops"] == 1
    assert w.query("SELECT count(*) AS n FROM q WHERE a > ?", ["0"]).rows() == [(2,)] and "_emb_b" in w.query("SELECT * FROM q_data").columns
    w.update_cell("q", 1, "b", "changed")
    w.insert_row("q", {"a": "9"})
    w.delete_row("q", 3)
    assert [r.rowid for r in w.table_data("q", 2, 1).collect()] == [2, 4] and w.schema() == {"q": [("a", "TEXT", False), ("b", "TEXT", True)]}
    with pytest.raises(StoreError):
        w.insert_row("q", {})
    w.write_notes("x", "one")
    w.write_notes("x", "two")
    assert w.read_notes("x") == "two" and w.read_notes("y") == "" and w.list_databases() == ["x"]
    w.drop_database("x")
    assert w.list_databases() == []


def test_introspection(spark):
    from semql.functions.embedders import NullEmbedder

    register_functions(spark, HashingEmbedder())
    assert tuple(spark.sql("SELECT semql_version(), semql_model(), semql_dim()").first()) == ("0.1.0", "hashing-256", 256)
    register_functions(spark, NullEmbedder())
    assert tuple(spark.sql("SELECT semql_model(), semql_dim()").first()) == (None, None)


def test_stream(spark, tmp_path, db):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(i + 100, f"s{i}", "streamed words") for i in range(5)], "_rowid long, name string, notes string")
    rows.write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest(spark.readStream.schema(rows.schema).parquet(source), db, "t", str(tmp_path / "log")).awaitTermination()
    assert db.rows("t").count() == 7 and db.table("t").scan(Match("notes", "streamed words")).count() == 5


def test_metrics(db):
    """Counters of inserts, and of searches once they have run."""
    before = db.metrics.snapshot()
    db.insert("t", [{"name": "c", "notes": "green grass"}, {"name": "d", "notes": None}])
    added = db.metrics.since(before)
    assert added["embed_calls"] == 1 and added["persist_ms"] > 0 and added["embed_ms"] > 0 and added["search_ops"] == 0
    before = db.metrics.snapshot()
    found = db.table("t").scan(Match("notes", "red apple"))
    assert db.metrics.since(before)["rows_matched"] == 0
    rows = found.collect()
    added = db.metrics.since(before)
    assert added["embed_calls"] == added["search_ops"] == 1 and json.loads(db.metrics.log_json())[-1]["text"] == "red apple"
    assert added["rows_matched"] == len(rows) == 1 and added["candidates"] == 3 and added["index_rebuilds"] == 0
    found.collect()
    assert db.metrics.since(before) == added
    db.table("t").scan(Match("notes", " ")).collect()
    assert db.metrics.since(before)["search_ops"] == 1
    assert set(json.loads(db.metrics.as_json())) >= {"embed_ms", "persist_ms", "search_ms", "candidates", "rows_matched"}
    db.metrics.reset_log()
    assert json.loads(db.metrics.log_json()) == []


def test_counted_scans_may_be_joined_and_united(db):
    found = db.table("t").scan(Match("notes", "red apple"))
    assert found.alias("x").join(found.alias("y"), F.col("x._rowid") == F.col("y._rowid")).count() == 1
    assert found.union(found).count() == 2


def test_join_before_the_search(spark, db):
    """A join that holds before a search isn't cut by its cap, one after it is."""
    db.insert("t", spark.range(30).select(F.concat(F.lit("red apple pie number"), "id").alias("notes"), F.lit("many").alias("name")))
    other = spark.createDataFrame([(25,), (26,)], "key long")
    source = db.table("t").at(cap=3)
    joined = source.scan(Match("notes", "red apple"), join=(other, F.col("_rowid") == F.col("key")))
    assert sorted(r._rowid for r in joined.collect()) == [25, 26]
    assert source.scan(Match("notes", "red apple")).join(other, F.col("_rowid") == F.col("key")).count() == 0


def test_only_touched_segments_are_rewritten(db):
    db.insert("t", [{"name": "c"}])
    first, second = db._manifest("t").segments
    db.delete("t", F.col("name") == "c")
    assert db._manifest("t").segments[0] == first and len(db._manifest("t").segments) == 2
    kept = db._manifest("t").segments
    db.update("t", {"n": 5}, F.col("name") == "nobody")
    db.delete("t", F.col("name") == "nobody")
    assert db._manifest("t").segments == kept and second not in kept and names(db.rows("t")) == ["a", "b"]


def test_search_index_follows_changes(spark, db):
    db.insert("t", spark.range(200).select(F.concat(F.lit("thing number"), "id").alias("notes"), F.col("id").cast("string").alias("name")))
    best = db.approximate("t", "notes", "thing number7", 3).collect()
    assert best[0].score == pytest.approx(1.0, abs=1e-6) and db.metrics.index_rebuilds == 1
    assert db.approximate("t", "notes", "red apple").first()._rowid == 1 and db.metrics.index_rebuilds == 1
    db.delete("t", F.col("name") == "a")
    assert db.approximate("t", "notes", "red apple").count() == 0 and db.metrics.index_rebuilds == 2
    assert db.approximate("t", "notes", " ").count() == 0


def test_search_index_outlives_the_session(spark, tmp_path):
    db = open_db(spark, tmp_path)
    db.create_table("two", "a TEXT VECTOR", "b TEXT VECTOR")
    db.insert("two", spark.range(60).select(F.concat(F.lit("left"), "id").alias("a"), F.concat(F.lit("right"), "id").alias("b")))
    for _ in range(2):
        assert db.approximate("two", "a", "left7").count() == db.approximate("two", "b", "right7").count() == 1
    assert db.metrics.index_rebuilds == 2
    again = open_db(spark, tmp_path)
    assert again.approximate("two", "a", "left9").first()._rowid == db.approximate("two", "a", "left9").first()._rowid and again.metrics.index_rebuilds == 0
    again.insert("two", [{"a": "left new"}])
    assert again.approximate("two", "a", "left new").count() == 1 and again.metrics.index_rebuilds == 1
    assert len([x for x in db._list(f"{db.root}/two/_index") if not x.endswith(".json")]) == 2


def test_observed_counts(db):
    from pyspark.sql import Observation

    seen = Observation("scan")
    assert db.table("t").scan(Match("notes", "red apple"), observation=seen).count() == 1
    assert seen.get == {"candidates": 2, "rows_matched": 1}


def test_views(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws2", HashingEmbedder())
    w.open_database("x").create_table("tv", "a TEXT", "n INTEGER")
    w.insert_row("tv", {"a": "one", "n": 1})
    w.create_view("totals", "SELECT a, sum(n) AS total FROM tv GROUP BY a")
    w.insert_row("tv", {"a": "one", "n": 2})
    assert w.query("SELECT * FROM totals").rows() == [("one", 3)] and w.views() == ["totals"]
    w.create_view("above", "SELECT a FROM totals WHERE total > 2")
    assert w.query("SELECT * FROM above").rows() == [("one",)] and w.views() == ["totals", "above"]
    for name in ("totals", "tv"):
        with pytest.raises(StoreError):
            w.create_view(name, "SELECT 1")
    w.drop_view("above")
    assert w.views() == ["totals"]


def test_embedder_specs():
    from semql.functions.embedders import NullEmbedder, resolve_embedder

    assert resolve_embedder(None) == NullEmbedder() and resolve_embedder("hashing-32").dim == 32
    assert resolve_embedder({"id": "gte-small", "model": "m", "tokenizer": "t"}).dim == 384
    for bad in ("gte-small", "nothing"):
        with pytest.raises(ValueError):
            resolve_embedder(bad)


def test_semantic_predicates_in_sql(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws3", HashingEmbedder())
    w.open_database("x").create_table("ts", "status TEXT", "notes TEXT VECTOR")
    w.open_database("x").insert("ts", [{"status": "open", "notes": "red apple"}, {"status": "shut", "notes": "red apple pie"}, {"status": "open", "notes": None}])
    text = "SELECT status, round(semql_dot(_emb_notes, :q), 4) AS s FROM ts_data WHERE semql_dot(_emb_notes, :q) >= :least ORDER BY s DESC"
    assert w.query(text, {"q": w.embed("red apple"), "least": 0.5}).rows() == [("open", 1.0), ("shut", 0.8165)]
    assert w.query(text, {"q": w.embed(" "), "least": 0.5}).rows() == []


def test_search_in_sql(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws4", HashingEmbedder())
    db = w.open_database("x")
    db.create_table("tm", "status TEXT", "notes TEXT VECTOR", "title TEXT VECTOR")
    db.insert("tm", [{"status": "open", "notes": "red apple", "title": "it's fruit"}, {"status": "shut", "notes": "red apple pie"}, {"status": "open", "notes": None}])
    assert w.query("SELECT rowid, status, round(notes_score, 4) FROM tm_notes_match('red apple') ORDER BY rowid").rows() == [(1, "open", 1.0), (2, "shut", 0.8165)]
    assert w.query("SELECT rowid FROM tm_notes_match('red apple', 1) WHERE status = 'shut'").rows() == []  # the cap comes first
    assert w.query("SELECT rowid FROM tm_notes_match(:q, least => 0.9)", {"q": "red apple"}).rows() == [(1,)]
    assert w.query("SELECT a.rowid, b.title_score > 0.99 FROM tm_notes_exact('red apple') a JOIN tm_title_exact('it''s fruit') b ON a.rowid = b.rowid").rows() == [(1, True)]
    assert w.query("SELECT count(*) FROM tm_notes_exact(NULL)").rows() == [(0,)] and w.query("SELECT count(*) FROM tm_notes_exact(' ')").rows() == [(0,)]
    plan = w.query("SELECT * FROM tm_notes_match('red apple')").df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    w.create_view("red", "SELECT rowid, status FROM tm_notes_exact('red apple')")
    assert w.query("SELECT count(*) FROM red").rows() == [(2,)]


def test_results_count_when_they_run(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws5", HashingEmbedder())
    w.open_database("x").create_table("tr", "notes TEXT VECTOR")
    w.insert_row("tr", {"notes": "red apple"})
    got = w.search("tr", "notes", "red apple")
    planned = got.elapsed_ms
    assert len(got.rows()) == got.metrics["rows_matched"] == 1 and got.metrics["candidates"] >= 1
    assert got.elapsed_ms > planned and got.metrics["search_ms"] > 0
