import pytest
from pyspark.sql import functions as F

from semql.functions.embedders import HashingEmbedder, NullEmbedder
from semql.operators.matchdsl import MatchError
from semql.operators.scan import Branch, Match
from semql.sources.store import Database


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    db = Database(spark, f"file://{tmp_path_factory.mktemp('db')}", HashingEmbedder())
    db.create_table("docs", "label TEXT", "year INTEGER", "notes TEXT VECTOR")
    rows = [("a", 2020, "billing support request"), ("b", 2021, "invoice and payment help"), ("c", 2022, "weather forecast notes"), ("tcp", 2023, "TCP/IP networking guide"), ("n", 2024, None), ("e", 2024, " ")]
    db.insert("docs", [dict(zip(("label", "year", "notes"), r, strict=True)) for r in rows])
    db.create_table("big", "status TEXT", "notes TEXT VECTOR")
    db.insert("big", spark.range(303).select(F.when(F.col("id") < 300, "archived").otherwise("active").alias("status"), F.when(F.col("id") < 300, "refund policy").otherwise("refund policy and terms").alias("notes")))
    db.create_table("two", "summary TEXT VECTOR", "body TEXT VECTOR")
    db.insert("two", [{"summary": "printer jam", "body": "paper stuck in tray"}, {"summary": "printer jam", "body": "all is well"}, {"summary": "lost key", "body": "paper stuck in tray"}])
    return db


def labels(df):
    return sorted(r.label for r in df.collect())


def test_match_and_score(db):
    t = db.table("docs")
    found = t.scan(Match("notes", "billing"))
    assert labels(found) == ["a"] and found.first().notes_score == pytest.approx(3**-0.5, abs=1e-6)
    assert labels(t.scan(Match("notes", "billing/exact"))) == ["a"]
    assert labels(t.scan(Match("notes", "TCP/IP"))) == labels(t.scan(Match("notes", '"tcp ip"/exact'))) == ["tcp"]
    assert t.columns == ["label", "year", "notes"] and t.star(found).columns == t.columns


@pytest.mark.parametrize("query", [None, "", "   ", "/exact"])
def test_queries_without_text_match_nothing(db, query):
    assert db.table("docs").scan(Match("notes", query)).count() == 0


def test_bad_queries_fail(db):
    with pytest.raises(MatchError):
        db.table("docs").scan(Match("notes", "billing/hnsw:0"))
    with pytest.raises(MatchError):
        db.table("docs").scan(Match("label", "billing"))


def test_a_null_query_stops_before_later_ones_are_read(db):
    assert db.table("docs").scan(Match("notes", None), Match("notes", "x/hnsw:0")).count() == 0


def test_no_match_has_null_scores(db):
    rows = db.table("docs").scan(where=F.col("year") >= 2022).collect()
    assert len(rows) == 4 and all(r.notes_score is None for r in rows)


def test_cap_and_the_recall_cliff(db):
    big = db.table("big")
    assert big.scan(Match("notes", "refund policy")).count() == 256
    assert big.scan(Match("notes", "refund policy/exact")).count() == 303
    assert big.scan(Match("notes", "refund policy/hnsw:5")).count() == 5
    assert big.scan(Match("notes", "refund policy"), where=F.col("status") == "active").count() == 3
    assert big.scan(Match("notes", "refund policy/hnsw:1"), where=F.col("status") == "active").count() == 3
    assert big.scan(Match("notes", "refund policy")).where(F.col("status") == "active").count() == 0


def test_threshold_narrows(db):
    t = db.table("docs")
    assert t.at(threshold=0.6).scan(Match("notes", "billing")).count() == 0
    assert t.scan(Match("notes", "billing")).where("notes_score > 0.57").count() == 1


def test_two_columns(db):
    t = db.table("two")
    rows = t.scan(Match("summary", "printer jam"), Match("body", "paper stuck in tray")).collect()
    assert [(r.summary, round(r.summary_score, 4), round(r.body_score, 4)) for r in rows] == [("printer jam", 1.0, 1.0)]
    one = t.scan(Match("summary", "printer jam")).collect()
    assert len(one) == 2 and all(r.body_score is None for r in one)


def test_any_of_takes_the_first_branch(db):
    t = db.table("two")
    found = t.any_of(Branch((Match("summary", "printer jam"),)), Branch((Match("body", "paper stuck in tray"),))).orderBy("_rowid").collect()
    assert [(r.summary_score is None, r.body_score is None) for r in found] == [(False, True), (False, True), (True, False)]


def test_default_order(db):
    t = db.table("two").at(threshold=-1.0)
    rows = t.ordered(t.scan(Match("summary", "printer jam"), Match("body", "paper stuck in tray"))).collect()
    assert [r._rowid for r in rows] == [1, 2, 3] or rows[0]._rowid == 1


def test_lone_match_plans_a_top_n(db):
    plan = db.table("big").scan(Match("notes", "refund policy"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(db):
    plan = db.table("docs").scan(Match("notes", "billing"), where=F.col("year") == 2020)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(year,2020)" in plan


def test_without_a_model(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}", NullEmbedder())
    db.create_table("t", "notes TEXT VECTOR")
    assert db.insert("t", [{"notes": "stored all the same"}]) == 1
    assert db.table("t").scan(Match("notes", "stored")).count() == 0 and db.rows("t").count() == 1
