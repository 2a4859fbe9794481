from fixtures import ROWS, docs, empty
from pyspark.sql import functions as F

from semql.llm.common import filter_of, only, without


def test_filter_holds_all_and_few_others(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    holds = filter_of(rows.where("h % 3 = 0"), "h")
    got = rows.select("h", (F.col("h") % 3 == 0).alias("own"), holds(F.col("h")).alias("held")).collect()
    assert all(r.held for r in got if r.own) and sum(r.held for r in got if not r.own) < 300
    small = filter_of(rows, "h", most_bits=1)
    assert rows.where(small(F.col("h"))).count() == 3000
    assert rows.where(filter_of(rows.where("false"), "h")(F.col("h"))).count() == 0


def test_only_and_without(spark):
    table = docs(spark)
    some = table.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).where("id is null or id in (2, 4, 9)")
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr)
    inside = sorted(((i, t) for i, t, *_ in ROWS if i in (None, 2, 4, 9)), key=repr)
    assert key(only(table, some, "doc_id", "text")) == inside
    assert key(without(table, some, "doc_id", "text")) == sorted(((i, t) for i, t, *_ in ROWS if i not in (None, 2, 4, 9)), key=repr)
    assert key(without(table, some.limit(0), "doc_id", "text")) == sorted(((i, t) for i, t, *_ in ROWS), key=repr)
    assert only(table, some.limit(0), "doc_id", "text").count() == 0 and without(empty(spark), some, "doc_id", "text").count() == 0
    assert "Python" not in without(table, some, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
