"""Relational coverage: what SQL around a semantic scan may use."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semql.functions import sqlite
from semql.plans.semantic import table

FOUND: dict = {}


def query(name: str, sql: str):
    def add(f):
        FOUND[name] = (f, sql)
        return f

    return add


@query(
    "q1_agg",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def q1_agg(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(price), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(
    "q3_join_topk",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON o_custkey = c_custkey
       JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate
       ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, l_orderkey LIMIT 10""",
)
def q3_join_topk(spark, d):
    wanted = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
    joined = wanted.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = joined.groupBy("l_orderkey", "o_orderdate").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return sums.orderBy(F.desc("r"), "l_orderkey").limit(10).select("l_orderkey", F.round("r", 2).alias("revenue"), "o_orderdate")


@query(
    "q5_multi_join",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name = 'ASIA' GROUP BY n_name""",
)
def q5_multi_join(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    joined = joined.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region").where(F.col("r_name") == "ASIA"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("q6_filter", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def q6_filter(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("distinct_count", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderpriority")
def distinct_count(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.count(F.when(F.col("o_totalprice") > 100000, 1)).alias("large"))


@query("total_concat", "SELECT n_regionkey, coalesce(sum(CAST(n_nationkey AS DOUBLE)), 0.0) AS total, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def total_concat(spark, d):
    names = F.array_join(F.array_sort(F.collect_list("n_name")), "|")  # a region's nations: few by nature
    return table(spark, d, "nation").groupBy("n_regionkey").agg(sqlite.total(F.col("n_nationkey")).alias("total"), names.alias("names"))


@query("json_extract", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.page')) AS pages, count(DISTINCT json_extract_string(props, '$.ref')) AS refs FROM events GROUP BY event_type")
def json_extract(spark, d):
    of = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(of("page")).alias("pages"), F.countDistinct(of("ref")).alias("refs"))


@query(
    "join_kinds",
    """SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000
       GROUP BY c_custkey""",
)
def join_kinds(spark, d):
    large = table(spark, d, "orders").where(F.col("o_totalprice") > 150000)
    joined = table(spark, d, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey")
    return joined.agg(F.count("o_orderkey").alias("n_orders"), F.coalesce(F.round(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("spent"))


@query("full_join", "SELECT coalesce(CAST(n_nationkey AS BIGINT), -1) AS nation, count(s_suppkey) AS suppliers FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 GROUP BY 1")
def full_join(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "supplier"), (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("s_acctbal") > 0), "full")
    return joined.groupBy(F.coalesce(F.col("n_nationkey").cast("long"), F.lit(-1).cast("long")).alias("nation")).agg(F.count("s_suppkey").alias("suppliers"))


@query(
    "range_join",
    """SELECT r.r_name, n.n_name FROM region r JOIN nation n ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 2""",
)
def range_join(spark, d):
    span = F.col("n_nationkey").between(F.col("r_regionkey") * 5, F.col("r_regionkey") * 5 + 2)
    return table(spark, d, "region").join(table(spark, d, "nation"), span).select("r_name", "n_name")


@query(
    "semi_anti_join",
    """SELECT c_custkey, 'none' AS kind FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey)
       UNION ALL SELECT c_custkey, 'urgent' FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def semi_anti_join(spark, d):
    customer, orders = table(spark, d, "customer"), table(spark, d, "orders")
    none = customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", F.lit("none").alias("kind"))
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    return none.unionByName(customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", F.lit("urgent").alias("kind")))


@query(
    "cte_recursive",
    """WITH RECURSIVE r AS (SELECT 0 AS level, CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = 1
       UNION ALL SELECT level + 1, k * 2 FROM r WHERE level < 4) SELECT level, k, n_name FROM r LEFT JOIN nation ON n_nationkey = k""",
)
def cte_recursive(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("semql_nation")
    return spark.sql("""
        WITH RECURSIVE r AS (SELECT 0 AS level, CAST(n_nationkey AS BIGINT) AS k FROM semql_nation WHERE n_nationkey = 1
        UNION ALL SELECT level + 1, k * 2 FROM r WHERE level < 4) SELECT level, k, n_name FROM r LEFT JOIN semql_nation ON n_nationkey = k""")


@query(
    "parameters",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
)
def parameters(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("semql_orders")
    text = "SELECT o_orderkey, o_totalprice FROM semql_orders WHERE o_totalprice > ? AND o_orderstatus = ? AND o_totalprice > (SELECT avg(o_totalprice) FROM semql_orders)"
    return spark.sql(text, args=[200000, "F"])


@query(
    "windows",
    """SELECT event_id, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS tile, lag(value, 1, -1.0) OVER w AS prev, lead(value) OVER w AS nxt,
       first_value(event_id) OVER w AS first_id, coalesce(nth_value(event_id, 2) OVER w, -1) AS second_id, round(percent_rank() OVER p, 6) AS pr, round(cume_dist() OVER p, 6) AS cd,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY event_type)""",
)
def windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = Window.partitionBy("user_id").orderBy("event_type")
    return table(spark, d, "events").select(
        "event_id", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(4).over(w).alias("tile"),
        F.lag("value", 1, -1.0).over(w).alias("prev"), F.lead("value").over(w).alias("nxt"), F.first("event_id").over(w).alias("first_id"), F.coalesce(F.nth_value("event_id", 2).over(w), F.lit(-1)).alias("second_id"),
        F.round(F.percent_rank().over(p), 6).alias("pr"), F.round(F.cume_dist().over(p), 6).alias("cd"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"),
    )


@query(
    "scalars",
    """SELECT p_partkey, substr(p_name, 2, 3) AS part, instr(p_name, 'a') AS at, length(p_name) AS len, replace(p_type, 'A', 'b') AS rep, upper(p_brand) AS up, p_size // 7 AS whole, p_size % 7 AS rest,
       CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, coalesce(nullif(p_size, 1), -1) AS no_one, greatest(p_size, 10) AS most, round(p_retailprice, 1) AS price, p_name ILIKE '%E%' AS has_e,
       p_name GLOB '*[aeiou]*' AS has_vowel, abs(p_size - 25) AS away FROM part""",
)
def scalars(spark, d):
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey", F.substring("p_name", 2, 3).alias("part"), F.instr("p_name", "a").alias("at"), F.length("p_name").alias("len"), F.replace(c("p_type"), F.lit("A"), F.lit("b")).alias("rep"),
        F.upper("p_brand").alias("up"), sqlite.divide(c("p_size"), F.lit(7)).cast("int").alias("whole"), (c("p_size") % 7).alias("rest"), F.when(c("p_size") > 25, "big").otherwise("small").alias("kind"),
        F.coalesce(F.nullif(c("p_size"), F.lit(1)), F.lit(-1)).alias("no_one"), sqlite.scalar_max(c("p_size"), F.lit(10)).alias("most"), F.round("p_retailprice", 1).alias("price"), sqlite.like(c("p_name"), "%e%").alias("has_e"),
        sqlite.glob(c("p_name"), "*[aeiou]*").alias("has_vowel"), F.abs(c("p_size") - 25).alias("away"),
    )


@query("dates", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, max(datediff('day', TIMESTAMP '1992-01-01', o_orderdate)) AS last_day FROM orders GROUP BY 1")
def dates(spark, d):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return table(spark, d, "orders").groupBy(month).agg(F.count("*").alias("n"), F.max(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))).cast("long").alias("last_day"))


@query(
    "date_functions",
    """SELECT o_orderkey, julian(o_orderdate) - 0.5 AS julian_day, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S day %j') AS shown, CAST(dayofweek(o_orderdate) AS VARCHAR) AS weekday,
       strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS month_end, strftime(date_trunc('year', o_orderdate) - INTERVAL 2 YEAR, '%Y-%m-%d') AS back,
       strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M') AS later FROM orders""",
)
def date_functions(spark, d):
    ts, show = F.col("o_orderdate").cast("timestamp"), sqlite.strftime
    return table(spark, d, "orders").select(
        "o_orderkey", sqlite.julianday(ts).alias("julian_day"), sqlite.unixepoch(ts).alias("seconds"), show("%d/%m/%Y %H:%M:%S day %j", ts).alias("shown"), show("%w", ts).alias("weekday"),
        show("%F", sqlite.modified(ts, "start of month", "+1 month", "-1 day")).alias("month_end"), show("%F", sqlite.modified(ts, "start of year", "-2 years")).alias("back"),
        show("%F %R", sqlite.modified(ts, "+36 hours")).alias("later"),
    )


@query(
    "json_functions",
    """SELECT event_type, key, value_type, count(*) AS n, sum(CAST(value AS BIGINT)) AS total, count(*) FILTER (WHERE valid) AS n_valid
       FROM (SELECT event_type, key, json_extract_string(props, '$.' || key) AS value, json_valid(props) AS valid,
                    CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' ELSE lower(json_type(props, '$.k')) END AS value_type
             FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)) GROUP BY event_type, key, value_type""",
)
def json_functions(spark, d):
    """The members of all objects, each a row, with the type of their values."""
    props = F.col("props")
    members = table(spark, d, "events").select("event_type", sqlite.json_type(props, "$.k").alias("value_type"), sqlite.json_valid(props).alias("valid"), F.explode(sqlite.json_entries(props)).alias("m"))
    grouped = members.groupBy("event_type", F.col("m.key").alias("key"), "value_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("m.value").cast("long")).alias("total"), F.count_if("valid").alias("n_valid"))


@query("null_order", "SELECT o_orderkey, status FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders) ORDER BY status NULLS FIRST, o_orderkey LIMIT 40")
def null_order(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return rows.orderBy("status", "o_orderkey").limit(40)


@query("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT r_regionkey + 1000 FROM region")
def set_operations(spark, d):
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    left = both.subtract(table(spark, d, "nation").where(F.col("n_regionkey") == 2).select("n_nationkey"))
    return left.union(table(spark, d, "region").select(F.col("r_regionkey") + 1000))
