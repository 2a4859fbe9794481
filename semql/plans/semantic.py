"""Semantic queries over the given tables: scans, scores, hybrid filters, joins, neighbours, writes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semql.functions import vectors
from semql.functions.embedders import HashingEmbedder, embed_column, scaled_column
from semql.functions.sqlite import compare, like, nocase, rtrimmed
from semql.operators import ann, neighbours
from semql.operators.scan import Branch, Match, VectorTable
from semql.shared import cut, is_there, shared_path
from semql.sources.store import Database
from semql.sources.workspace import Workspace, register_functions, register_search
from semql.streaming.ingest import ingest

DIM = 64


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vecs(spark: SparkSession, d: str, threshold: float = 0.1) -> VectorTable:
    return VectorTable(table(spark, d, "embeddings"), {"embedding": "embedding"}, rowid="vec_id", threshold=threshold)


#: Where documents with the vectors of their texts have been written, by application and folder.
_EMBEDDED: dict[tuple[str, str], DataFrame] = {}


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the vectors of their texts, which are made when they are written, once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _EMBEDDED or not is_there(_EMBEDDED[key]):
        rows = table(spark, d, "documents")
        made = rows.withColumn("__made", scaled_column(F.col("text"), HashingEmbedder()))
        _EMBEDDED[key] = cut(made.select(*rows.columns, F.col("__made.vector").alias("_emb_text"), F.col("__made.length").alias("_len_text")), "documents")
    return _EMBEDDED[key]


def docs(spark: SparkSession, d: str, threshold: float = 0.5) -> VectorTable:
    return VectorTable(embedded(spark, d), {"text": "_emb_text"}, HashingEmbedder(), rowid="doc_id", threshold=threshold, lengths={"text": "_len_text"})


def both(spark: SparkSession, d: str) -> VectorTable:
    """Two vector columns: documents joined with the embedding of the same id."""
    found = docs(spark, d, 0.05)
    joined = found.df.join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return found.at(df=joined, embeddings={"embedding": "embedding", "text": "_emb_text"})


def vec(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == i).first()["embedding"]


def text_of(spark: SparkSession, d: str, i: int = 1) -> str:
    """A document's text as a quoted MATCH query."""
    return '"' + table(spark, d, "documents").where(F.col("doc_id") == i).first()["text"].replace('"', " ") + '"'



def rounded(name: str, digits: int):
    """Rounded as in DuckDB: what is half a step after the multiplication goes away from zero."""
    scaled = F.abs(F.col(name)) * 10.0**digits
    whole = F.floor(scaled).cast("double")
    return F.signum(name) * F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole) / 10.0**digits


def score():
    return rounded("embedding_score", 6).alias("score")


def text_score():
    return rounded("text_score", 4).alias("score")



_S = "list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"
_SCORED = f"s AS (SELECT vec_id, label, {_S} AS score FROM embeddings)"
_T = """
tok AS (SELECT doc_id, md5(unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))) AS h FROM documents),
bucket AS (SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS b, sum(1 - 2 * (CAST('0x' || substr(h, 9, 1) AS INTEGER) % 2)) AS w FROM tok GROUP BY ALL),
size AS (SELECT doc_id, sqrt(sum(CAST(w AS DOUBLE) * w)) AS n FROM bucket GROUP BY doc_id),
t AS (SELECT x.doc_id, sum(CAST(x.w AS DOUBLE) * q.w) / any_value(s.n) / (SELECT n FROM size WHERE doc_id = 1) AS score
      FROM bucket x JOIN bucket q ON q.doc_id = 1 AND q.b = x.b JOIN size s ON s.doc_id = x.doc_id WHERE s.n > 0 GROUP BY x.doc_id)"""

FOUND: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        FOUND[name] = (f, sql)
        return f

    return add


@query("scan_filter", "SELECT vec_id, label FROM embeddings WHERE label = 3 AND vec_id >= 10")
def scan_filter(spark, d):
    return vecs(spark, d).scan(where=(F.col("label") == 3) & (F.col("vec_id") >= 10)).select("vec_id", "label")


@query("match_exact", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= 0.1")
def match_exact(spark, d):
    return vecs(spark, d).scan(Match("embedding", vec(spark, d), "exact")).select("vec_id", score())


@query("match_topn_cap", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 256) WHERE score >= -1.0")
def match_topn_cap(spark, d):
    return vecs(spark, d, -1.0).scan(Match("embedding", vec(spark, d))).select("vec_id", score())


@query("match_candidates", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.1")
def match_candidates(spark, d):
    return vecs(spark, d).scan(Match("embedding", vec(spark, d), candidates=20)).select("vec_id", score())


@query("match_default_threshold", f"WITH {_T} SELECT doc_id, round(score, 4) AS score FROM (SELECT * FROM t ORDER BY score DESC, doc_id LIMIT 256) WHERE score >= 0.5")
def match_default_threshold(spark, d):
    return docs(spark, d).scan(Match("text", text_of(spark, d))).select("doc_id", text_score())


@query("match_text_exact", f"WITH {_T} SELECT doc_id, round(score, 4) AS score FROM t WHERE score >= 0.5")
def match_text_exact(spark, d):
    return docs(spark, d).scan(Match("text", text_of(spark, d) + " /exact ")).select("doc_id", text_score())


@query("prefilter_eq", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label = 3 AND score >= -0.5")
def prefilter_eq(spark, d):
    return vecs(spark, d, -0.5).scan(Match("embedding", vec(spark, d)), where=F.col("label") == 3).select("vec_id", score())


@query("prefilter_range", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label >= 2 AND label < 7 AND score >= -0.5")
def prefilter_range(spark, d):
    return vecs(spark, d, -0.5).scan(Match("embedding", vec(spark, d)), where=(F.col("label") >= 2) & (F.col("label") < 7)).select("vec_id", score())


@query("prefilter_in", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label IN (1, 4, 7, 9) AND label BETWEEN 2 AND 8 AND score >= 0.0")
def prefilter_in(spark, d):
    where = F.col("label").isin(1, 4, 7, 9) & F.col("label").between(2, 8)
    return vecs(spark, d, 0.0).scan(Match("embedding", vec(spark, d)), where=where).select("vec_id", score())


@query("prefilter_like", f"WITH {_T} SELECT doc_id, round(score, 4) AS score FROM t JOIN documents USING (doc_id) WHERE source ILIKE 'src1%' AND score >= 0.3")
def prefilter_like(spark, d):
    return docs(spark, d, 0.3).scan(Match("text", text_of(spark, d)), where=like(F.col("source"), "SRC1%")).select("doc_id", text_score())


@query("recall_cliff_residual", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 256) WHERE score >= -1.0 AND label = 3")
def recall_cliff_residual(spark, d):
    found = vecs(spark, d, -1.0).scan(Match("embedding", vec(spark, d)))
    return found.where(F.col("label") == 3).select("vec_id", score())


_BOTH = f"{_SCORED}, {_T}, j AS (SELECT d.doc_id, s.score AS v, coalesce(t.score, 0) AS w FROM s JOIN documents d ON d.doc_id = s.vec_id LEFT JOIN t ON t.doc_id = d.doc_id)"


@query("multi_match_and", f"WITH {_BOTH} SELECT doc_id, round(v, 6) AS v_score, round(w, 4) AS t_score FROM j WHERE v >= 0.05 AND w >= 0.05")
def multi_match_and(spark, d):
    found = both(spark, d).scan(Match("embedding", vec(spark, d)), Match("text", text_of(spark, d)))
    return found.select("doc_id", rounded("embedding_score", 6).alias("v_score"), rounded("text_score", 4).alias("t_score"))


@query(
    "multi_match_or",
    f"""WITH {_BOTH}, a AS (SELECT * FROM (SELECT * FROM j ORDER BY v DESC, doc_id LIMIT 256) WHERE v >= 0.05),
        b AS (SELECT * FROM (SELECT * FROM j ORDER BY w DESC, doc_id LIMIT 256) WHERE w >= 0.05)
        SELECT doc_id, round(v, 6) AS v_score, CAST(NULL AS DOUBLE) AS t_score FROM a
        UNION ALL SELECT doc_id, NULL, round(w, 4) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
)
def multi_match_or(spark, d):
    found = both(spark, d).any_of(Branch((Match("embedding", vec(spark, d)),)), Branch((Match("text", text_of(spark, d)),)))
    return found.select("doc_id", rounded("embedding_score", 6).alias("v_score"), rounded("text_score", 4).alias("t_score"))


@query(
    "or_branch_union",
    f"""WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label = 2 AND score >= 0.0
        UNION ALL SELECT vec_id, CAST(NULL AS DOUBLE) FROM s WHERE label IN (2, 3) AND NOT (label = 2 AND score >= 0.0)""",
)
def or_branch_union(spark, d):
    near = Branch((Match("embedding", vec(spark, d)),), F.col("label") == 2)
    return vecs(spark, d, 0.0).any_of(near, Branch((), F.col("label").isin(2, 3))).select("vec_id", score())


@query("score_null_no_match", "SELECT vec_id, CAST(NULL AS DOUBLE) AS score FROM embeddings WHERE label = 5")
def score_null_no_match(spark, d):
    return vecs(spark, d).scan(where=F.col("label") == 5).select("vec_id", score())


@query("score_threshold_residual", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 256) WHERE score > 0.15")
def score_threshold_residual(spark, d):
    return vecs(spark, d).scan(Match("embedding", vec(spark, d))).where(F.col("embedding_score") > 0.15).select("vec_id", score())


@query("score_agg", f"WITH {_SCORED} SELECT count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS top_score FROM s WHERE score >= 0.05")
def score_agg(spark, d):
    found = vecs(spark, d, 0.05).scan(Match("embedding", vec(spark, d), "exact"))
    return found.agg(F.count("*").alias("n"), F.round(F.avg("embedding_score"), 6).alias("mean_score"), F.round(F.max("embedding_score"), 6).alias("top_score"))


@query("score_group_best", f"WITH {_SCORED} SELECT label, count(*) AS n, round(max(score), 6) AS best FROM s WHERE score >= 0.0 GROUP BY label HAVING count(*) > 1")
def score_group_best(spark, d):
    found = vecs(spark, d, 0.0).scan(Match("embedding", vec(spark, d), "exact")).groupBy("label")
    return found.agg(F.count("*").alias("n"), F.round(F.max("embedding_score"), 6).alias("best")).where(F.col("n") > 1)


@query(
    "score_window_rank",
    f"""WITH {_SCORED} SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank
        FROM s WHERE score >= -1.0) WHERE rank <= 3""",
)
def score_window_rank(spark, d):
    found = vecs(spark, d, -1.0).scan(Match("embedding", vec(spark, d), "exact"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("embedding_score"), "vec_id"))
    return found.select("label", "vec_id", rank.alias("rank")).where(F.col("rank") <= 3)


@query("default_order", f"WITH {_SCORED} SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM s WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 15")
def default_order(spark, d):
    source = vecs(spark, d)
    best = source.ordered(source.scan(Match("embedding", vec(spark, d), "exact"))).limit(15)
    return best.select("vec_id", F.row_number().over(Window.orderBy(F.desc("embedding_score"), "vec_id")).alias("place"))


@query("topk", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label <> 3 AND score >= -1.0 ORDER BY score DESC, vec_id LIMIT 10")
def topk(spark, d):
    found = vecs(spark, d, -1.0).scan(Match("embedding", vec(spark, d)), where=F.col("label") != 3)
    return found.orderBy(F.desc("embedding_score"), "vec_id").limit(10).select("vec_id", score())


@query("page_offset", "SELECT vec_id AS rowid, label FROM embeddings ORDER BY vec_id LIMIT 25 OFFSET 50")
def page_offset(spark, d):
    return vecs(spark, d).page(25, 50).select("rowid", "label")


@query(
    "hybrid_join",
    f"""WITH {_T} SELECT t.doc_id, quality, round(score, 4) AS score FROM t JOIN labels USING (doc_id) JOIN documents USING (doc_id)
        WHERE lang = 'en' AND score >= 0.5""",
)
def hybrid_join(spark, d):
    found = docs(spark, d).scan(Match("text", text_of(spark, d)), where=F.col("lang") == "en")
    return found.join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", text_score())


@query(
    "semantic_join",
    _T.replace("\ntok AS", "WITH tok AS", 1).split("\nt AS")[0].rstrip(",")
    + """, itok AS (SELECT item_id, md5(unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))) AS h FROM benchmark),
        ibucket AS (SELECT item_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 256 AS b, sum(1 - 2 * (CAST('0x' || substr(h, 9, 1) AS INTEGER) % 2)) AS w FROM itok GROUP BY ALL),
        isize AS (SELECT item_id, sqrt(sum(CAST(w AS DOUBLE) * w)) AS n FROM ibucket GROUP BY item_id)
        SELECT i.item_id, x.doc_id, round(sum(CAST(x.w AS DOUBLE) * i.w) / any_value(s.n) / any_value(k.n), 3) AS score
        FROM bucket x JOIN ibucket i ON i.b = x.b JOIN size s ON s.doc_id = x.doc_id JOIN isize k ON k.item_id = i.item_id
        GROUP BY i.item_id, x.doc_id HAVING sum(CAST(x.w AS DOUBLE) * i.w) / any_value(s.n) / any_value(k.n) >= 0.6""",
)
def semantic_join(spark, d):
    embedder = HashingEmbedder()
    items = table(spark, d, "benchmark").withColumn("made", scaled_column(F.col("text"), embedder)).select("item_id", "made.*")
    found = neighbours.similarity_join(embedded(spark, d), items, 0.6, "doc_id", "_emb_text", "item_id", "vector", embedder.dim, length_col="_len_text", query_length="length")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), rounded("score", 3).alias("score"))


_PAIRS = """p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""


@query(
    "knn_exact",
    f"WITH {_PAIRS} SELECT query_id, id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10",
)
def knn_exact(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.where(F.col("vec_id") % 20 == 0)
    found = neighbours.nearest(rows, asked, 10, "vec_id", "embedding", "vec_id", "embedding", DIM)
    return found.select("query_id", "id", rounded("score", 5).alias("score"), "rank")


@query("ann_candidates")
def ann_candidates(spark, d):
    """Rows only: the neighbours depend on the fitted cells; recall is tested against brute force."""
    rows = table(spark, d, "embeddings")
    index = ann.fit(rows, "embedding", "vec_id")
    found = index.search(index.assign(rows, "embedding"), rows.where(F.col("vec_id") % 20 == 0), 10, "vec_id", "embedding", "vec_id", "embedding")
    return found.select("query_id", "id", rounded("score", 5).alias("score"), "rank")


@query("semi_match", f"WITH {_SCORED} SELECT l.doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM s WHERE s.vec_id = l.doc_id AND score >= 0.0)")
def semi_match(spark, d):
    found = vecs(spark, d, 0.0).scan(Match("embedding", vec(spark, d), "exact"))
    return table(spark, d, "labels").join(found, F.col("doc_id") == F.col("vec_id"), "left_semi").select("doc_id", "quality")


@query("anti_match", f"WITH {_SCORED} SELECT l.doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.vec_id = l.doc_id AND score >= 0.0)")
def anti_match(spark, d):
    found = vecs(spark, d, 0.0).scan(Match("embedding", vec(spark, d), "exact"))
    return table(spark, d, "labels").join(found, F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id", "quality")


@query(
    "match_union_except",
    f"""WITH {_SCORED} (SELECT vec_id FROM s WHERE score >= 0.1 UNION SELECT vec_id FROM s WHERE label = 1)
        EXCEPT (SELECT vec_id FROM s WHERE score >= 0.2 INTERSECT SELECT vec_id FROM s WHERE label < 5)""",
)
def match_union_except(spark, d):
    at = lambda t: vecs(spark, d, t).scan(Match("embedding", vec(spark, d), "exact")).select("vec_id")
    rows = table(spark, d, "embeddings")
    left = at(0.1).union(rows.where(F.col("label") == 1).select("vec_id")).distinct()
    return left.subtract(at(0.2).intersect(rows.where(F.col("label") < 5).select("vec_id")))


@query("nocase_eq", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' COLLATE NOCASE")
def nocase_eq(spark, d):
    return table(spark, d, "customer").where(nocase(F.col("c_mktsegment")) == "building").select("c_custkey", "c_mktsegment")


@query(
    "rtrim_eq",
    """SELECT c_custkey, c_mktsegment FROM (SELECT *, c_mktsegment || CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE chr(9) END AS padded FROM customer)
       WHERE rtrim(padded, ' ') = 'BUILDING' OR rtrim(padded, ' ') = 'MACHINERY'""",
)
def rtrim_eq(spark, d):
    """Spaces at the end don't count, on either side; a tab does."""
    end = F.when(F.col("c_nationkey") % 3 == 0, "").when(F.col("c_nationkey") % 3 == 1, "   ").otherwise("\t")
    value = rtrimmed(F.concat("c_mktsegment", end))
    wanted = (value == rtrimmed(F.lit("BUILDING  "))) | (value == rtrimmed(F.lit("MACHINERY")))
    return table(spark, d, "customer").where(wanted).select("c_custkey", "c_mktsegment")


@query("int_real_exact", "SELECT o_orderkey, CASE WHEN CAST(o_orderkey AS DECIMAL(38, 1)) + 9007199254740992 > 9007199254741000.5 THEN 1 ELSE -1 END AS side FROM orders")
def int_real_exact(spark, d):
    big = F.col("o_orderkey") + F.lit(9007199254740992)
    side = F.when(compare(big, 9007199254741000.0) > 0, 1).otherwise(-1)
    return table(spark, d, "orders").select("o_orderkey", side.alias("side"))


@query(
    "null_empty_excluded",
    """SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE n_chars % 3 = 2 AND regexp_matches(text, '[^ \t-\r]')) AS n_embedded FROM documents GROUP BY lang""",
)
def null_empty_excluded(spark, d):
    """Some texts become null and some blanks as long as they were; the others are embedded whole."""
    kind = F.col("n_chars") % 3
    text = F.when(kind == 2, F.col("text")).when(kind == 1, F.repeat(F.lit(" "), F.col("n_chars").cast("int")))
    rows = table(spark, d, "documents").select("lang", embed_column(text, HashingEmbedder()).alias("v"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_rows"), F.count("v").alias("n_embedded"))


@query(
    "embed_normalize",
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * (label + 1)) AS v FROM embeddings),
       n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM x)
       SELECT vec_id, round(CAST(CAST(v[1] / n AS FLOAT) AS DOUBLE), 4) AS head, round(CAST(CAST(v[64] / n AS FLOAT) AS DOUBLE), 4) AS last FROM n""",
)
def embed_normalize(spark, d):
    unit = vectors.normalize(F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)))
    at = lambda i: F.round(F.element_at("u", i).cast("double"), 4)
    return table(spark, d, "embeddings").select("vec_id", unit.alias("u")).select("vec_id", at(1).alias("head"), at(-1).alias("last"))


@query("embed_cosine", f"SELECT vec_id, round({_S}, 5) AS score FROM embeddings")
def embed_cosine(spark, d):
    scaled = F.transform("embedding", lambda x: x * 3)
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(scaled, vectors.literal(vec(spark, d))), 5).alias("score"))


def _stored(spark: SparkSession, d: str, name: str) -> Database:
    db = Database(spark, shared_path(spark, name), HashingEmbedder(dim=16, model_id="hashing-16"))
    db.create_table("notes", "doc INTEGER", "lang TEXT", "body TEXT VECTOR")
    db.insert("notes", table(spark, d, "benchmark").select(F.col("item_id").alias("_rowid"), F.col("item_id").alias("doc"), F.lit("xx").alias("lang"), F.col("text").alias("body")))
    return db


@query(
    "dml_insert_update_delete",
    """SELECT item_id AS doc, CASE WHEN item_id % 5 = 0 THEN 'zz' ELSE 'xx' END AS lang, CASE WHEN item_id % 5 = 0 THEN 'changed' ELSE text END AS body
       FROM benchmark WHERE item_id % 3 <> 0 UNION ALL SELECT doc_id + 100000, CASE WHEN lang = 'fr' THEN 'FR' ELSE lang END, text FROM documents WHERE lang <> 'es'""",
)
def dml_insert_update_delete(spark, d):
    db = _stored(spark, d, "dml")
    db.insert("notes", table(spark, d, "documents").select((F.col("doc_id") + 100000).alias("doc"), "lang", F.col("text").alias("body")))
    db.update("notes", {"lang": "zz", "body": "changed"}, (F.col("doc") % 5 == 0) & (F.col("doc") < 100000))
    db.update("notes", {"lang": "FR"}, F.col("lang") == "fr")
    db.delete("notes", (F.col("lang") == "es") | ((F.col("doc") % 3 == 0) & (F.col("doc") < 100000)))
    stored = db.table("notes")
    return stored.star(stored.df)


@query("replace_in_batch", "SELECT doc_id AS rowid, CASE WHEN lang = 'en' THEN 'again' ELSE lang END AS lang, text AS body FROM documents")
def replace_in_batch(spark, d):
    """English documents come twice in one batch; the later row stays."""
    db = Database(spark, shared_path(spark, "batch"))
    db.create_table("notes", "lang TEXT", "body TEXT")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("_rowid"), "lang", F.col("text").alias("body"))
    db.insert("notes", rows.unionByName(rows.where(F.col("lang") == "en").withColumn("lang", F.lit("again"))))
    return db.rows("notes").select(F.col("_rowid").alias("rowid"), "lang", "body")


@query("update_rowid", "SELECT 2 * (doc_id // 2) AS rowid, arg_max(lang, doc_id) AS lang, arg_max(text, doc_id) AS body FROM documents GROUP BY 1")
def update_rowid(spark, d):
    """Odd row ids move onto the even ones before them, whose rows they replace."""
    db = Database(spark, shared_path(spark, "moved"))
    db.create_table("notes", "lang TEXT", "body TEXT")
    db.insert("notes", table(spark, d, "documents").select(F.col("doc_id").alias("_rowid"), "lang", F.col("text").alias("body")))
    db.update("notes", {"_rowid": F.col("_rowid") - F.col("_rowid") % 2})
    return db.rows("notes").select(F.col("_rowid").alias("rowid"), "lang", "body")


@query("txn_rollback", "SELECT item_id AS doc, CASE WHEN item_id < 10 THEN 'kept' ELSE 'xx' END AS lang FROM benchmark")
def txn_rollback(spark, d):
    db = _stored(spark, d, "txn")
    db.begin()
    db.update("notes", {"lang": "kept"}, F.col("doc") < 10)
    db.savepoint("before")
    db.delete("notes", F.col("doc") >= 5)
    db.rollback_to("before")
    db.commit()
    db.begin()
    db.delete("notes")
    db.rollback()
    return db.rows("notes").select("doc", "lang")


@query("replace_rowid", "SELECT item_id AS rowid, CASE WHEN item_id < 10 THEN 'new' ELSE 'xx' END AS lang FROM benchmark")
def replace_rowid(spark, d):
    db = _stored(spark, d, "replace")
    db.insert("notes", table(spark, d, "benchmark").where(F.col("item_id") < 10).select(F.col("item_id").alias("_rowid"), F.lit("new").alias("lang")))
    return db.rows("notes").select(F.col("_rowid").alias("rowid"), "lang")


@query("stream_ingest", "SELECT doc_id AS rowid, lang, source, text FROM documents")
def stream_ingest(spark, d):
    """Documents as a stream, embedded and appended to a vector table batch by batch."""
    path = f"{d}/documents.parquet"
    db = Database(spark, shared_path(spark, "stream"), HashingEmbedder(dim=16, model_id="hashing-16"))
    db.create_table("docs", "lang TEXT", "source TEXT", "text TEXT VECTOR")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern: the table may be one file
    ingest(stream.select(F.col("doc_id").alias("_rowid"), "lang", "source", "text"), db, "docs", shared_path(spark, "stream-log")).awaitTermination()
    db.compact("docs")
    return db.rows("docs").select(F.col("_rowid").alias("rowid"), "lang", "source", "text")


@query(
    "introspection",
    f"""WITH {_SCORED} SELECT label, count(*) AS n, round(max(score), 5) AS best, '0.1.0' AS version, 'hashing-256' AS model, CAST(256 AS BIGINT) AS dim FROM s GROUP BY label""",
)
def introspection(spark, d):
    register_functions(spark, HashingEmbedder())
    rows = table(spark, d, "embeddings").select("label", F.call_function("semql_dot", "embedding", F.array(*map(F.lit, vec(spark, d)))).alias("score"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("score"), 5).alias("best"))
    return counts.select("*", F.expr("semql_version()").alias("version"), F.expr("semql_model()").alias("model"), F.expr("semql_dim()").alias("dim"))


def _sql_search(spark: SparkSession, d: str, view: str) -> None:
    """Documents for SQL, as ``view_data`` with vectors and by the search functions of ``view``."""
    register_functions(spark, HashingEmbedder())
    source = docs(spark, d)
    source.df.createOrReplaceTempView(f"{view}_data")
    register_search(spark, view, source.at(df=source.df.drop("n_chars")))


_ONE = "(SELECT text FROM documents WHERE doc_id = 1)"


@query(
    "match_language",
    f"""WITH {_T}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM t),
        q AS (SELECT * FROM (VALUES ('bare', 256), ('quoted, exact', 2147483647), ('blanks, 5 candidates', 5), ('quoted, more than there are', 2147483647), ('empty', 0)) v(kind, cap))
        SELECT kind, count(score) AS n, round(min(score), 4) AS least FROM q LEFT JOIN r ON place <= cap AND score >= 0.5 GROUP BY kind""",
)
def match_language(spark, d):
    """Ways to say how many rows a search looks at, each over all texts."""
    source, text = docs(spark, d), text_of(spark, d)
    bare = text[1:-1].replace("/", " ").replace("\n", " ").strip()
    ways = {"bare": bare, "quoted, exact": text + "/exact", "blanks, 5 candidates": f"  {bare} /hnsw:+5 ", "quoted, more than there are": text + " /hnsw:3000000000", "empty": ' "" /exact'}
    parts = [source.scan(Match("text", way)).agg(F.lit(kind).alias("kind"), F.count("text_score").alias("n"), F.min("text_score").alias("least")).withColumn("least", rounded("least", 4)) for kind, way in ways.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("match_in_sql", f"WITH {_T} SELECT doc_id AS rowid, lang, round(score, 4) AS score FROM (SELECT * FROM t ORDER BY score DESC, doc_id LIMIT 256) JOIN documents USING (doc_id) WHERE score >= 0.5")
def match_in_sql(spark, d):
    _sql_search(spark, d, "semql_docs")
    return spark.sql("SELECT rowid, lang, round(text_score, 4) AS score FROM semql_docs_text_match(:q)", args={"q": text_of(spark, d)[1:-1]})


@query(
    "match_in_sql_join",
    f"WITH {_T} SELECT quality, lang, count(*) AS n, round(max(score), 4) AS best FROM t JOIN documents USING (doc_id) JOIN labels USING (doc_id) WHERE score >= 0.3 GROUP BY quality, lang",
)
def match_in_sql_join(spark, d):
    _sql_search(spark, d, "semql_docs")
    table(spark, d, "labels").createOrReplaceTempView("semql_labels")
    text = "SELECT quality, lang, count(*) AS n, round(max(text_score), 4) AS best FROM semql_docs_text_exact(:q, 0.3) JOIN semql_labels ON rowid = doc_id GROUP BY quality, lang"
    return spark.sql(text, args={"q": text_of(spark, d)[1:-1]})


@query("match_join_key", f"WITH {_SCORED} SELECT vec_id, quality, round(score, 6) AS score FROM s JOIN labels ON doc_id = vec_id WHERE score >= -1.0")
def match_join_key(spark, d):
    """The join holds before the search: no cap hides rows that it keeps."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    found = vecs(spark, d, -1.0).at(cap=3).scan(Match("embedding", vec(spark, d)), join=(labels, F.col("doc_id") == F.col("vec_id")))
    return found.select("vec_id", "quality", score())


@query("rowid_residual", f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 256) WHERE score >= -1.0 AND vec_id % 2 = 1")
def rowid_residual(spark, d):
    found = vecs(spark, d, -1.0).scan(Match("embedding", vec(spark, d)))
    return found.where(F.col("vec_id") % 2 == 1).select("vec_id", score())


@query(
    "is_null_residual",
    f"""WITH {_SCORED}, k AS (SELECT vec_id, nullif(label, 4) AS label, score FROM s)
        SELECT vec_id, label IS NULL AS missing, round(score, 6) AS score FROM (SELECT * FROM k ORDER BY score DESC, vec_id LIMIT 256) WHERE score >= -1.0 AND (label IS NULL OR label = 5)""",
)
def is_null_residual(spark, d):
    source = vecs(spark, d, -1.0)
    source = source.at(df=source.df.withColumn("label", F.nullif(F.col("label"), F.lit(4))))
    found = source.scan(Match("embedding", vec(spark, d)))
    return found.where(F.col("label").isNull() | (F.col("label") == 5)).select("vec_id", F.col("label").isNull().alias("missing"), score())


@query(
    "search_counters",
    f"""WITH {_SCORED} SELECT 'cap' AS search, (SELECT count(*) FROM (SELECT 1 FROM s LIMIT 20)) AS candidates, (SELECT count(*) FROM (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.1) AS rows_matched
        UNION ALL SELECT 'exact', count(*), count(*) FILTER (WHERE score >= 0.1) FROM s
        UNION ALL SELECT 'filter', count(*), count(*) FILTER (WHERE score >= 0.1) FROM s WHERE label = 3""",
)
def search_counters(spark, d):
    """What searches count as they run."""
    found = []
    for name, match, where in [("cap", {"candidates": 20}, None), ("exact", {"mode": "exact"}, None), ("filter", {}, F.col("label") == 3)]:
        source = vecs(spark, d).at(counted=True)
        source.scan(Match("embedding", vec(spark, d), **match), where=where).write.format("noop").mode("overwrite").save()
        source.metrics.settle(ran=True)
        counts = source.metrics.snapshot()
        found.append((name, counts["candidates"], counts["rows_matched"]))
    return spark.createDataFrame(found, "search string, candidates long, rows_matched long")


@query(
    "view_over_view",
    "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE n_chars > 200 GROUP BY lang HAVING count(*) > 3",
)
def view_over_view(spark, d):
    w = Workspace(spark, shared_path(spark, "views"))
    db = w.open_database("x")
    db.create_table("semql_texts", "lang TEXT", "n_chars INTEGER", "body TEXT")
    db.insert("semql_texts", table(spark, d, "documents").select("lang", "n_chars", F.col("text").alias("body")))
    w.create_view("semql_long", "SELECT * FROM semql_texts WHERE n_chars > 200")
    w.create_view("semql_by_lang", "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM semql_long GROUP BY lang")
    return w.query("SELECT * FROM semql_by_lang WHERE n > ?", [3]).df


@query("reindexed_scores", f"WITH {_T.replace('% 256', '% 32')} SELECT doc_id AS rowid, round(score, 4) AS score FROM t WHERE score >= 0.7")
def reindexed_scores(spark, d):
    """A table of one model, embedded again with another and searched with that."""
    root = shared_path(spark, "reindex")
    db = Database(spark, root, HashingEmbedder(dim=16, model_id="hashing-16"))
    db.create_table("docs", "text TEXT VECTOR")
    db.insert("docs", table(spark, d, "documents").select(F.col("doc_id").alias("_rowid"), "text"))
    other = Database(spark, root, HashingEmbedder(dim=32, model_id="hashing-32"), threshold=0.7)
    other.reindex("docs")
    return other.table("docs").scan(Match("text", text_of(spark, d) + "/exact")).select(F.col("_rowid").alias("rowid"), text_score())
